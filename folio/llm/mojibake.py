"""Find and repair text that was decoded with the wrong character encoding.

A passage is repaired by a best-first search: a state is the passage's suspicious
tokens, an edge undoes one decoding step ("encode as B, decode as A") or unescapes
character references, and the frontier is ordered by how implausible the characters
of a state are plus the price of the steps taken.  Visited states are hashed, so a
text reachable by two paths is expanded once.

Defined results
---------------
* null or empty text: no passage, the text comes back unchanged (null stays null);
* plain ASCII without character references: never examined;
* U+FFFD which the text quotes as its subject is not damage; elsewhere it is damage
  that cannot be undone: the record is reported, the mark stays in the text;
* repeated rows: each row is handled for itself, ``found_ids`` returns ids once;
* extra columns pass through untouched (only ``id_col`` and ``text_col`` are read).
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Single-byte code pages a reader may have used by mistake; undefined bytes map to C1 controls.
_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp1253", "cp1254", "iso8859_15")
_READ_AS_WIDE = ("gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")
# Encodings whose bytes may have been read as one of the above.
_LEGACY = ("cp1251", "koi8_r", "iso8859_2", "cp1250", "cp866", "cp1253", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr", "cp1252", "cp437", "cp850", "mac_roman", "cp1254", "cp1255", "cp1256", "iso8859_5")
_PRICE_UTF8, _PRICE_LEGACY, _PRICE_UNESCAPE = 0.4, 2.5, 0.4
_GAIN_UTF8, _GAIN_LEGACY = 1.5, 1.4
#: Damage that no step undoes is reported from this cost on, all told and for each suspicious character.
_BEYOND_DOUBT, _BEYOND_DOUBT_EACH = 12.0, 0.75


def _byte_chars(codec: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _encode_map(codec: str) -> dict[int, str]:
    """Translation from the code page's characters to the bytes as Latin-1 characters."""
    table = {}
    for b, ch in reversed(list(enumerate(_byte_chars(codec)))):
        table[ord(ch)] = chr(b)
    for b in range(0x80, 0xA0):  # bytes that a lenient reader passed through
        table.setdefault(b, chr(b))
    for b in range(0xA0, 0x100):  # characters the page lacks: not encodable
        table.setdefault(b, "\u0100")
    return table


_ENCODE = {c: _encode_map(c) for c in _READ_AS}


def _char_class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


def _utf8_shape(codec: str) -> str:
    """What a valid multi-byte UTF-8 sequence looks like when read in the code page."""
    ch = _byte_chars(codec)
    cont = _char_class(ch[0x80:0xC0])
    two, three, four = (_char_class(ch[a:b]) for a, b in ((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5)))
    return f"{two}{cont}|{three}{cont}{{2}}|{four}{cont}{{3}}"


def _common_han() -> frozenset[str]:
    """First-level characters of GB 2312 and JIS X 0208: the everyday ones."""
    out = set()
    for hi in range(0xB0, 0xD8):
        for lo in range(0xA1, 0xFF):
            try:
                out.add(bytes([hi, lo]).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    for row in range(0x30, 0x50):
        for col in range(0x21, 0x7F):
            try:
                out.add(bytes([row | 0x80, col | 0x80]).decode("euc_jp"))
            except UnicodeDecodeError:
                pass
    return frozenset(out)


_COMMON_HAN = _common_han()
_RARE_HAN = re.compile("[" + "".join(chr(c) for c in range(0x4E00, 0xA000) if chr(c) not in _COMMON_HAN) + "\u3400-\u4dbf]")
_SHAPE = re.compile("|".join(_utf8_shape(c) for c in _READ_AS if c not in ("cp866", "koi8_r", "cp1253", "cp1254", "iso8859_15")))
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_CYR = "\u0400-\u052f"
_WEIGHTED = (
    (re.compile("[\x80-\x84\x86-\x9f]"), 3.0),
    (re.compile("\ufffd"), 3.0),
    (_SHAPE, 2.5),
    (re.compile(f"(?<=[{_LATIN}{_CYR}])[\u00a1-\u00a9\u00ab-\u00b1\u00b4-\u00b6\u00b8\u00bb-\u00bf\u00d7\u00f7\u221a\u2248\u2021\u2020\u201e\u201a\u2030\u20ac\u2122](?=[{_LATIN}{_CYR}])"), 2.0),
    (re.compile("(?<=[\u00b1\u00b3\u00b6\u00bf\u00b9\u00ea\u00e6])[\u00b3\u00b1\u00b6](?=\\b|[.,;:]|$)"), 1.0),
    (re.compile(f"[{_CYR}][{_LATIN}]|[{_LATIN}][{_CYR}]"), 1.5),
    (re.compile("[\u2500-\u259f\u2310\u2320\u2321]"), 2.0),
    (re.compile(f"(?<=[{_CYR}])[\u00a4\u00a7\u00a9\u00ab-\u00b1\u00b5-\u00b7\u00bb\u20ac\u2020\u2021\u2030\u2116\u2122]"), 1.5),
    (re.compile("[\u0430-\u044f\u0451][\u0410-\u042f\u0401]+"), 5.5),
    (re.compile("(?<=[a-z\u00df-\u00ff])[\u00bf\u00b6\u00bc\u00be\u00b9](?=[a-z\u00df-\u00ff])"), 2.5),
    (re.compile("[\uff61-\uff9f\ue000-\uf8ff]"), 1.5),
    (_RARE_HAN, 0.7),
    (re.compile("[\u0370-\u03ff][\u00a1-\u00bf\u2500-\u259f]|[\u00a1-\u00bf\u2500-\u259f][\u0370-\u03ff]"), 2.0),
    (re.compile("[\u07c0-\u07ff\u0700-\u074f\u0780-\u07bf\u0250-\u02af\u02b0-\u02ff\u1400-\u167f\ua000-\ua4cf]"), 2.0),
)
_WEIGHTED += (
    (re.compile(f"(?<=[{_LATIN}])[\u2264\u2265\u2261\u2219\u2229\u03b1-\u03c9\u02c6\u02c7\u02d8-\u02dd](?=[a-z])"), 2.0),
    (re.compile("[\ufb00-\ufb06\u2202\u2206\u220f\u2211\u221a\u221e\u222b\u25ca\u2044](?=\\w)|(?<=\\w)[\ufb00-\ufb06\u2202\u2206\u220f\u2211\u221a\u221e\u222b\u25ca\u2044]"), 1.5),
    (re.compile("[\u2100-\u2115\u2117-\u2121\u2123-\u214f\u3200-\u33ff]"), 1.5),
    (re.compile("(?<=[a-z])[\u00c0-\u00d6\u00d8-\u00de\u0178](?=[a-z])"), 2.0),
)
# Letters that are seldom in running text of their script; they only decide between equally cheap texts.
_SELDOM = re.compile("[\u0444\u0446\u0448-\u044a\u044d\u044e\u0445\u0436\u0451-\u045f\u0490-\u052f\u0424\u0426\u0428-\u042a\u042d\u042e\u0402-\u040f\u0100-\u024f\u0370-\u03ff\u0590-\u06ff\u2100-\u214f\u3200-\u33ff]")
_SIGNS = re.compile("[\u00a1-\u00bf\u2013-\u20cf\u2100-\u25ff]")
_PAIR = re.compile(f"(?<![{_CYR}])[{_CYR}]{{2}}(?![\\w\u0080-\u00bf\u2010-\u2122])")
_ACCENT_RUN = re.compile("[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{3,}")
_MARK_IN_WORD = re.compile(f"(?<=[{_LATIN}])[\u00a3\u00b1\u00b3\u00b6\u00b9\u00bf\u00a1\u00bc\u00be\u00af](?=[^\\S]|[.,;:)\"']|$)|(?:(?<=\\s)|(?<=^))[\u00b3\u00b6\u00b1\u00b9\u00bc\u00be\u00af](?=[{_LATIN}])")
_ENTITY = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_TOKEN = re.compile(r"[^ \t\r\n]+")
_QUOTED_MARK = re.compile("(?:[\"'`(\u2018\u201c\u00ab\\[<]\ufffd+[\"'`)\u2019\u201d\u00bb\\]>])")
_NAMES_MARK = re.compile(r"U\+FFFD|\\ufffd|replacement character", re.I)


@lru_cache(maxsize=1 << 16)
def implausibility(text: str) -> float:
    """How unlikely the characters of a passage are in correctly decoded text; 0 is plain."""
    if _ENTITY.search(text):
        bare = html.unescape(text)
        return implausibility(bare) + 1.0 if bare != text and _SHAPE.search(bare) else 0.0 if text.isascii() else _implausible(text)
    return _implausible(text)


def _implausible(text: str) -> float:
    # a lone word of two Cyrillic letters may be a real one that happens to look like UTF-8
    cost = sum(w * n for rx, w in _WEIGHTED if (n := len(rx.findall(_PAIR.sub(" ", text) if rx is _SHAPE else text))))
    for run in _ACCENT_RUN.findall(text):
        cost += 0.8 * (len(run) - 2)
    return cost + 1.5 * len(_MARK_IN_WORD.findall(text))


def oddity(state: tuple[str, ...]) -> int:
    """Letters of the state that are seldom in their script, capitals inside words and signs counted twice."""
    return sum(len(_SELDOM.findall(t)) + 2 * len(_SIGNS.findall(t)) + 2 * sum(a.islower() and b.isupper() for a, b in zip(t, t[1:])) for t in state)


def _to_bytes(token: str, codec: str) -> bytes | None:
    if codec == "gbk" or codec in _READ_AS_WIDE:
        try:
            return b"\xff".join(piece.encode(codec) for piece in token.split("\ufffd"))
        except UnicodeEncodeError:
            return None
    out = token.translate(_ENCODE[codec])
    if "\ufffd" in out:
        out = out.replace("\ufffd", "\xff")
    try:
        return out.encode("latin-1")
    except UnicodeEncodeError:
        return None


def _from_bytes(raw: bytes, codec: str, damaged: bool) -> str | None:
    try:
        if codec != "utf-8" and damaged:
            return None
        return raw.decode(codec)
    except UnicodeDecodeError:
        if not damaged:
            return None
    text = raw.decode("utf-8", "replace")
    wide = sum(not c.isascii() for c in text)
    return text if wide and text.count("\ufffd") <= 0.67 * wide else None


def _step(token: str, read_as: str, really: str) -> str | None:
    raw = _to_bytes(token, read_as)
    if raw is None or raw.isascii():
        return None
    # a space read as NBSP was split off the last character of a token
    return _from_bytes(raw, really, "\ufffd" in token)


_NEAR_STEPS = (("unescape", "", _PRICE_UNESCAPE), *((b, "utf-8", _PRICE_UTF8) for b in (*_READ_AS, *_READ_AS_WIDE)))
#: What a legacy step costs more whose pages are seldom met.
_SELDOM_PAGE = {"mac_roman": 0.6, "cp437": 0.6, "cp850": 0.6, "cp1254": 0.4, "cp1255": 0.6, "cp1256": 0.6, "iso8859_5": 0.4, "big5": 0.4, "euc_kr": 0.2}
_SELDOM_READER = {"cp1252": 0.0, "latin-1": 0.0, "cp1251": 0.0, "koi8_r": 0.0, "cp866": 0.0, "cp437": 0.1, "cp850": 0.1, "mac_roman": 0.1, "gbk": 0.5, "shift_jis": 0.8, "euc_jp": 0.8, "big5": 0.8, "euc_kr": 0.8}
_FAR_STEPS = tuple((b, a, _SELDOM_PAGE.get(a, 0.0) + _SELDOM_READER.get(b, 0.3)) for b in (*_READ_AS, "gbk", *_READ_AS_WIDE[1:]) for a in _LEGACY if a != b)


def _apply(state: tuple[str, ...], weights: tuple[int, ...], step: tuple[str, str, float], limit: float) -> tuple[tuple[str, ...], float] | None:
    """The state with the step undone in every token where that is possible, and how implausible it
    is then; null if nothing changes or that is over the limit.

    A step into UTF-8 or out of references is taken even where a token looks worse for it, since
    the next step may need it: few wrong readings survive a strict decoder.  A legacy page decodes
    anything, so there a token must not look worse.
    """
    read_as, really, _ = step
    out, changed, now = [], False, 0.0
    if read_as == "unescape" and not any("&" in t for t in state):
        return None
    strict = really != "utf-8"
    for token, n in zip(state, weights):
        if read_as == "unescape":
            new = html.unescape(token)
        else:
            new = None if token.isascii() else _step(token, read_as, really)
        if new is not None and new != token and (read_as == "unescape" or _fits(token, new, strict)) and "\n" not in new:
            changed = True
        else:
            new = token
        out.append(new)
        now += n * implausibility(new)
        if now > limit:
            return None
    return (tuple(out), now) if changed else None


def _fits(token: str, new: str, strict: bool) -> bool:
    return implausibility(new) <= implausibility(token) + (0.0 if strict or "\ufffd" in new else len(new) * 3.0 if _SHAPE.search(new) else 0.0)


def _undominated(here: tuple[str, ...], reached: list) -> list:
    """Without the steps that do only a part of what another one does."""
    kept: list = []
    for one in sorted(reached, key=lambda r: -sum(a is not b for a, b in zip(r[2], here))):
        if not any(other[1] <= one[1] and all(a is c or a == b for a, b, c in zip(one[2], other[2], here)) for other in kept):
            kept.append(one)
    return kept


@lru_cache(maxsize=1 << 15)
def repair_tokens(state: tuple[str, ...], weights: tuple[int, ...]) -> tuple[tuple[str, ...], float, tuple[str, ...]]:
    """Cheapest reachable tokens, the gain in plausibility and the steps that lead there.

    The state is a passage's distinct tokens, most implausible first; ``weights`` say how often
    each occurs.  Steps into UTF-8 are cheap and expanded with their state; steps between legacy
    pages are dear, so each state enters the frontier a second time at their price and is expanded
    with them only if nothing cheaper is left.  The search ends when the frontier is empty or all
    that is left in it has paid as much as the best text costs; it has no other limit.  It is
    finite: every step into UTF-8 or out of references makes the text shorter, and a legacy step
    has to undo half of what can be undone (a token with a lost mark keeps one) and to beat the
    best text found so far.
    """
    start = sum(n * implausibility(t) for t, n in zip(state, weights))
    lost = sum(3.0 * n for t, n in zip(state, weights) if "\ufffd" in t)
    best, best_cost, best_path, best_odd = state, start, (), oddity(state)
    serial, seen = 0, {state: 0.0}
    frontier: list[tuple] = [(start, 0, 0.0, state, (), start, _PRICE_LEGACY, _NEAR_STEPS), (start + _PRICE_LEGACY, -1, 0.0, state, (), start, _PRICE_LEGACY, _FAR_STEPS)]
    while frontier:
        _, _, price, here, path, looks, least, steps = heapq.heappop(frontier)
        far = steps is _FAR_STEPS
        if not far and path and looks + price <= best_cost + 1e-9:
            odd = oddity(here)
            if looks + price < best_cost - 1e-9 or odd < best_odd:
                best, best_cost, best_path, best_odd = here, looks + price, path, odd
        if price + lost + (least if far else _PRICE_UTF8) > best_cost + 1e-9:
            continue
        reached: list[tuple[tuple[str, float, float], float, tuple[str, ...], float]] = []
        for step in steps:
            paid = price + step[2] + (least if far else 0.0)
            if paid + lost > best_cost + 1e-9:
                continue
            limit = min(lost + (looks - lost) / 2, looks - least, best_cost - paid) if far else float("inf")
            got = _apply(here, weights, step, limit)
            if got is not None and paid < seen.get(got[0], float("inf")):
                reached.append((step, paid, *got))
        for step, paid, there, now in reached if far else _undominated(here, reached):
            if paid >= seen.get(there, float("inf")):
                continue
            seen[there] = paid
            serial += 1
            after = least * 2 if far else least
            way = (*path, f"{step[0]}>{step[1]}".rstrip(">"))
            heapq.heappush(frontier, (now + paid, serial, paid, there, way, now, after, _NEAR_STEPS))
            if now:
                heapq.heappush(frontier, (now + paid + after, serial, paid, there, way, now, after, _FAR_STEPS))
    return best, start - best_cost, best_path


def repair_line(line: str) -> tuple[str, bool, tuple[str, ...]]:
    """The repaired line, whether it holds a wrongly decoded passage, and the steps used."""
    spans = [m.span() for m in _TOKEN.finditer(line) if not m.group().isascii() or ("&" in m.group() and _ENTITY.search(m.group()))]
    tokens = [line[a:b] for a, b in spans]
    joined = " ".join(tokens)
    if not tokens or (not any(map(implausibility, tokens)) and implausibility(joined) == 0.0):
        return line, False, ()
    times = Counter(tokens)
    state = tuple(sorted(times, key=lambda t: -implausibility(t) * times[t]))
    best, gain, path = repair_tokens(state, tuple(times[t] for t in state))
    legacy = any(not p.endswith("utf-8") and p != "unescape" for p in path)
    if path and gain >= (_GAIN_LEGACY if legacy else _GAIN_UTF8):
        out, at = [], 0
        repaired = dict(zip(state, best))
        for (a, b), old in zip(spans, tokens):
            out += [line[at:a], repaired[old]]
            at = b
        return "".join(out) + line[at:], True, path
    if "\ufffd" in line and not _NAMES_MARK.search(line) and "\ufffd" in _QUOTED_MARK.sub("", line):
        return line, True, ("lost",)
    left = sum(map(implausibility, tokens))
    if re.search("[\x80-\x84\x86-\x9f]", line) or (left >= _BEYOND_DOUBT and left >= _BEYOND_DOUBT_EACH * sum(not c.isascii() for c in joined)):
        return line, True, ("unknown",)
    return line, False, ()


def repair_text(text: str | None) -> tuple[str | None, int, str]:
    """(repaired text, lines repaired or damaged, distinct step paths)."""
    if not text:
        return text, 0, ""
    if text.isascii() and "&" not in text:
        return text, 0, ""
    out, n, paths = [], 0, set()
    for line in text.split("\n"):
        if not line.isascii() or ("&" in line and _ENTITY.search(line)):
            new, bad, path = repair_line(line)
            if bad:
                n += 1
                paths.add("|".join(path))
                line = new
        out.append(line)
    return ("\n".join(out) if n else text), n, ",".join(sorted(paths))


def repair(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Rows with a wrongly decoded passage: id, restored text, number of lines, step paths.

    One narrow stage: the JVM drops rows that are plain ASCII, the rest goes to Python in
    Arrow batches; nothing is shuffled.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]|&[#A-Za-z][A-Za-z0-9]{1,31};"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res = [(i, *repair_text(t)) for i, t in zip(pdf["id"], pdf["text"])]
            yield pd.DataFrame([r for r in res if r[2]], columns=["id", "restored", "n_lines", "steps"])

    return rows.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, restored string, n_lines bigint, steps string")


def found_ids(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Each id once that has at least one wrongly decoded passage, recoverable or not."""
    return repair(df, id_col, text_col).select("id").distinct()
