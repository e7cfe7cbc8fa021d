"""Find credentials in source and configuration text and mask them in place.

One deterministic automaton holds the token formats, key armor, connection-string, header and
command grammars and the words that name a credential.  It scans the batch's texts as
overlapping chunks; hits carry absolute offsets, so a hit in an overlap counts once.  At each
hit a local parser fixes the exact span of the secret and rejects placeholders, references and
settings; masking splices a placeholder over each span and leaves every other character alone.

Defined results: null or empty text has no credential and comes back unchanged; a text packed
twice is judged for each row, ``found_lines`` returns each (id, line) once; a key of several
lines counts at its BEGIN line; text of any length is scanned whole; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.automaton import Automaton

_B = r"[^A-Za-z0-9_]"
#: name: grammar up to where it is unmistakable, least length of a whole token. Public token formats.
_TOKENS = {
    "cloud_access_key": (r"(AKIA|ASIA|ABIA|ACCA)[A-Z0-9]", 20),
    "forge_token": (r"gh[pousr]_[A-Za-z0-9]", 34),
    "forge_fine_token": (r"github_pat_[A-Za-z0-9_]", 40),
    "forge_lab_token": (r"gl(pat|dt|rt|ft)-[A-Za-z0-9_\-]", 24),
    "chat_token": (r"xox[abeoprs]-[A-Za-z0-9]", 24),
    "payment_key": (r"[sr]k_(live|test)_[A-Za-z0-9]", 24),
    "package_token": (r"npm_[A-Za-z0-9]", 34),
    "index_token": (r"pypi-[A-Za-z0-9_\-]", 45),
    "model_hub_token": (r"hf_[A-Za-z0-9]", 33),
    "maps_key": (r"AIza[A-Za-z0-9_\-]", 39),
    "mail_key": (r"SG\.[A-Za-z0-9_\-]", 50),
    "model_key": (r"sk-[A-Za-z0-9_\-]", 35),
    "signed_token": (r"eyJ[A-Za-z0-9_\-]", 40),
    "webhook": (r"hooks\.[A-Za-z0-9.\-]+/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]", 40),
}
_WORDS = r"passw(or)?d|password|passphrase|pass_phrase|pass-phrase|passwort|kennwort|contrase(n|\xf1)a|mot_?de_?passe|senha|secret|token|pwd|pass|(api|access|secret|signing|encryption|account|private|auth|client|master|shared)[_\-. ]?key|credential|bearer|auth|pw|haslo|wachtwoord"
_GRAMMAR: list[tuple[str, str, bool]] = [
    *((name, _B + rx, False) for name, (rx, _) in _TOKENS.items()),
    ("armor", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----", False),
    ("url", r"[a-z0-9+]://[^\s/:@\"'`<>]*:[^\s/@\"'`]+@[A-Za-z0-9\[]", True),
    ("header", r"authorization\"?'?\]? ?[:=,] ?[\"'`]?(basic|bearer|token|apikey) ", True),
    ("command", _B + r"(sshpass|docker login|mysql|mysqldump|curl|wget|psql|login) ", True),
    ("assign", rf"({_WORDS})[^a-z0-9]", True),
    ("pass_line", r":[0-9*]+:", False),
]


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(_GRAMMAR, longest=512)


_TOKEN_TAIL = re.compile(r"[A-Za-z0-9_\-.]*")
_PLACEHOLDER = re.compile(
    r"""(?ix) ^(?: \$?\{ .* | \$\( .* | \$[A-Z_]\w* | %[A-Z_]\w*%? | \{\{ .* | <.* | \[.*\] | @\w+@ | \.{2,} | -+ | _+ | \*+ .* | x{3,} | .*\*{4,} .* | •+
      | (?:your|my|the|insert|enter|put|replace|change|fill|add|put)[-_ .]? \w* .* (?:here|me|key|token|secret|password|this)? | change_?me.* | example.* | .*example$ | placeholder.* | dummy.* | sample | fake.* | todo.* | tbd | redacted.* | masked.* | hidden
      | none | null | nil | undefined | true | false | yes | no | on | off | empty | required | optional | string | str | text | secret | pass(?:word|wd)? | pwd | token | test | default | user | admin | root | guest | bearer | basic
      | (?:process\.)?env[.\[(].* | os\.environ.* | os\.getenv.* | getenv.* | system\.getenv.* | vault[.:].* | secrets?[.:].* | var\..* | local\..* | data\..* | config[.\[].* | settings[.\[].* | self\..* | this\..* | args?\..* | options?\..* | file://.* | enc\[.* )$"""
)
_SECRET_LAST = frozenset("password passwd passwort passphrase kennwort contrasena contraseña passe senha secret token pwd pass pw bearer authtoken apikey haslo wachtwoord accesstoken refreshtoken accesskey secretkey privatekey".split())
_KEY_BEFORE = frozenset("api access secret signing encryption account private auth client master shared".split())
_IDENT_LEFT = re.compile(r"[A-Za-z0-9_.\-\xc0-\xff]*")  # of the text backwards
_IDENT_RIGHT = re.compile(r"[A-Za-z0-9_\-\xc0-\xff]*")
_AFTER = re.compile(
    r"""(?x) (?P<close> ["'`\])]* ) (?: \s* : \s* &?(?:'static\s+)? (?:str|String|string|text|Text|&str)\b )?
        (?: [ \t]* (?: := | => | = | : | , ) [ \t]* | [ \t]+ (?:is|lautet|est|es|:) [ \t]+ | [ \t]+ )
        (?P<q> [bru]?["'`] | @" )? """
)
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z\xdf-\xff]+|\d+")
_JOINED = re.compile(r"""["'`]\s*[+.]?\s*["'`]""")
_BARE, _BARE_IN_QUERY = re.compile(r"[^\s\"'`,;)\]}<]*"), re.compile(r"[^\s\"'`,;)\]}&]*")
_SETTING = re.compile(r"\s*(?:#define|ENV|set |setenv)")
_FIRST_CELL = re.compile(r"\s*\"?")
_CODE_VALUE = re.compile(r"^[A-Za-z_][\w.]*[\[(]|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$|^&|^\*\w|^function|^lambda|^new$")


# single words that settings about credentials have for values
_NO_SECRETS = frozenset("disabled enabled inherit prompt string boolean number object username unknown internal external private public hashed plain plaintext encrypted rotated expired manual automatic bcrypt argon scrypt pbkdf keychain keyring vault stdin interactive session cookie header oauth openid bearer digest static dynamic".split())


def _placeholder(value: str) -> bool:
    bare = value.strip("\"'`")
    return bool(_PLACEHOLDER.match(bare)) or len(set(bare)) <= 2 or "EXAMPLE" in bare or "${" in bare or "{{" in bare


def _decoded(value: str) -> str | None:
    try:
        raw = base64.b64decode(value, validate=True)
        text = raw.decode("utf-8")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return None
    return text if text and text.isprintable() else None


def _random_like(value: str) -> bool:
    """Whether an unquoted word looks made up: digits beside letters, or mixed case inside."""
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    if letters and digits:
        return True
    inner = value[1:]
    return letters and any(c.isupper() for c in inner) and any(c.islower() for c in value)


def _usable(value: str, quoted: bool, name: str) -> bool:
    if len(value) < 6 or _placeholder(value) or value.lower() == name.lower() or "://" in value or value.startswith("data:"):
        return False
    if quoted:
        value = _JOINED.sub("", value)
    if any(c.isspace() for c in value):
        return False
    if quoted:
        return not re.fullmatch(r"[a-z]+(?:[-_. ][a-z]+)+|[A-Z]+(?:[_ ][A-Z]+)+|\d{1,5}|[\d.]+", value) and value.lower() not in _NO_SECRETS
    if _CODE_VALUE.match(value):
        return False
    return _random_like(value) and not re.fullmatch(r"[\d.,]+|[A-Z][a-z]+|[A-Z]+(?:_[A-Z0-9]+)+|[a-z]+(?:[A-Z][a-z]+)+", value)


def _names_secret(name: str) -> bool:
    words = [w.lower() for part in re.split(r"[_.\-\s]+", name) for w in _CAMEL.findall(part)]
    if not words:
        return False
    last = words[-1]
    if last.isdigit() and len(words) > 1:
        words, last = words[:-1], words[-2]
    if last == "key":
        return len(words) > 1 and words[-2] in _KEY_BEFORE
    if last in ("phrase",):
        return len(words) > 1 and words[-2] == "pass"
    if last == "auth":
        return False
    joined = "".join(words[-2:])
    return last in _SECRET_LAST or joined in _SECRET_LAST


def _line(text: str, at: int) -> tuple[int, int]:
    a = text.rfind("\n", 0, at) + 1
    b = text.find("\n", at)
    return a, len(text) if b < 0 else b


def _name_start(text: str, a: int, end: int) -> int:
    """Where the identifier that ends at ``end`` begins; ``a`` is its line's start."""
    width = 128
    while True:
        low = max(a, end - width)
        n = _IDENT_LEFT.match(text[low:end][::-1]).end()
        if n < end - low or low == a:
            return end - n
        width *= 8


def _after_login(text: str, a: int, left: int) -> bool:
    """Whether nothing, or a keyword of a login file and its value, stands before on the line."""
    words = text[a:left].rsplit(None, 2)
    return not words or (len(words) > 1 and words[-2].endswith(("machine", "login", "default")))


def _after_comma(text: str, a: int, left: int) -> bool:
    if left > a and text[left - 1] == '"':
        left -= 1
    while left > a and text[left - 1].isspace():
        left -= 1
    return left > a and text[left - 1] == ","


def _assign(text: str, at: int, known: tuple[int, int] = (0, 0)) -> tuple[int, int, str] | None:
    """``at`` is just after the credential word and one more character; ``known`` is the assigned secret found last."""
    a, b = _line(text, at - 1)
    word_end = at - 1
    right = _IDENT_RIGHT.match(text, word_end, b).end()
    left = _name_start(text, a, word_end)
    name = text[left:right]
    is_auth = name.lower() in ("auth", "_auth") and text[left - 1 : left] in "\"'/: \t\n"
    if not (_names_secret(name) or is_auth):
        return None
    m = _AFTER.match(text, right, b)
    if not m:
        return None
    sep = text[m.end("close") : m.start("q") if m["q"] else m.end()].strip()
    start = m.end()
    if m["q"]:
        quote = m["q"][-1]
        end = text.find(quote, start, b)
        if end < 0:
            return None
        value = text[start:end]
    else:
        if m["close"] and not sep:
            return None
        in_query = left > 0 and text[left - 1] in "?&"
        if not in_query and known[0] <= start < known[1]:
            return None  # it would end with the secret that it is a part of
        value = (_BARE_IN_QUERY if in_query else _BARE).match(text, start, b)[0]
        if value.startswith("{") or text[start : start + 2] in ("{{", "${"):
            return None
        end = start + len(value)
        if not sep and not (name.lower() in ("password", "passwd", "token") and _after_login(text, a, left)) and not _SETTING.match(text, a, left):
            return None
        if sep == "," and not _FIRST_CELL.fullmatch(text, a, left) and not _after_comma(text, a, left):
            return None
    if is_auth:
        plain = _decoded(value)
        return (start, end, "encoded_login") if plain and ":" in plain and not _placeholder(plain.partition(":")[2]) else None
    return (start, end, "assigned_secret") if _usable(value, bool(m["q"]), name) else None


#: command, and the option of its line that carries the login; None where it follows at once
_COMMANDS = (
    (re.compile(r"sshpass\s+(?:-\w+\s+)*-p\s*(['\"]?)(?P<v>[^\s'\"]+)\1"), None),
    (re.compile(r"docker login\s"), re.compile(r"(?=(?:-p|--password)[ =](['\"]?)(?P<v>[^\s'\"]+)\1)")),
    (re.compile(r"mysql(?:dump)?\s"), re.compile(r"(?=(?:-p|--password=)(['\"]?)(?P<v>[^\s'\"]+)\1)")),
    (re.compile(r"(?:curl|wget)\s"), re.compile(r"(?=(?:-u|--user)[ =]?(['\"]?)[^\s:'\"]+:(?P<v>[^\s'\"]+)\1)")),
    (re.compile(r"(?:wget|psql)\s"), re.compile(r"(?=--password[ =](['\"]?)(?P<v>[^\s'\"]+)\1)")),
    (re.compile(r"\blogin\s+\S{2,40}\s+/\s+()(?P<v>\S+)"), None),
)


@lru_cache(maxsize=4)
def _logins(text: str, a: int, b: int) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """For each form of command on the line: where commands begin, and the span of each one's login.

    A line is searched once for all its hits, so its length costs no more than its reading.
    """
    out = []
    for command, option in _COMMANDS:
        found = list(command.finditer(text, a, b))
        logins = list(option.finditer(text, a, b)) if option else found
        at = [m.start() for m in logins]
        place = [bisect_left(at, m.end()) for m in found] if option else range(len(found))
        pairs = [(m.start(), logins[k].span("v")) for m, k in zip(found, place) if k < len(logins)]
        out.append(([p for p, _ in pairs], [v for _, v in pairs]))
    return out


_HEADER_VALUE = re.compile(r"[A-Za-z0-9+/_=.\-~]+")
_BODY = re.compile(r"(?:\\[rn]|[A-Za-z0-9+/=\s\"',#*;:>|.\-]++)*+")
_ARMOR_FIELDS = re.compile(r"\s*(?:[A-Za-z-]+: [^\n]*\n)*")
_KEY_LINES = re.compile(r"[A-Za-z0-9+/=]*(?:(?:\\[rn]|[\s\"'+,#*;>|])++[A-Za-z0-9+/=]{32,})*+")
_NEAR_END = 20_000  # an END line nearer than this closes the block whatever lies between
_ARMOR_END = re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")


def _token_start(kind: str, text: str, a: int, at: int) -> int | None:
    """Where the first token in the text from ``a`` begins that reaches ``at``."""
    m = _token_rx(kind).search(text, a, at)
    while m and m.end() != at:
        m = _token_rx(kind).search(text, m.start() + 1, at)
    return m.start() if m else None


def _resolve(kind: str, text: str, at: int, relative: str, known: tuple[int, int]) -> tuple[int, int, str] | None:
    if kind in _TOKENS:
        start = _token_start(kind, text, max(0, at - 520), at)
        if start is None and at > 520:
            start = _token_start(kind, text, _line(text, at - 1)[0], at)
        if start is None:
            return None
        end = _TOKEN_TAIL.match(text, at).end()
        value = text[start:end].rstrip(".-")
        if len(value) < _TOKENS[kind][1] or (kind == "signed_token" and value.count(".") != 2):
            return None
        if len(set(value[6:])) < 5 or _placeholder(value):
            return None
        return start, start + len(value), kind
    if kind == "armor":
        start = text.rfind("-----BEGIN", 0, at)
        m = _ARMOR_END.search(text, at, at + _NEAR_END)
        if not m:  # a longer key holds nothing but the lines of a key
            m = _ARMOR_END.search(text, at, _BODY.match(text, _ARMOR_FIELDS.match(text, at).end()).end())
            m = None if m and text.find("-----BEGIN", at, m.start()) >= 0 else m
        body_end = m.start() if m else _BODY.match(text, at, at + _NEAR_END).end()
        if body_end == at + _NEAR_END and not m:
            body_end = _KEY_LINES.match(text, body_end).end()
        body = re.sub(r"\\[nr]", "", text[at:body_end])
        solid = re.sub(r"[^A-Za-z0-9+/=]", "", body)
        if len(solid) < 30 or len(set(solid)) < 10:
            return None
        return start, m.end() if m else body_end, "private_key"
    if kind == "url":
        a = text.rfind("://", 0, at)
        at_sign = at - 2
        colon = text.find(":", a + 3, at_sign)
        value = text[colon + 1 : at_sign]
        if colon < 0 or len(value) < 4 or _placeholder(value):
            return None
        return colon + 1, at_sign, "url_password"
    if kind == "header":
        m = _HEADER_VALUE.match(text, at)
        if not m or len(m[0]) < 8 or _placeholder(m[0]) or not _random_like(m[0]):
            return None
        plain = _decoded(m[0]) if text[at - 6 : at].lower() == "basic " else None
        if plain and ":" in plain and _placeholder(plain.partition(":")[2]):
            return None
        return m.start(), m.end(), "header"
    if kind == "command":
        a, b = _line(text, at - 1)
        for begun, spans in _logins(text, a, b):
            k = bisect_left(begun, at - 20)
            if k < len(spans):
                value = text[slice(*spans[k])]
                if len(value) >= 5 and not _placeholder(value) and not value.startswith("$"):
                    return *spans[k], "command"
        return None
    if kind == "pass_line":  # host:port:database:user:password, in the files that are made of such lines
        m = _PASSWORD_LINE.match(text, _line(text, at - 1)[0]) if "pgpass" in relative.rsplit("/", 1)[-1] else None
        return (*m.span(1), "password_file") if m and len(m[1]) >= 4 and not _placeholder(m[1]) else None
    return _assign(text, at, known)


_PASSWORD_LINE = re.compile(r"[^\s:#]+:[\d*]+:[^\s:]+:[^\s:]+:(\S+)")


@lru_cache(maxsize=64)
def _token_rx(kind: str) -> re.Pattern[str]:
    return re.compile(r"(?<![A-Za-z0-9_])(?:" + _TOKENS[kind][0] + ")")


def find_in_texts(texts: list[str | None], relatives: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of each text, sorted and free of overlaps."""
    auto = automaton()
    starts, parts, at = [], [], 0
    for t in texts:
        parts.append(b"\n" + (t or "").encode("latin-1", "replace") + b"\n\x00")
        starts.append(at + 1)
        at += len(parts[-1])
    raw: list[dict[tuple[int, int], str]] = [{} for _ in texts]
    known = [(0, 0)] * len(texts)
    for end, mask in auto.scan(b"".join(parts)):
        k = bisect_right(starts, end - 1) - 1
        if k < 0:
            k = 0
        text, here = texts[k] or "", end - starts[k]
        if here > len(text) + 1:
            continue
        bit = 0
        while mask:
            if mask & 1:
                got = _resolve(auto.names[bit], text, here, relatives[k] or "", known[k])
                if got:
                    if got[2] == "assigned_secret":
                        known[k] = got[:2]
                    raw[k].setdefault(got[:2], got[2])
            mask >>= 1
            bit += 1
    out = []
    for spans in raw:
        merged: list[list] = []
        for (a, b), kind in sorted(spans.items(), key=lambda s: (s[0][0], -s[0][1])):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, kind])
        out.append([tuple(m) for m in merged])
    return out


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with a placeholder over each span; every other character stays."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _batches(texts: list[str | None], limit: int = 8 << 20) -> Iterator[range]:
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield range(a, k + 1)
            a, size = k + 1, 0
    if a < len(texts):
        yield range(a, len(texts))


def scan(df: DataFrame, id_col: str = "id", text_col: str = "text", path_col: str = "relative", masked: bool = True) -> DataFrame:
    """Rows that hold a credential: id, findings (line_no, start, length, kind), masked text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("relative")).where(F.length("text") > 0)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ids, texts, rels = pdf["id"].tolist(), pdf["text"].tolist(), pdf["relative"].tolist()
            for part in _batches(texts):
                found = find_in_texts([texts[k] for k in part], [rels[k] for k in part])
                out = []
                for k, spans in zip(part, found):
                    if spans:
                        text = texts[k]
                        lines, n, at = [], 1, 0
                        for a, b, kind in spans:
                            n += text.count("\n", at, a)
                            at = a
                            lines.append({"line_no": n, "start": a, "length": b - a, "kind": kind})
                        out.append((ids[k], lines, mask(text, spans) if masked else None))
                yield pd.DataFrame(out, columns=["id", "findings", "masked"])

    id_type = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {id_type}, findings array<struct<line_no:bigint,start:bigint,length:bigint,kind:string>>, masked string")


def found_lines(df: DataFrame, id_col: str = "id", text_col: str = "text", path_col: str = "relative") -> DataFrame:
    """Each (id, line_no) once on which a usable credential begins."""
    return scan(df, id_col, text_col, path_col, masked=False).select("id", F.explode("findings.line_no").alias("line_no")).distinct()
