"""Which source files were not written by hand: generated, minified, vendored, data as code.

Linear support-vector classifiers on hashed features decide, and nothing else does:

* one judges a file by the character 4-grams of its text, as they are and with all letters of a
  case alike (which shows random and minified text by its shape), and the components, words and character
  4-grams of its path; giveaway lines (tool markers, notices) are masked in its text, in training
  and in scoring alike, so it finds what the text itself and its place show;
* one judges comment lines by their character 4-grams, the own project's name replaced, and finds
  the giveaway lines, which some files have as the only difference from hand-written ones;
* one judges an entry that has no text by its path alone.

A file's score is the larger of its own and of its best comment line's.  There are no labels, so
patterns of evidence, and paragraphs that several projects of the sample share, label a bounded
sample: files with evidence are positives, files with none negatives, files with nothing but a giveaway line are left to the second classifier.  Projects are
split between training and validation by their hash; ``validation`` reports what the classifiers
find among all files of projects that the fit has not seen, by kind.

The texts are read twice, for the sample and for the scores; features are made where a text is
read and reduced to one number a file at once, so only narrow rows are shuffled.

Defined results: a manifest entry without packed text is judged by its path alone; null paths
and texts count as empty; repeated rows are one entry; prose, plain data and binary files are
never candidates (a lock or map file is); files of any length are read whole; a tool's marker
counts on every comment line of the file, but not inside a string literal or here-document.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.plans.shared import materialized

BITS = 17
DIM = 1 << BITS
MIN_ROOTS = 2  # a paragraph in so many projects of the sample is a copy
SAMPLE, SEED = 6_000, 17  # most labelled files that the fit may see, and their choice
SAME_LINES, SAMPLE_LINES = 30, 20_000  # most training lines of one wording, and of each label

# ---- evidence (fixed values: names and phrases tools write) --------------------------------
_TOOL_FILES = re.compile(
    r"(?:^|/)(?:[\w.-]+\.lock|go\.sum|package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|composer\.lock|yarn\.lock|Pipfile\.lock|[\w.-]+\.tsbuildinfo|[\w.-]+\.(?:js|css|ts|mjs)\.map)(?:\.[\w]+)?$"
)
_CODE = frozenset("py pyi js mjs cjs jsx ts tsx rs go java kt kts c h cc cpp cxx hpp cs rb php swift scala lean sql sh bash zsh ps1 css scss less lua pl pm r jl ex exs erl hs ml fs dart vue svelte m mm vb asm s proto".split())
_WEB = frozenset("js mjs cjs jsx css ts".split())
_COMMENT = re.compile(r"^\s*(?:/\*+!?|//+!?|#+!?|--+|<!--|;+|%+|\*+|\"\"\"|''')\s?")
_MARKER = re.compile(
    r"""(?ix) ^ \W* (?: code\ generated\ (?:by|from) | @generated\b | <auto-?generated | auto-?generated\ (?:file|by|from|code|\W|$) | (?:this\ (?:file|code)\ (?:is|was|has\ been)\ )? automatically\ (?:generated|produced|created|written)
      | this\ (?:file|code)\ (?:is|was|has\ been)\ (?:auto-?)?(?:generated|produced|written)\ (?:by|from|with) (?!\ hand) | created\ (?:with|by)\ \S+.*(?:overwritten|lost) | !!\ *output\ of | output\ of\ \S+.*!! | machine-?\ ?(?:written|generated|made) | generated\ (?:from|by|with)\ (?!hand\b|our\b|us\b)\S+ | do\ not\ (?:edit|modify)\W*(?:$|\W*(?:this|manually|by\ hand|generated)) 
      | (?:fichier|code)\ g[ée]n[ée]r[ée] | (?:ce\ fichier\ (?:a\ [ée]t[ée]|est)\ g) | (?:datei|code)?\ ?(?:automatisch|maschinell)\ (?:erzeugt|generiert|erstellt) | (?:diese\ datei\ (?:wurde|ist)\ (?:automatisch\ )?(?:erzeugt|generiert)) | (?:generierte|erzeugte)\ datei | (?:archivo|fichero|c[óo]digo)\ (?:autogenerado|generado) | generado\ (?:por|autom) | (?:arquivo|ficheiro|c[óo]digo)\ gerado | gerado\ (?:por|autom) | (?:plik|kod)\ wygenerowan | wygenerowan[oy] | сгенерирован | автоматически\ с | 自动生成 | 自動生成 | ここは自動 )"""
)
_OWN_WORK = re.compile(r"(?i)by hand|by us\b|our template")
_HASH = frozenset("py pyi rb sh bash zsh ps1 php pl pm r jl ex exs".split())
_DASH = frozenset("sql lua hs lean".split())
_HEREDOC = frozenset("sh bash zsh rb php pl pm".split())
_OPEN_QUOTES = frozenset("sh bash zsh rb php pl pm ps1 r jl ex exs rs sql lua".split())  # "..." may hold line breaks
_PEM_BEGIN, _PEM_END = re.compile(r"-----BEGIN [A-Z0-9 ]+-----"), re.compile(r"-----END [A-Z0-9 ]+-----")
_ANYWHERE = re.compile(r"(?i)edits get overwritten|changes will be lost|\bdo not (?:edit|modify|change)\b|\bne pas modifier\b|\bnicht (?:bearbeiten|ändern|editieren)\b|\bno (?:editar|modificar)\b|\bnão (?:editar|modificar)\b")
_NOTICE = re.compile(
    r"""(?ix) \(c\)\ (?:\d{4}[\d,\ -]*)?the\ (?P<a>[\w.-]+)\ (?:contributors|authors|project|developers|team)\b | copyright\ (?:\(c\)\ )?(?:\d{4}[\d,\ -]*)?(?:by\ )?(?:the\ )?(?P<b>[\w.-]+)\ (?:contributors|authors|project|developers)\b
      | part\ of\ the\ (?P<c>[\w.-]+)\ (?:distribution|project|library|package) | ^\W*(?P<d>[\w.-]+)\ --\ upstream\b | ^\W*(?P<e>[A-Za-z][\w.-]+)\ v?\d+\.\d+(?:\.\d+)?\W*$ | vendored\ from\ (?P<f>[\w./-]+) | upstream:?\ (?P<g>[\w.-]+)"""
)
_DATA_LINE = re.compile(r"""(?x) ^\s*["'b]*(?: (?:0x[0-9a-fA-F]{2}[,\s]*){6,} | (?:\\x[0-9a-fA-F]{2}){6,} | [A-Za-z0-9+/]{48,}={0,2} | (?:\d{1,3},\s*){10,}\d* | [0-9a-fA-F]{48,} | (?:-?\d+\.\d+(?:e-?\d+)?,\s*){6,}\S* ) ["'\\,;+\s.\])]* $""")


_NUMBERS = re.compile(r"(?:[\[({]?\s*-?(?:0x[0-9A-Fa-f]+|\d+(?:\.\d+)?)[\])}]?,\s*){16,}")


@dataclass(frozen=True)
class Evidence:
    marker: bool
    foreign: bool
    tool_file: bool
    minified: bool
    data: float
    regular: float
    candidate: bool
    body: str  # the text without its giveaway lines
    given_away: tuple[int, ...]  # lines that say it

    @property
    def kind(self) -> str:
        """What the evidence says; '' if there is none."""
        if not self.candidate:
            return ""
        named = (("tool_file", self.tool_file), ("vendored", self.foreign), ("minified", self.minified), ("data", self.data > 0.5), ("generated", self.regular > 0.8), ("marked", self.marker))
        return next((k for k, v in named if v), "")

    @property
    def strong(self) -> bool:
        return self.kind != ""


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    parts = name.split(".")
    for p in reversed(parts[1:]):
        if p in _CODE:
            return p
    return parts[-1] if len(parts) > 1 else ""


def _marks(comment: str) -> bool:
    return bool(_MARKER.match(comment)) and not _OWN_WORK.search(comment.replace("modify by hand", "").replace("edit by hand", ""))


@lru_cache(maxsize=64)
def _syntax(ext: str) -> re.Pattern[str]:
    """Comments (c), triple-quoted texts (t) and other literals of a language, as far as they hide line starts from each other."""
    comment = [r"<!--.*?(?:-->|\Z)"]
    if ext in _HASH:
        comment += [r"(?<![^\s;)\]}])\#[^\n]*"]
    if ext in _DASH:
        comment += [r"--\[(?P<eq>=*)\[.*?(?:\](?P=eq)\]|\Z)", r"--[^\n]*", r"/-.*?(?:-/|\Z)", r"\{-.*?(?:-\}|\Z)"]
    if ext not in _HASH | _DASH or ext == "php":
        comment += [r"//[^\n]*", r"^[ \t]*(?:\#+!?|;+|%+|--+)[^\n]*"]
    if ext not in _HASH or ext == "php":
        comment += [r"/\*.*?(?:\*/|\Z)", r"\(\*\s.*?(?:\*\)|\Z)"]
    literal = [r"R\"(?P<d>\w*)\(.*?\)(?P=d)\"", r"r(?P<h>\#+)\".*?\"(?P=h)", r"'(?:\\.|[^'\\\n])'"]
    if ext in _HEREDOC:
        literal += [r"<<<?[-~]?[ \t]*(?P<q>[\"']?)(?P<w>[A-Za-z_]\w*)(?P=q)[^\n]*\n.*?^[ \t]*(?P=w)\b"]
    if ext in _WEB or ext in ("tsx", "go", "vue", "svelte"):
        literal += [r"`(?:\\.|[^`\\])*`"]
    if ext in _OPEN_QUOTES:
        literal += [r"\"(?:\\.|[^\"\\])*\"", r"'(?:\\.|[^'\\])*'"] if ext != "rs" else [r"\"(?:\\.|[^\"\\])*\""]
    literal += [r"\"(?:\\.|[^\"\\\n])*\"", r"'(?:\\.|[^'\\\n])*'"]
    return re.compile("(?sm)(?P<c>" + "|".join(comment) + r")|(?P<t>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|(?:" + "|".join(literal) + ")")


def _comment_lines(text: str, ext: str) -> set[int]:
    """Numbers of the lines that begin in a comment, or in a docstring that only comments precede."""
    starts = [m.start(1) for m in re.finditer(r"(?m)^[^\S\n]*(\S|$)", text)]
    out: set[int] = set()
    at, code = 0, False
    for m in _syntax(ext).finditer(text):
        code = code or bool(text[at : m.start()].strip())
        at = m.end()
        if m["c"] or (m["t"] and not code):
            out.update(range(bisect_left(starts, m.start()), bisect_left(starts, at)))
        else:
            code = True
    return out


def _without_keys(text: str) -> str:
    """The text without what stands between BEGIN and END lines; one pass."""
    out, at = [], 0
    while (m := _PEM_BEGIN.search(text, at)) and (end := _PEM_END.search(text, m.end())):
        out.append(text[at : m.start()])
        at = end.end()
    return "".join(out) + text[at:]


def evidence(path: str, text: str) -> Evidence:
    tool_file = bool(_TOOL_FILES.search(path))
    ext = extension(path)
    code = ext in _CODE
    lines = text.split("\n")
    own = re.sub(r"[^a-z0-9]+", "", path.split("/", 1)[0].lower())
    marker = foreign = False
    hidden: set[int] = set()
    told: set[int] = set()
    seen = 0
    for k, line in enumerate(lines):
        if seen >= 12 or k >= 30:
            break
        if not line.strip():
            continue
        seen += 1
        m = _COMMENT.match(line)
        if not m:
            if k > 2:
                break
            continue
        rest = line[m.end() :]
        if _marks(rest):
            marker = True
            hidden.add(k)
            told.add(k)
        elif n := _NOTICE.search(rest):
            holder = re.sub(r"[^a-z0-9]+", "", next(g for g in n.groups() if g).lower())
            hidden.add(k)
            if holder != own and holder not in own:
                foreign = True
                told.add(k)
        elif _ANYWHERE.search(rest) or re.search(r"(?i)licen[cs]e|redistribution|copyright", rest):
            hidden.add(k)
    if code or tool_file:  # a marker may also stand past the header, mostly at the end
        far = [k for k, line in enumerate(lines) if k not in hidden and _marks(line[m.end() :] if (m := _COMMENT.match(line)) else line)]
        if far and (far := _comment_lines(text, ext).intersection(far)):
            marker = True
            hidden |= far
            told |= far
    body = "\n".join(x for k, x in enumerate(lines) if k not in hidden) if hidden else text
    data = regular = 0.0
    minified = False
    if code:
        if "-----BEGIN" in text:
            lines = _without_keys(text).split("\n")
        sizes = list(map(len, lines))
        solid = sum(sizes) or 1
        data = sum(n for n, x in zip(sizes, lines) if n > 20 and (x.count(",") > 5 or "\\x" in x or x.strip("\"' \t\\+;,").count(" ") == 0) and _DATA_LINE.match(x)) / solid
        if data <= 0.5 and text.count(",") * 12 > len(text):
            data = max(data, sum(len(m) for m in _NUMBERS.findall(text)) / solid)
        if ext in _WEB and max(sizes) > 400:
            minified = sum(n for n in sizes if n > 300) > 0.6 * solid and text.count(" ") < 0.08 * solid
        if len(lines) >= 12:
            shapes = Counter(filter(None, map(str.strip, re.sub(r"\d+", "0", "\n".join(lines)).split("\n"))))
            n = sum(shapes.values())
            regular = max(shapes.values(), default=0) / n if n >= 12 else 0.0
    return Evidence(marker, foreign, tool_file, minified, data, regular, code or tool_file, body, tuple(sorted(told)))


# ---- hashed features -------------------------------------------------------------------------
_P = np.uint64(0x9E3779B97F4A7C15)
_SAME_DIGIT = bytes.maketrans(b"123456789", b"000000000")
_SAME_CASE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz123456789", b"A" * 26 + b"a" * 26 + b"000000000")
PATH_WEIGHT, SHAPE_WEIGHT, BIAS = 0.3, 1.0, 0.5


def _grams(raw: bytes, alike: bytes = _SAME_DIGIT) -> np.ndarray:
    """Hashed 4-grams of bytes, all digits alike, by place."""
    a = np.frombuffer(raw.translate(alike), np.uint8).astype(np.uint64)
    if len(a) < 4:
        return np.empty(0, np.int64)
    g = a[:-3] | (a[1:-2] << np.uint64(8)) | (a[2:-1] << np.uint64(16)) | (a[3:] << np.uint64(24))
    with np.errstate(over="ignore"):
        g = (g * _P) >> np.uint64(64 - BITS)
    return g.astype(np.int64)


def _name(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) & (DIM - 1)


def path_vector(path: str, weight: float = PATH_WEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Folders and their words, extensions, words and 4-grams of the name; the project's own folder
    aside.  ``weight``: beside the text, or 1 where the path is all there is."""
    parts = [re.sub(r"\d", "0", p) for p in path.lower().split("/")]
    folders, stem = parts[1:-1], parts[-1]
    names = [f"P/{p}" for p in folders] + [f"P/{w}" for p in folders for w in re.split(r"[^a-z0-9]+", p) if w]
    names += [f"F/{x}" for x in stem.split(".")[1:]] + [f"W/{w}" for w in re.split(r"[^a-z0-9]+", stem) if w]
    ended = f"^{stem}$"
    names += [f"G/{ended[i : i + 4]}" for i in range(len(ended) - 3)]
    return np.array([_name(n) for n in names], np.int32), np.full(len(names), weight / max(1, len(names)) ** 0.5, np.float32)


def text_vector(body: str) -> tuple[np.ndarray, np.ndarray]:
    raw = body.encode("utf-8", "replace")
    idx, n = np.unique(_grams(raw), return_counts=True)
    val = 1.0 + np.log(n)
    shapes, m = np.unique(_grams(raw, _SAME_CASE) ^ 0x5A5A, return_counts=True)
    share = np.sqrt(m)
    return np.concatenate([idx, shapes]).astype(np.int32), np.concatenate([val / (np.linalg.norm(val) or 1.0), SHAPE_WEIGHT * share / (np.linalg.norm(share) or 1.0)]).astype(np.float32)


_OWN = "\x01\x02\x03\x04\x05\x06"


def _plain_lines(text: str, path: str) -> list[str]:
    """Lines as the second classifier sees them: stripped, lower case, the project's name replaced."""
    low = text.lower()
    own = path.split("/", 1)[0].lower()
    if len(own) > 3:
        low = low.replace(own, _OWN)
    return list(map(str.strip, low.split("\n")))


def line_vector(line: str) -> tuple[np.ndarray, np.ndarray]:
    g = _grams(line.encode("utf-8", "replace"))
    idx, n = np.unique(g, return_counts=True)
    return idx.astype(np.int32), (n / max(1, len(g)) ** 0.5).astype(np.float32)


@dataclass
class Weights:
    """Of one classifier."""

    w: np.ndarray
    bias: float

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return float(self.w[idx] @ val) + self.bias

    def lines(self, lines: list[str]) -> np.ndarray:
        """The score of every line, all lines at once."""
        raw = "\n".join(lines).encode("utf-8", "replace")
        g = _grams(raw)
        out = np.full(len(lines), self.bias)
        if len(g):
            line = np.cumsum(np.frombuffer(raw, np.uint8) == 10)
            a = np.frombuffer(raw, np.uint8)
            whole = (line[: len(g)] == line[3:]) & (a[: len(g)] != 10)
            line = line[: len(g)][whole]
            total, n = np.bincount(line, self.w[g[whole]], len(lines)), np.bincount(line, minlength=len(lines))
            out += total / np.sqrt(np.maximum(n, 1))
        return out


def fit_linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = SEED) -> Weights:
    """L2-regularised hinge loss by dual coordinate descent, both labels of equal weight."""
    w, alpha, bias = np.zeros(DIM), np.zeros(len(rows)), 0.0
    q = np.array([float(v @ v) + BIAS * BIAS for _, v in rows])
    most = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            g = y[i] * (float(w[idx] @ val) + BIAS * bias) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                np.add.at(w, idx, step * val)
                bias += BIAS * step
                alpha[i] = new
    return Weights(w, BIAS * bias)


# ---- Spark -------------------------------------------------------------------------------------

#: Paths that can hold code or a tool's file; decided in the JVM before any text goes to Python.
_CANDIDATE_PATH = r"(?i)\.(?:" + "|".join(sorted(_CODE)) + r"|lock|sum|json|map|tsbuildinfo|yaml)(?:\.[A-Za-z0-9]+)?$"


def _candidates(packed: DataFrame) -> DataFrame:
    return packed.where(F.col("status") == "extracted").where(F.col("relative").rlike(_CANDIDATE_PATH))


def _texts(packed: DataFrame) -> DataFrame:
    return _candidates(packed).where(F.col("text").isNotNull())


def held_out(root: str | None) -> bool:
    """A fifth of the projects is kept for validation."""
    return xxhash.xxh64_intdigest(root or "") % 5 == 0


@dataclass
class Model:
    files: Weights
    comments: Weights
    paths: Weights

    def judge(self, path: str, text: str | None, e: Evidence) -> float:
        """Above 0: not written by hand.  Without its text a file is judged by its path."""
        if text is None:
            return self.paths.score(*path_vector(path, 1.0))
        idx, val = path_vector(path)
        t_idx, t_val = text_vector(e.body)
        best = self.files.score(np.concatenate([idx, t_idx]), np.concatenate([val, t_val]))
        by_line = self.comments.lines(_plain_lines(text, path))
        told = np.flatnonzero(by_line > max(best, 0.0))
        if len(told):
            inside = _comment_lines(text, extension(path))
            best = max([best, *(float(by_line[k]) for k in told if int(k) in inside)])
        return best


def _blocks(body: str) -> list[int]:
    """Hashes of the paragraphs of code, comments and short lines aside."""
    out = set()
    for block in body.replace("\r", "").split("\n\n"):
        if len(block) >= 60:
            lines = map(str.strip, block.split("\n"))
            solid = "\n".join(x for x in lines if x and x.isascii() and not x.startswith(("//", "#", "--", "/*", "*")))
            if len(solid) >= 60:
                out.add(xxhash.xxh64_intdigest(solid) - (1 << 63))
    return list(out)


def _copies(roots: list[str | None], blocks: list[list[int]]) -> list[bool]:
    """Which files of the sample share most of their blocks with files of other projects in it."""
    where: dict[int, set[str | None]] = defaultdict(set)
    for root, own in zip(roots, blocks):
        for b in own:
            where[b].add(root)
    return [bool(own) and sum(len(where[b]) >= MIN_ROOTS for b in own) * 2 >= len(own) for own in blocks]


def _examples(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features, kind and training lines of the sample's files."""
    for pdf in it:
        out = []
        for i, root, rel, text in zip(pdf["id"], pdf["root_id"], pdf["relative"], pdf["text"]):
            e = evidence(rel, text)
            if not e.candidate:
                continue
            lines = _plain_lines(text, rel)
            given = [lines[k] for k in e.given_away]
            # lines of code seldom, comment lines past the header now and then: as counter-examples
            rest = [x for k, x in enumerate(lines) if x and k not in e.given_away and xxhash.xxh64_intdigest(x) % ((1 if k < 12 else 8) if _COMMENT.match(x) else 32) == 0]
            p_idx, p_val = path_vector(rel)
            idx, val = text_vector(e.body)
            out.append((i, root, e.kind, _blocks(e.body), p_idx, p_val, idx, val, given, rest))
        yield pd.DataFrame(out, columns=["id", "root_id", "kind", "blocks", "p_idx", "p_val", "idx", "val", "given", "rest"])


def fit(packed: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Fit on about ``sample`` files of projects not held out, chosen by the hash of their id."""
    n = _candidates(packed).count()
    share = min(1.0, sample / max(1, n))
    chosen = _texts(packed).where(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    known = chosen.select("id", "root_id", "relative", "text").mapInPandas(lambda it: (pdf[[not held_out(r) for r in pdf["root_id"]]] for pdf in it), "id string, root_id string, relative string, text string")
    schema = "id string, root_id string, kind string, blocks array<bigint>, p_idx array<int>, p_val array<float>, idx array<int>, val array<float>, given array<string>, rest array<string>"
    got = known.mapInPandas(_examples, schema).toArrow().combine_chunks()

    def lists(column: str) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and values of a list column, without a copy a row."""
        a = got[column].combine_chunks() if got.num_rows else None
        return (a.offsets.to_numpy(), a.values.to_numpy()) if a is not None else (np.zeros(1, np.int32), np.empty(0))

    columns = {c: lists(c) for c in ("p_idx", "p_val", "idx", "val")}

    def cell(column: str, r: int) -> np.ndarray:
        at, values = columns[column]
        return values[at[r] : at[r + 1]]

    ids, kinds, roots, blocks = (got[c].to_pylist() for c in ("id", "kind", "root_id", "blocks"))
    kinds = ["vendored" if copy and k in ("", "marked") else k for k, copy in zip(kinds, _copies(roots, blocks))]
    order = sorted(range(len(ids)), key=lambda r: ids[r])  # the fit must not depend on how Spark returns the rows
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    labels: list[int] = []
    path_rows: list[tuple[np.ndarray, np.ndarray]] = []
    path_labels: list[int] = []
    for r in order:
        y = 1 if kinds[r] else -1
        p_idx, p_val = cell("p_idx", r), cell("p_val", r)
        path_rows.append((p_idx, p_val / PATH_WEIGHT))
        path_labels.append(y)
        if kinds[r] != "marked":
            rows.append((np.concatenate([p_idx, cell("idx", r)]), np.concatenate([p_val, cell("val", r)])))
            labels.append(y)
    lines: dict[int, list[str]] = {1: [], -1: []}
    for y, column in ((1, "given"), (-1, "rest")):
        times: Counter = Counter()
        texts = got[column].to_pylist()
        for line in (x for r in order for x in texts[r]):
            times[line] += 1
            if times[line] <= SAME_LINES and len(lines[y]) < SAMPLE_LINES:
                lines[y].append(line)
    of_lines = _fitted([line_vector(x) for y in lines for x in lines[y]], [y for y in lines for _ in lines[y]], 2.0)
    return Model(_fitted(rows, labels), of_lines, _fitted(path_rows, path_labels))


def _fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], c: float = 1.0) -> Weights:
    """A classifier that has seen one label only says that one's opposite is absent."""
    return fit_linear_svm(rows, np.array(labels), c) if len(set(labels)) == 2 else Weights(np.zeros(DIM), 1.0 if labels and labels[0] > 0 else -1.0)


def score(packed: DataFrame, manifest: DataFrame, model: Model) -> DataFrame:
    """id, score of every manifest entry that is a candidate; above 0 it is not hand-written."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in it:
            out = []
            for i, rel, text in zip(pdf["id"], pdf["relative"], pdf["text"]):
                e = evidence(rel, text or "")
                if e.candidate:
                    out.append((i, m.judge(rel, text, e)))
            yield pd.DataFrame(out, columns=["id", "score"])

    known = _texts(packed)
    entries = manifest.groupBy("id").agg(F.max("relative").alias("relative"))
    # which entries have no text is told by the scores, written once, so the texts are not read for it
    scored = materialized(known.select("id", "relative", "text").mapInPandas(run, "id string, score double").groupBy("id").agg(F.max("score").alias("score")))
    bare = entries.where(F.col("relative").rlike(_CANDIDATE_PATH)).join(scored, "id", "left_anti").select("id", "relative", F.lit(None).cast("string").alias("text"))
    return scored.join(entries, "id", "left_semi").unionByName(bare.mapInPandas(run, "id string, score double"))


def classify(packed: DataFrame, manifest: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """id, score, hand_written for every candidate entry of the manifest."""
    return score(packed, manifest, fit(packed, sample)).withColumn("hand_written", F.col("score") <= 0)


def validation(packed: DataFrame, manifest: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per kind of evidence ('' for none): files of projects the fit has not seen, and how many of
    them the classifiers call not hand-written."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(i, e.kind) for i, root, rel, text in zip(pdf["id"], pdf["root_id"], pdf["relative"], pdf["text"]) if held_out(root) and (e := evidence(rel, text)).candidate]
            yield pd.DataFrame(rows, columns=["id", "kind"])

    labels = _texts(packed).select("id", "root_id", "relative", "text").mapInPandas(run, "id string, kind string").groupBy("id").agg(F.max("kind").alias("kind"))
    got = labels.join(score(packed, manifest, fit(packed, sample)), "id")
    return got.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("score") > 0).alias("n_found"))
