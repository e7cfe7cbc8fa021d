"""Evaluation texts inside training texts, by winnowed fingerprints.

Every k-gram of words is hashed and of each window of w neighbouring k-grams the smallest hash
is kept, in both texts by the same rule, so any shared run of at least k + w - 1 words shares a
fingerprint.  The documents' fingerprints are joined with the items' and every hit is extended
word by word to both sides; a run of ``min_words`` or more is a leak.  k = 5, w = 6: ten words.

Both sides' fingerprints are DataFrames and meet in an equi join.  A document is reduced to its
passages where it is read: a bitmap of the items' fingerprints, of bounded size, tells which of
its own may be shared; shared runs of ``min_words`` lie within chains of such fingerprints, and only
the words around a chain leave the stage.  The bitmap only saves shuffling: a false alarm is
dropped by the join, and a true one is never missed.  Equal passages are one, however many documents
hold them, and are joined and extended once; fingerprints that many items share are salted.

Defined results: null or empty texts and items shorter than ``min_words`` leak nothing; each
(document, item) pair comes once with its longest run; ties go to the first run; documents
of any length are read whole; equal documents each report their leaks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.plans.shared import materialized

MIN_WORDS, K = 10, 5
MAX_FILTER_BITS = 1 << 27  # of the bitmap every executor gets: 16 MB; with more items it only filters less
HOT_ITEMS, HOT_ROWS = 256, 100_000  # items, and passages or documents, that one key may bring into one task
MAX_HOT = 100_000  # keys that can be hot at most: a key is hot only above its share of 1 / MAX_HOT of the rows
_WORD = re.compile(r"\w+")
# Unicode's format characters (category Cf) outside the tag block.
_FORMAT = re.compile("[­؀-؅؜۝܏࢐࢑࣢᠎​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻]")
_TAG = re.compile(r"</?[A-Za-z](?:[^<>]{0,400}|[\w:.-]*\s[^<>=]*=[^<>]*)>|<!--|-->")  # a longer one has attributes
_PARTING = re.compile(r"</?(?:address|article|aside|blockquote|br|caption|dd|details|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|img|input|label|legend|li|main|nav|ol|option|p|pre|section|select|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)\b(?:[^<>]{0,400}|\s[^<>=]*=[^<>]*)>")
_EMPHASIS = re.compile(r"(?<=\w)(?:\*{1,3}|~~|`)(?=\w)")
_MARKED = re.compile(r"[<&]|\b_|_\b|-\s*\n")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


_hashes = _Hashes()


def readings(text: str | None) -> list[list[str]]:
    """The words of a text; if it has markup, a reading without it and one where block tags part words."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = _FORMAT.sub("", low)
    out = [_WORD.findall(low)]
    if _MARKED.search(low):
        bare = re.sub(r"-\s*\n\s*(?:[>#*|/]+\s*)*", "", low) if "-" in low else low
        bare = _FORMAT.sub("", _TAG.sub("", html.unescape(bare)))
        words = [w for w in (x.strip("_") for x in _WORD.findall(bare)) if w]
        if words != out[0]:
            out.append(words)
    if _EMPHASIS.search(low) or _PARTING.search(html.unescape(low)):  # block tags part words, marks inside a word do not
        bare = re.sub(r"-\s*\n\s*(?:[>#*|/]+\s*)*", "", low) if "-" in low else low
        bare = _FORMAT.sub("", _EMPHASIS.sub("", _TAG.sub("", _PARTING.sub(" ", html.unescape(bare)))))
        words = [w for w in (x.strip("_") for x in _WORD.findall(bare)) if w]
        if words not in out:
            out.append(words)
    return out


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    g = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
    return g


def winnow(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, positions): the last smallest k-gram hash of every window."""
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = _rolling(h, k)
    if len(g) <= window:
        at = np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    else:
        wide = np.lib.stride_tricks.sliding_window_view(g, window)[:, ::-1]
        at = np.unique(np.arange(len(wide)) + window - 1 - np.argmin(wide, axis=1))
    return g[at], at


def hashed(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the reading, its word hashes) of every reading that is long enough."""
    for r, words in enumerate(readings(text)):
        if len(words) >= min_words:
            yield r, np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def item_texts(items: DataFrame, item_id: str, text_col: str, min_words: int, k: int) -> DataFrame:
    """item_id, variant, words (hashes as bytes), prints, places of each reading of each item."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, text in zip(pdf["item_id"], pdf["text"]):
                for r, h in hashed(text, min_words):
                    f, at = winnow(h, k, min_words - k + 1)
                    out.append((i, r, h.tobytes(), f.view(np.int64), at))
            yield pd.DataFrame(out, columns=["item_id", "variant", "words", "prints", "places"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return rows.mapInPandas(run, f"item_id {items.schema[item_id].dataType.simpleString()}, variant int, words binary, prints array<bigint>, places array<bigint>")


_FOLD = 29  # a fingerprint's second bit is named by its bits from here on


def bitmap(prints: DataFrame) -> np.ndarray:
    """Two bits for each fingerprint, 256 in all while there is room; collected as at most
    ``MAX_FILTER_BITS`` / 64 rows."""
    n = prints.count()
    bits = min(MAX_FILTER_BITS, 1 << max(16, (256 * n - 1).bit_length() if n else 0))
    place = F.explode(F.array(F.col("print").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("print", _FOLD).bitwiseAND(F.lit(bits - 1)))).alias("place")
    cells = prints.select(place).groupBy(F.shiftrightunsigned("place", 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63L as int))")).alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    got = cells.toArrow()
    out[got["cell"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint64)


def _may_be_known(cells: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Places of the fingerprints whose bits are set."""
    low = np.uint64(len(cells) * 64 - 1)
    hit = np.ones(len(f), bool)
    for place in (f & low, (f >> np.uint64(_FOLD)) & low):
        hit &= (cells[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return np.flatnonzero(hit)


def chains(h: np.ndarray, known: np.ndarray, min_words: int, k: int) -> Iterator[tuple[int, int]]:
    """Borders of the stretches that hold every run shared with an item, from the sorted places
    of a text's known fingerprints."""
    window = min_words - k + 1
    breaks = np.flatnonzero(np.diff(known) > window) + 1
    for chain in np.split(known, breaks):
        a, b = max(0, int(chain[0]) - window + 1), min(len(h), int(chain[-1]) + k + window - 1)
        if b - a >= min_words:
            yield a, b


def passages(docs: DataFrame, filled: np.ndarray, doc_id: str, text_col: str, min_words: int, k: int) -> DataFrame:
    """doc_id, reading, first (word), words, prints, places of every stretch that may be shared."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        for pdf in it:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for begin in range(0, len(texts), 512):
                owner, bounds, flat = [], [0], []
                for t in range(begin, min(begin + 512, len(texts))):
                    for r, words in enumerate(readings(texts[t])):
                        if len(words) >= min_words:
                            owner.append((t, r))
                            flat += words
                            bounds.append(len(flat))
                if not flat:
                    continue
                # the texts of a batch are fingerprinted as one array; what crosses a border is dropped
                h = np.fromiter(map(_hashes.__getitem__, flat), np.uint64, len(flat))
                f, at = winnow(h, k, min_words - k + 1)
                known = _may_be_known(cells, f)
                edges = np.array(bounds)
                text_of = np.searchsorted(edges, at[known], "right") - 1
                inside = at[known] + k <= edges[text_of + 1]
                known, text_of = known[inside], text_of[inside]
                out = []
                for group in np.split(np.arange(len(known)), np.flatnonzero(np.diff(text_of)) + 1):
                    if not len(group):
                        continue
                    q = int(text_of[group[0]])
                    left, right = bounds[q], bounds[q + 1]
                    own, prints = at[known[group]] - left, f[known[group]].view(np.int64)
                    words = h[left:right]
                    for a, b in chains(words, own, min_words, k):
                        mine = (own >= a) & (own + k <= b)
                        out.append((ids[owner[q][0]], owner[q][1], a, words[a:b].tobytes(), prints[mine], own[mine] - a))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "reading", "first", "words", "prints", "places"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return rows.mapInPandas(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, reading int, first bigint, words binary, prints array<bigint>, places array<bigint>")


def longest_run(doc: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int]:
    """(words, first word in the document) of the longest equal run on the given diagonals; ties go to the first."""
    best, first = 0, 0
    for d in sorted(set(shifts)):
        a, b = max(0, d), min(len(doc), len(item) + d)
        equal = np.concatenate([[False], doc[a:b] == item[a - d : b - d], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        sizes = edges[1::2] - edges[::2]
        if len(sizes):
            at = int(np.argmax(sizes))
            n, start = int(sizes[at]), a + int(edges[2 * at])
            if n > best or (n == best and start < first):
                best, first = n, start
    return best, first


def _extend(it: Iterator[pd.DataFrame], min_words: int) -> Iterator[pd.DataFrame]:
    for pdf in it:
        out = []
        for key, item, doc, words, shifts in zip(pdf["key"], pdf["item_id"], pdf["doc_words"], pdf["item_words"], pdf["shifts"]):
            own = np.frombuffer(words, np.uint64)
            n, first = longest_run(np.frombuffer(doc, np.uint64), own, list(map(int, shifts)))
            if n >= min_words:
                out.append((key, item, n, first, round(n / len(own), 6)))
        yield pd.DataFrame(out, columns=["key", "item_id", "n_words", "at", "item_share"])


def hot(rows: DataFrame, key: str, least: int, name: str) -> DataFrame:
    """Keys with more than ``least`` rows and how many parts each is to be split into; never more
    than ``MAX_HOT`` keys, which is what makes it fit to be broadcast."""
    limit = max(least, rows.count() // MAX_HOT)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias(name))


def _parts(rows: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> DataFrame:
    """Adds how many parts a key is split into, 1 for keys that are not hot."""
    for table, name in tables:
        rows = rows.join(F.broadcast(table), key, "left").withColumn(name, F.coalesce(name, F.lit(1)))
    return rows


def _own(owner: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(owner), F.col(parts)).cast("int")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """Each leaked pair once: doc_id, item_id, n_words (longest shared run), first_word, item_share."""
    known = materialized(item_texts(items, item_id, text_col, min_words, k))
    prints = known.select("item_id", "variant", F.explode(F.arrays_zip("prints", "places")).alias("p")).select("item_id", "variant", F.col("p.prints").alias("print"), F.col("p.places").alias("there"))
    found = materialized(passages(docs, bitmap(prints), doc_id, text_col, min_words, k).withColumn("key", F.sha2("words", 256)))
    once = found.groupBy("key").agg(F.max(F.struct("words", "prints", "places")).alias("p")).select("key", "p.*")

    # the fingerprint join: a hot fingerprint is split by its items and by its passages
    places = once.select("key", F.explode(F.arrays_zip("prints", "places")).alias("p")).select("key", F.col("p.prints").alias("print"), F.col("p.places").alias("here"))
    splits = (hot(prints, "print", HOT_ITEMS, "by_item"), "by_item"), (hot(found.select(F.explode("prints").alias("print")), "print", HOT_ROWS, "by_passage"), "by_passage")
    left = _parts(places, "print", *splits).withColumn("q", _own("key", "by_passage")).select("key", "print", "here", "q", _every("by_item").alias("g"))
    right = _parts(prints, "print", *splits).withColumn("g", _own("item_id", "by_item")).select("item_id", "variant", "print", "there", "g", _every("by_passage").alias("q"))
    hits = left.join(right, ["print", "q", "g"]).groupBy("key", "item_id", "variant").agg(F.collect_set(F.col("here") - F.col("there")).alias("shifts"))

    pairs = hits.join(once.select("key", F.col("words").alias("doc_words")), "key").join(known.select("item_id", "variant", F.col("words").alias("item_words")), ["item_id", "variant"])
    id_type = items.schema[item_id].dataType.simpleString()
    runs = pairs.select("key", "item_id", "doc_words", "item_words", "shifts").mapInPandas(lambda it: _extend(it, min_words), f"key string, item_id {id_type}, n_words bigint, at bigint, item_share double")
    # back to the documents: a passage that very many of them hold is split by document
    split = hot(found, "key", HOT_ROWS, "by_doc"), "by_doc"
    runs = _parts(runs, "key", split).select("key", "item_id", "n_words", "at", "item_share", _every("by_doc").alias("q"))
    members = _parts(found.select("doc_id", "reading", "first", "key"), "key", split).withColumn("q", _own("doc_id", "by_doc"))
    first = F.col("first") + F.col("at")
    best = members.join(runs, ["key", "q"]).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("reading")).alias("r"), (-first).alias("f"), "item_share")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_words", (-F.col("b.f")).alias("first_word"), "b.item_share")
