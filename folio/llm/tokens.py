"""Exact token counts under a public vocabulary, and their totals.

The vocabulary is a trie with failure links; scanning a word once emits its longest matches
from left to right, which is the tokenization of a longest-match vocabulary.  The vocabularies
at hand are ranked merges instead: there the emitted sequence is the exact one precisely if
every neighbouring pair is (a pair is exact if merging its joined bytes gives the pair back).
Words that fail this are merged by rank.  A word's count is kept, so the cost a text is
one split and a sum of lookups.

The vocabulary file travels with the job (``MAX_VOCABULARY`` bytes at most), so executors need
no copy of their own.

Defined results: null text counts as null, empty text as 0; each row is counted whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VOCABULARY = os.environ.get("FOLIO_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
MAX_VOCABULARY = 64 << 20
# The split of the public byte-level vocabularies, in full and for ASCII text.
_SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_SPLIT_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")


# White space with what follows it: no word of the split reaches over the end of such a chunk.
_CHUNK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Chunks(dict):
    """Counts of chunks; short ones are kept while there is room."""

    def __init__(self, words: Counter) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, chunk: str) -> int:
        n = sum(map(self.words.__getitem__, (_SPLIT_ASCII if chunk.isascii() else _SPLIT).findall(chunk)))
        if len(chunk) < 40 and len(self) < 600_000:
            self[chunk] = n
        return n


class Counter(dict):
    """Tokens of a word; ``ranked``: the vocabulary is merges by rank, else longest match."""

    def __init__(self, ranks: dict[bytes, int], ranked: bool = True, keep: int = 2_000_000) -> None:
        super().__init__()
        self.ranks, self.ranked, self.keep = ranks, ranked, keep
        self.trie = ahocorasick.Automaton()
        for token in ranks:
            self.trie.add_word(token.decode("latin-1"), len(token))
        self.trie.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks = _Chunks(self)

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "replace")
        n = 1 if raw in self.ranks else self._count(raw)
        if len(self) < self.keep:
            self[word] = n
        return n

    def longest(self, raw: bytes) -> list[str]:
        """Longest matches from left to right; the failure links keep the scan linear."""
        text, out, at = raw.decode("latin-1"), [], 0
        for last, size in self.trie.iter_long(text):
            a = last + 1 - size
            out += text[at:a]  # bytes the vocabulary lacks stand alone
            out.append(text[a : last + 1])
            at = last + 1
        return out + list(text[at:])

    def _count(self, raw: bytes) -> int:
        tokens = self.longest(raw)
        if not self.ranked or all(self._exact(a, b) for a, b in zip(tokens, tokens[1:])):
            return len(tokens)
        return len(self._merge(raw))

    def _exact(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > self.keep:
                self.pairs.clear()
            self.pairs[key] = [t.decode("latin-1") for t in self._merge((a + b).encode("latin-1"))] == [a, b]
        return self.pairs[key]

    def _merge(self, raw: bytes) -> list[bytes]:
        if len(raw) > 400:  # long runs: a heap of ranks over a linked list
            return _merge_long(raw, self.ranks)
        get, none = self.ranks.get, 1 << 60
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ahead = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]  # rank of joining with the next
        while ahead and (best := min(ahead)) != none:
            i = ahead.index(best)
            parts[i] += parts.pop(i + 1)
            ahead.pop(i)
            if i < len(ahead):
                ahead[i] = get(parts[i] + parts[i + 1], none)
            if i:
                ahead[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def text(self, text: str | None) -> int | None:
        if text is None:
            return None
        return sum(map(self.chunks.__getitem__, _CHUNK.findall(text)))


def _merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    import heapq

    n = len(raw)
    part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = nxt[i] if part[i] is not None else n
        if j >= n or part[i] is None or part[i] + part[j] != joined:  # type: ignore[operator]
            continue
        part[i], part[j] = joined, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(joined + part[nxt[i]])) is not None:  # type: ignore[operator]
                heapq.heappush(heap, (r, i, joined + part[nxt[i]]))  # type: ignore[operator]
        p = prv[i]
        if p >= 0 and (r := ranks.get(part[p] + joined)) is not None:  # type: ignore[operator]
            heapq.heappush(heap, (r, p, part[p] + joined))  # type: ignore[operator]
    return [x for x in part if x is not None]


@lru_cache(maxsize=2)
def counter(path: str = VOCABULARY, ranked: bool = True) -> Counter:
    with open(path, "rb") as f:
        return Counter({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, ranked)


def _shipped(path: str) -> str:
    """Sends the vocabulary file along with the session's jobs; its name there."""
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY:
        raise ValueError(f"{path} has {size} bytes, more than {MAX_VOCABULARY}")
    SparkSession.active().sparkContext.addFile(path)
    return os.path.basename(path)


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Column: exact tokens of a text."""
    name = _shipped(path)

    @F.pandas_udf(LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(SparkFiles.get(name))
        for s in batches:
            yield pd.Series([c.text(t) for t in s], dtype="Int64")

    return run(F.col(text) if isinstance(text, str) else text)


def record_tokens(packed: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Extracted records, each id once (the earliest packed row): id, root_id, batch_id, n_tokens.

    Texts are counted where they are read; only the narrow rows are shuffled.
    """
    rows = packed.where("status = 'extracted'").select("id", "root_id", "batch_id", "packed_at", token_count("text", path).alias("n_tokens"))
    return rows.groupBy("id").agg(F.min(F.struct("packed_at", "batch_id", "root_id", "n_tokens")).alias("r")).select("id", "r.root_id", "r.batch_id", "r.n_tokens")


def spelled(c: str | Column) -> Column:
    """One spelling of a label: lower case, '_' for blanks and hyphens, 'unknown' if missing."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_"), F.lit("")), F.lit("unknown"))


def cross_totals(records: DataFrame, manifest: DataFrame, roots: DataFrame) -> DataFrame:
    """Totals of every project, language and domain that occur together: n_records, n_tokens.

    Member ids (``parent!member``) have no manifest row and count under 'unknown'.  The records
    are first summed by project and language, so what is joined and regrouped is small however
    hot a project is.
    """
    newest = manifest.groupBy("id").agg(F.max(F.struct("scanned_at", "language")).alias("m")).select("id", F.col("m.language").alias("language"))
    summed = records.join(newest, "id", "left").groupBy("root_id", spelled("language").alias("language")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    domains = roots.groupBy("root_id").agg(F.max("domain").alias("domain"))
    return summed.join(domains, "root_id", "left").select(F.coalesce("root_id", F.lit("unknown")).alias("root_id"), "language", spelled("domain").alias("domain"), "n_records", "n_tokens")


def totals(records: DataFrame, manifest: DataFrame, roots: DataFrame) -> DataFrame:
    """Totals by project, by language and by domain: slice, value, n_records, n_tokens."""
    slices = F.array(*(F.struct(F.lit(s).alias("slice"), F.col(c).alias("value")) for s, c in (("project", "root_id"), ("language", "language"), ("domain", "domain"))))
    return (
        cross_totals(records, manifest, roots)
        .select(F.explode(slices).alias("s"), "n_records", "n_tokens")
        .groupBy("s.slice", "s.value")
        .agg(F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    )


def batch_totals(records: DataFrame, stats: DataFrame) -> DataFrame:
    """Each batch's counted tokens beside the estimate on record and their ratio."""
    counted = records.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    est = stats.groupBy("batch_id").agg(F.max("tokens_est").cast("bigint").alias("tokens_est"))
    return est.join(counted, "batch_id", "full").select(
        "batch_id",
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        "tokens_est",
        F.round(F.col("tokens_est") / F.nullif(F.col("n_tokens"), F.lit(0)), 4).alias("est_ratio"),
    )
