from __future__ import annotations

import base64
import datetime as dt
import os
import random

import pytest

from folio.llm import mixing, tokens
from folio.llm.tokens import Counter

T = dt.datetime(2025, 1, 1)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_counts_equal_the_public_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    alphabet = "abcdefXYZ 0159\n\t  .,'-_éñ漢字🙂Ω  \r"
    texts = ["", " ", "don't we'll", "a" * 3000, "  x   y\n\n z ", "\x1c\x1f x", "²½ Ⅷ", *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 300))) for _ in range(400))]
    c = tokens.counter()
    assert [c.text(t) for t in texts] == [len(enc.encode_ordinary(t)) for t in texts]
    assert c.text(None) is None


def test_longest_match_equals_brute_force():
    rnd = random.Random(2)
    vocab = {bytes([b]): b for b in b"abc"} | {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))).encode(): 10 + k for k in range(30)}
    c = Counter(vocab, ranked=False)
    for _ in range(300):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 40)))
        at = n = 0
        while at < len(word):
            at += max((len(v) for v in vocab if word.encode().startswith(v, at)), default=1)
            n += 1
        assert c[word] == n


@needs_vocabulary
def test_totals(spark):
    packed = spark.createDataFrame([("a", "r1", 1, T, "hello world", "extracted"), ("a", "r1", 2, T + dt.timedelta(1), "hello world", "extracted"), ("b!m", "r2", 2, T, "hello", "extracted"), ("c", "r1", 1, T, "[note]", "error"), ("d", "r1", 1, T, "", "extracted"), ("e", "r1", 1, T, None, "extracted")], "id string, root_id string, batch_id bigint, packed_at timestamp, text string, status string")
    rec = tokens.record_tokens(packed)
    assert sorted((r["id"], r["batch_id"], r["n_tokens"]) for r in rec.collect()) == [("a", 1, 2), ("b!m", 2, 1), ("d", 1, 0), ("e", 1, None)]
    manifest = spark.createDataFrame([("a", "Python", T), ("a", "PYTHON ", T)], "id string, language string, scanned_at timestamp")
    roots = spark.createDataFrame([("r1", "Web-Dev"), ("r2", None)], "root_id string, domain string")
    got = {(r["slice"], r["value"]): r["n_tokens"] for r in tokens.totals(rec, manifest, roots).collect()}
    assert got[("project", "r1")] == 2 and got[("language", "python")] == 2 and got[("domain", "web_dev")] == 2 and got[("domain", "unknown")] == 1
    cross = {(r["root_id"], r["language"], r["domain"]): (r["n_records"], r["n_tokens"]) for r in tokens.cross_totals(rec, manifest, roots).collect()}
    assert cross == {("r1", "python", "web_dev"): (1, 2), ("r1", "unknown", "web_dev"): (2, 0), ("r2", "unknown", "unknown"): (1, 1)}
    stats = spark.createDataFrame([(1, 4.0), (3, None)], "batch_id bigint, tokens_est double")
    by = {r["batch_id"]: r for r in tokens.batch_totals(rec, stats).collect()}
    assert by[1]["est_ratio"] == 2.0 and by[3]["n_tokens"] == 0 and by[2]["tokens_est"] is None
    assert tokens.record_tokens(packed.where("false")).count() == 0


def test_mixing_reaches_shares_within_caps(spark):
    rnd = random.Random(1)
    rows = [(i, "big" if i % 3 else ("small" if i % 6 else "mid"), rnd.randint(20, 400)) for i in range(6000)]
    records = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 3), ("Small ", 0.3, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.copies(records, targets)
    out = {r["source"]: r for r in mixing.shares(mixed, records, targets).collect()}
    for r in out.values():
        assert abs(r["reached_share"] - r["target_share"]) < 0.01
        assert r["most_copies"] <= r["max_repeats"]
    # the tightest source is used up
    assert any(r["used_tokens"] == r["max_repeats"] * r["have_tokens"] for r in out.values())
    small = {r["source"]: r for r in mixing.shares(mixing.copies(records, targets, bucket_rows=100), records, targets).collect()}
    assert all(abs(r["reached_share"] - r["target_share"]) < 0.01 for r in small.values())
    more = targets.union(spark.createDataFrame([("absent", 0.5, 1)], targets.schema))
    reached = {r["source"]: r["reached_share"] for r in mixing.shares(mixing.copies(records, more), records, more).collect()}
    assert reached["absent"] == 0.0 and abs(reached["mid"] - 0.4) < 0.01
    again = mixing.copies(records.repartition(13), targets)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))


@needs_vocabulary
def test_records_for_mixing(spark):
    d = spark.createDataFrame([(1, "one two", "A-b"), (2, "one two", "a_b"), (3, "", "x"), (4, None, "x"), (5, "three", None)], "doc_id bigint, text string, source string")
    assert sorted(map(tuple, mixing.counted(d).collect())) == [(1, "a_b", 2), (5, "unknown", 1)]
    targets = spark.createDataFrame([("a_b", 1.0, 2)], "source string, target_share double, max_repeats int")
    rec = mixing.counted(d)
    assert sorted(map(tuple, mixing.copies(rec, targets).collect())) == [(1, "a_b", 2, 2)]
    assert {r["source"]: r["reached_share"] for r in mixing.shares(mixing.copies(rec, targets), rec, targets).collect()} == {"a_b": 1.0, "unknown": 0.0}
    assert mixing.copies(rec.where("false"), targets).count() == 0
