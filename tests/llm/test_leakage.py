from __future__ import annotations

import random
import re

import numpy as np

from folio.llm import leakage
from folio.llm.leakage import leaks, longest_run, readings

WORDS = [f"w{k}" for k in range(60)]


def brute(doc: str, item: str, n: int = 10) -> bool:
    d, i = (re.findall(r"\w+", t.lower()) for t in (doc, item))
    grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)}
    return any(tuple(d[k : k + n]) in grams for k in range(len(d) - n + 1))


def pairs(spark, docs: list, items: list) -> set:
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in leaks(d, i).collect()}


def test_every_shared_run_of_ten_words_is_found(spark, monkeypatch):
    rnd = random.Random(4)
    items = [(k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(8, 50)))) for k in range(25)]
    docs = []
    for _ in range(600):
        d = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 2)):
            src = items[rnd.randrange(25)][1].split()
            a, n = rnd.randrange(len(src)), rnd.randint(7, 14)
            at = rnd.randint(0, len(d))
            d[at:at] = src[a : a + n]
        docs.append(rnd.choice([" ", "\n", ", ", "* "]).join(d).upper())
    want = {(t, k) for t, d in enumerate(docs) for k, i in items if brute(d, i)}
    assert pairs(spark, docs, items) == want
    monkeypatch.setattr(leakage, "MAX_FILTER_BITS", 64)  # every fingerprint passes the bitmap
    monkeypatch.setattr(leakage, "HOT_ITEMS", 2)  # and many keys are split
    monkeypatch.setattr(leakage, "HOT_ROWS", 3)
    assert pairs(spark, docs, items) == want


def test_few_different_words_and_ties(spark):
    items = [(1, "a " * 12), (2, "a b " * 8)]
    docs = ["a " * 9, "a " * 10, "b a " * 5, "x"]
    assert pairs(spark, docs, items) == {(t, k) for t, d in enumerate(docs) for k, i in items if brute(d, i)} == {(1, 1), (2, 2)}


def test_longest_run():
    a, b = np.array([1, 2, 3, 4, 9, 5, 6], np.uint64), np.array([0, 2, 3, 4, 5, 6], np.uint64)
    assert longest_run(a, b, [0, 1, 0]) == (3, 1)
    assert longest_run(a, b, [1]) == (2, 5) and longest_run(a, b, [-3]) == (0, 0)


def test_wording_that_all_items_share(spark):
    common = " ".join(WORDS[:12])
    items = [(k, f"{common} own{k}") for k in range(700)]
    assert len(pairs(spark, [f"x {common} y", f"x {common} z", "none"], items)) == 1400


def test_a_passage_that_most_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(leakage, "HOT_ROWS", 20)
    common = " ".join(WORDS[:12])
    docs = [f"{common}" if k % 3 else f"a{k} b{k} {common} c{k}" for k in range(300)]
    assert pairs(spark, docs, [(1, f"{common} more"), (2, "none " * 12)]) == {(k, 1) for k in range(300)}


ITEM = "show that the lexer cannot observe the parser twice before noon"


def test_markup_and_invisible_characters_do_not_count(spark):
    words = [f"word{k}x" for k in range(12)]
    wide = '<td title="' + "t" * 600 + '">'
    marked = ["show **that** the <em>lexer</em> can\u200bnot observe\n> the parser, twice; before _noon_", "SHOW THAT the lexer cannot ob\u00adserve the &#112;arser twice before noon"]
    tagged = ["<br>".join(words), "</td><td>".join(words), "</li>\n<li>".join(words), f"</td>{wide}".join(words), " ".join(w.replace("rd", "**rd**") for w in words), "<br>".join(w.replace("rd", "<b>rd</b>") for w in words)]
    got = pairs(spark, marked + tagged, [(7, ITEM), (8, " ".join(words))])
    assert got == {(k, 7) for k in range(2)} | {(k, 8) for k in range(2, 8)}
    assert readings(None) == [] and readings("") == []


def test_tables(spark):
    item = " ".join(WORDS[:20])
    docs = spark.createDataFrame([(1, f"x {item} y", 1), (2, None, 2), (3, "", 3), (4, " ".join(WORDS[5:14]), 4), (5, f"x {item} y", 5)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, item), (11, " ".join(WORDS[5:30])), (12, None), (13, "short")], "item_id bigint, text string")
    got = sorted(tuple(r) for r in leaks(docs, items).collect())
    assert got == [(1, 10, 20, 1, 1.0), (1, 11, 15, 6, 0.6), (5, 10, 20, 1, 1.0), (5, 11, 15, 6, 0.6)]
    assert leaks(docs, items.where("false")).count() == 0
    assert leaks(docs.where("false"), items).count() == 0
