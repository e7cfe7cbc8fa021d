from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from folio.functions import classify, paths, text
from folio.operators import budget, joins, parts, render, stats, tree
from folio.options import parse_size
from folio.plans.shared import numbered


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make("v")).head()[0]


def test_path_order_compares_components(spark):
    names = ["a.txt", "a/b.txt", "a-c.txt", "B.txt", "a/a/z.txt"]
    rows = spark.createDataFrame([(n,) for n in names], "relative string").orderBy(paths.path_order("relative")).collect()
    assert [r[0] for r in rows] == ["B.txt", "a/a/z.txt", "a/b.txt", "a-c.txt", "a.txt"]


@pytest.mark.parametrize(("sizes", "total", "cap", "kept"), [([60, 50, 10], 100, 1000, [60]), ([5000, 100, 1], 100, 1000, [5000, 100]), ([], 10, 10, []), ([None, 5], 5, 10, [None, 5])])
def test_budget_stops_at_the_first_that_does_not_fit(spark, sizes, total, cap, kept):
    df = spark.createDataFrame([(f"i{k}", f"f{k}", s) for k, s in enumerate(sizes)], "id string, relative string, size bigint")
    out = budget.apply_budgets(df, total, 0, cap).where("kept").orderBy("ordinal").collect()
    assert [r["size"] for r in out] == kept


def test_numbering_spans_partitions(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k")).repartition(7)
    rows = numbered(df, [F.col("k")]).orderBy("k").collect()
    assert [r["ordinal"] for r in rows] == list(range(1, 5001))


@pytest.mark.parametrize(("value", "tokens"), [("hello", 2), ("", 0), ("abcd", 1), ("漢字", 2), ("a b", 1), (None, None)])
def test_token_estimate(spark, value, tokens):
    assert one(spark, value, text.token_estimate) == tokens


def test_token_sum_rounds_once(spark):
    df = spark.createDataFrame([(c,) for c in "abcd"], "t string")
    assert df.agg(text.token_estimate_sum("t")).head()[0] == 1
    assert df.where("false").agg(text.token_estimate_sum("t")).head()[0] == 0


@pytest.mark.parametrize(("value", "fence"), [("`" * 5, 6), ("none", 3), ("```", 4), ("", 3)])
def test_fence(spark, value, fence):
    assert one(spark, value, text.fence_width) == fence


def test_sizes(spark):
    for s, n in (("8MiB", 8 << 20), ("1m", 1 << 20), ("500k", 512_000), ("2_000", 2000)):
        assert parse_size(s) == n == one(spark, s, text.parse_size)
    assert one(spark, "8x", text.parse_size) is None
    with pytest.raises(ValueError):
        parse_size("x")
    assert one(spark, 31 * 1024 + 256, text.human_bytes, "bigint") == "31.2 KiB"


def test_xml_escape_and_display(spark):
    assert one(spark, "a<b>&\x01", text.xml_escape) == "a&lt;b&gt;&amp;�"
    assert one(spark, "a\nb‮c", text.display_path) == "a\\nb\\u{202e}c"
    assert one(spark, "plain/ö.txt", text.display_path) == "plain/ö.txt"


def test_preview_cap_keeps_whole_characters(spark):
    assert one(spark, "é" * 10, lambda c: text.cap_utf8(c, 5)) == "éé"
    assert one(spark, "ab", lambda c: text.cap_utf8(c, 5)) == "ab"


def test_hidden_and_globs(spark):
    for p, hidden in ((".a/b", True), ("a/.b", True), ("./a", False), ("../a", False), ("a.b/c", False), (None, False)):
        assert one(spark, p, paths.is_hidden) is hidden
    for p, glob, hit in (("src/a.py", "*.py", True), ("x/node_modules/y", "node_modules/**", True), ("node_modules", "node_modules/**", False), ("a/b", "/a/*", True), ("c/b", "a/*", False), ("a.ts", "*.{js,ts}", True)):
        assert one(spark, p, lambda c, g=glob: paths.matches_globs(c, [g])) is hit, (p, glob)
    assert one(spark, "a", lambda c: paths.matches_globs(c, [""])) is False


def test_screen_patterns(spark):
    for p, pat, hit in (("src/deep/A.rs", "*.rs", True), ("src/a.rs", "/a.rs", False), ("src/a.rs", "src/*", True), ("src/x/a.rs", "src/*", False), ("src/x/a.rs", "src/**", True), ("a", " ", False)):
        assert one(spark, p, lambda c, g=pat: paths.matches_screen(c, g)) is hit, (p, pat)


def test_selection_prefers_ids(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "a"), ("c", "y")], "id string, relative string")
    pick = lambda names: sorted(r["id"] for r in paths.select_files(files, spark.createDataFrame([(n,) for n in names], "name string")).collect())
    assert pick(["a"]) == ["a"]
    assert pick(["y", None]) == ["c"]
    assert pick([]) == []


def test_kinds(spark):
    for p, k in (("go.mod", "text"), ("x.mod", "binary"), ("a.tar.gz", "targz"), ("a.TGZ", "targz"), ("README", "text"), ("man.3", "text"), ("x.ipynb", "ipynb"), ("x.unknownext", None), ("x.svg", "text"), (".env", None)):
        assert one(spark, p, classify.kind_from_name) == k, p
    assert one(spark, "x.svg", lambda c: classify.default_selected(c, F.lit("text"))) is False
    assert one(spark, "a/vendor/x.py", lambda c: classify.default_selected(c, F.lit("text"))) is False
    assert one(spark, "build.rs", lambda c: classify.default_selected(c, F.lit("text"))) is True
    assert one(spark, "x.f18x", lambda c: classify.language(c, F.lit("text"))) == "f18x"
    assert one(spark, bytearray(b"\x00" * 40), classify.looks_binary, "binary") is True
    assert one(spark, bytearray(b"text \x00 text" * 8), classify.looks_binary, "binary") is True
    assert one(spark, bytearray(b"a" * 200 + b"\x00"), classify.looks_binary, "binary") is False


def test_tree(spark):
    df = spark.createDataFrame([(p,) for p in ("b/x.txt", "a.txt", "b/c/y.txt", "a.txt", "./b/../z", "")], "relative string")
    assert tree.tree_text(tree.tree_lines(df), "root") == "root/\n├── a.txt\n└── b/\n    ├── c/\n    │   └── y.txt\n    ├── x.txt\n    └── z\n"


def test_owner_is_the_longest_prefix(spark):
    e = spark.createDataFrame([("a!b!c",), ("a!x",), ("q",)], "id string")
    i = spark.createDataFrame([("a",), ("a!b",)], "id string")
    assert dict(joins.owners(e, i).collect()) == {"a!b!c": "a!b", "a!x": "a", "q": None}


def test_reuse_needs_a_known_time(spark):
    t = dt.datetime(2025, 1, 1)
    f = spark.createDataFrame([("a", "/a", 1, t), ("b", "/b", 1, None)], "id string, absolute string, size bigint, modified timestamp")
    assert dict(joins.reuse_cached(f, f.union(f)).select("id", "reused").collect()) == {"a": True, "b": False}


def test_parts_join_back(spark):
    body = ("línea ñandú\n" * 900) + "x" * 5000 + "é" * 3000
    rows = parts.parts(spark.createDataFrame([(1, body), (2, ""), (3, None)], "id int, t string"), "id", "t", 1000, 100).orderBy("id", "part_no").collect()
    own = [r["part"] for r in rows if r["id"] == 1]
    assert "".join(own) == body
    assert max(len(p.encode()) for p in own) <= 1000
    assert own[0].endswith("\n")
    assert [r["part"] for r in rows if r["id"] == 2] == [""]
    assert parts.part_name("dump.md", 2, 12) == "dump-002.md"


def test_sections_and_atomic_write(spark, tmp_path):
    df = spark.createDataFrame([("1", "b.rs", "text", "fn", "extracted"), ("2", "a", "binary", "n", "skipped_binary"), ("3", "a.md", "text", "x<\n", "extracted")], "id string, relative string, kind string, text string, status string")
    xml = "".join(render.chunks(df, "xml"))
    assert xml == '<documents>\n<document index="1">\n<source>a.md</source>\n<document_content>\nx&lt;\n\n</document_content>\n</document>\n<document index="2">\n<source>b.rs</source>\n<document_content>\nfn\n</document_content>\n</document>\n</documents>\n'
    target = tmp_path / "o.txt"
    render.write_atomic(str(target), render.chunks(df, "plain"))
    assert target.read_text().startswith("=" * 48 + "\nFILE: a.md\n")

    def broken():
        yield "x"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        render.write_atomic(str(target), broken())
    assert [p.name for p in tmp_path.iterdir()] == ["o.txt"]


def test_empty_tables_give_defined_totals(spark):
    empty = spark.createDataFrame([], "id string, relative string, kind string, text string, status string, size bigint")
    assert stats.with_summary(stats.pack_stats(empty)).head()["summary"] == "packed 0 files (0 B read, 0 chars, ~0 tokens)"
    assert tree.tree_lines(empty).count() == 0
    assert render.sections(empty).count() == 0


def test_registered_queries_and_flagship(spark):
    import __spark_entry__ as e

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    out = e.entry(spark)
    assert out.columns == ["ordinal", "id", "section"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_running_sums_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([("b", 7), ("a", 9)], "k string, ordinal bigint")
    assert sorted(map(tuple, numbered(df, [F.col("k")]).collect())) == [("a", 1), ("b", 2)]


def test_looks_binary_of_all_packed_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    odd = "\x01\x0e\x1a\x1f"
    texts = ["", None, "a", "\x00" * 40, "a" * 200 + "\x00", odd * 2048, odd * 2049, "a" * 8192 + odd * 9000, odd * 65 + "a" * 9000, odd * 64 + "a" * 9000, "é" * 4096 + odd * 9000, "x" + "é" * 4095 + odd * 9000, "a" * 7936 + odd * 64 + "é" * 9000, "a" * 7935 + odd * 64 + "\x02" + "é" * 9000, "漢" * 9000, "\t\r\n\x0b\x0c\x1b" * 3000]
    spark.createDataFrame([(f"i{k:02}", t, 1) for k, t in enumerate(texts)], "id string, text string, packed_at int").write.parquet(str(tmp_path / "packed_files.parquet"))
    want = []
    for k, t in enumerate(texts):
        head = (t or "").encode()[:8192]
        want.append((f"i{k:02}", sum(b < 32 and b not in b"\t\n\x0b\x0c\r\x1b" for b in head) * 32 > len(head)))
    assert len({w for _, w in want}) == 2
    assert sorted(map(tuple, e.queries()["looks_binary_all"](spark, str(tmp_path)).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW packed_files AS SELECT * FROM '{tmp_path}/packed_files.parquet/*.parquet'")
    assert sorted(db.execute(e.oracle_sql()["looks_binary_all"]).fetchall()) == want


def test_shared_root_of_every_project(spark, tmp_path):
    import __spark_entry__ as e

    rows = [("r1", "a/x"), ("r1", "a/b/y"), ("r2", "a/x"), ("r2", "b/x"), ("r3", "a/x"), ("r3", "a"), ("r4", "x"), ("r5", "c/x"), ("r5", None), (None, "d/x"), ("r6", None)]
    df = spark.createDataFrame(rows, "root_id string, relative string")
    df.write.parquet(str(tmp_path / "manifest_entries.parquet"))
    want = {"r1": "a", "r2": None, "r3": None, "r4": None, "r5": "c", None: "d", "r6": None}
    assert dict(map(tuple, e.queries()["grant_roots"](spark, str(tmp_path)).collect())) == want
    assert joins.shared_root(df.where("root_id = 'r1'")).collect() == [("a",)]
    assert joins.shared_root(df.where("false")).collect() == [(None,)] and joins.shared_root(df.where("false"), by=["root_id"]).count() == 0
