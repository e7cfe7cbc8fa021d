from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folio import sample
from folio.functions import text
from folio.operators import archive, manifest, parts, render, stats
from folio.operators.pack import pack_df
from folio.options import Options
from folio.plans import shared
from folio.results import Lru, Results, SteppedPack, cancel, progress, tagged

FILES = [("a", "src/a.py", "text", "python", 10, False, True), ("b", "src/x/b.py", "text", "python", 20, False, False), ("c", "docs/c.md", "text", "markdown", None, False, None), ("d", "src/big.bin", "binary", None, 99, True, False), ("n", None, None, None, None, None, None)]
SCHEMA = "id string, relative string, kind string, language string, size bigint, oversized boolean, default_on boolean"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, SCHEMA)


def ticked(df) -> set:
    return {r["id"] for r in df.where("ticked").collect()}


def test_ticks(files):
    assert ticked(manifest.tick_all(files, True)) == {"a", "b", "c", "n"}
    assert ticked(manifest.tick_folder(files, "src/", True)) == {"a", "b"}
    assert ticked(manifest.tick_folder(manifest.tick_all(files, True), "src/x", False)) == {"a", "c", "n"}
    assert ticked(manifest.tick_pattern(files, "**/*.py", False)) == set()
    assert ticked(manifest.toggle_languages(files, ["python"])) == {"a", "b"}
    assert ticked(manifest.toggle_languages(manifest.tick_all(files, True), ["python", "text"])) == {"c"}
    assert manifest.tick_all(files.where("false"), True).count() == 0


def test_selections(spark, files):
    names = spark.createDataFrame([("a",), ("docs/c.md",), (None,)], "name string")
    assert {r["id"] for r in manifest.selected_manifest(files, names).collect()} == {"a", "c"}
    same = lambda x, y: manifest.same_selection(spark.createDataFrame(x, "id string"), spark.createDataFrame(y, "id string")).head()[0]
    assert same([("a",), ("a",), (None,)], [(None,), ("a",)]) and not same([("a",)], [("b",)]) and same([], [])


def test_names_and_roots(spark, files):
    names = spark.createDataFrame([("x/node_modules/a.js",), ("x/.git/a",), ("x/src/a.js",), (None,)], "relative string")
    assert [r[0] for r in manifest.keep_list(names).collect() if r[0]] == ["x/src/a.js"]
    dirs = spark.createDataFrame([("",), ("node_modules",), (".hid",), ("src/",)], "d string")
    assert [r[0] for r in dirs.select(manifest.may_enter("d")).collect()] == [True, False, False, True]
    rows = spark.createDataFrame([("g/a/b", "g"), ("g/a", "."), ("gg/a", "g"), ("g/a", None)], "p string, r string")
    assert [r[0] for r in rows.select(manifest.under_root("p", "r")).collect()] == ["a/b", "g/a", "gg/a", "g/a"]
    assert manifest.manifest_bytes(files).head() == (5, 129) and manifest.manifest_bytes(files.where("false")).head() == (0, 0)
    assert [r["id"] for r in manifest.in_id_order(files).collect()] == list("abcdn")


def test_reuse(spark):
    t = "id string, relative string, size bigint, modified bigint"
    now = spark.createDataFrame([("a", "a", 1, 5), ("z", "z.zip", 1, 5), ("n", "n", 1, None)], t)
    had = spark.createDataFrame([("a", "a", 1, 5, False, "t", "other"), ("z", "z.zip", 1, 5, True, "t", "m"), ("n", "n", 1, None, False, "t", "m")], t + ", archive boolean, text_key string, member_key string")
    assert {r[0] for r in manifest.reusable(now, had, "t", "m").collect()} == {"a", "z"}
    assert {r[0] for r in manifest.reusable(now, had, "t", "new").collect()} == {"a"}
    assert manifest.reusable(now, had, "u", "m").count() == 0
    cache = spark.createDataFrame([("a", [4, 2]), ("b", []), ("c", None)], "id string, positions array<bigint>")
    assert sorted(map(tuple, manifest.cached_positions(cache).collect())) == [("a", 0, 4), ("a", 1, 2)]


def test_batches(spark):
    rows = [(f"f{k:03}", f"d/f{k:03}", "pdf" if k % 50 == 7 else "text", None if k == 3 else k * 7 % 60) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, relative string, kind string, size bigint").coalesce(1)
    got = manifest.batches(df, 10, 300)
    by: dict[str, list] = {}
    for r in got.collect():
        by.setdefault(r["batch"], []).append(r)
    assert sum(map(len, by.values())) == 400
    for own in by.values():
        assert len(own) <= 10 and (len(own) == 1 or (sum(r["size"] or 0 for r in own) <= 300 and all(r["kind"] == "text" for r in own)))
    assert manifest.batches(df.where("false")).count() == 0


def packed_rows(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.txt", "inner é")
        f.writestr("y.bin", bytes(range(9)))
    files = [("a", "a.txt", bytearray(b"hello")), ("z", "z.zip", bytearray(z.getvalue())), ("p", "p.pdf", bytearray(b"%PDF-1")), ("g", "g.txt", None)]
    return pack_df(spark.createDataFrame(files, "id string, relative string, bytes binary"), Options(follow_archives=True))


def test_outcomes_previews_and_wire(spark):
    packed = packed_rows(spark).cache()
    rows = {r["id"]: r for r in manifest.outcomes(packed).collect()}
    assert rows["a"]["message"] == "" and rows["a"]["language"] == "txt" and rows["g"]["status"] == "changed"
    assert manifest.nothing_extracted(packed).head()[0] is None
    error = manifest.nothing_extracted(packed.where("status <> 'extracted'")).head()[0]
    assert error.startswith("Nothing extracted.") and "g.txt [changed]: File changed on disk" in error
    assert manifest.preview(packed, "a").head() == ("hello", False, "extracted", "")
    assert manifest.preview(packed, "a", 3).head()[:2] == ("hel", True)
    assert "inner é" in manifest.preview(packed, "z").head()["text"] and manifest.preview(packed, "z").head()["status"] == "extracted"
    assert manifest.preview(packed, "none").head()[2:] == ("extracted", "Nothing in this file goes into the dump.")
    assert manifest.preview(packed, "g").head()["status"] == "changed"
    wire = manifest.to_wire(packed)
    assert "detail" not in json.loads(wire.where(F.col("wire").contains('"a.txt"')).head()[0])
    back = manifest.from_wire(wire.union(spark.createDataFrame([("junk",)], "wire string")))
    key = ["id", "relative", "kind", "size", "text", "status", "status_limit", "status_detail"]
    assert sorted(map(str, back.select(key).collect())) == sorted(map(str, packed.select(key).collect()))


def test_totals_of_a_whole_pack(spark):
    packed = packed_rows(spark)
    row = stats.with_summary(stats.finished(packed, cut=2)).head()
    assert row["truncated"] and not row["cancelled"] and row["summary"].endswith(", truncated")
    assert not stats.finished(packed).head()["truncated"]
    assert stats.with_summary(stats.finished(packed, cancelled=True)).head()["summary"].endswith(", truncated, cancelled")


def test_stored_results_and_lru(spark, tmp_path):
    lru: Lru[int] = Lru(2, 100)
    assert lru.push("a", 1, 10) == [] and lru.push("b", 2, 10) == [] and lru.get("a") == 1
    assert lru.push("c", 3, 10) == ["b"] and lru.get("b") is None
    assert lru.push("d", 4, 500) == ["a", "c"] and lru.get("d") == 4
    results = Results(spark, str(tmp_path), max_items=1)
    packed = packed_rows(spark)
    key = results.store(packed)
    assert "".join(results.redraw(key, "markdown", "top")) == "".join(render.chunks(packed, "markdown", "top/\n├── a.txt\n└── z.zip/\n    └── x.txt\n"))
    assert "".join(results.redraw(key, "xml")).startswith("<documents>")
    results.store(packed)
    assert results.packed(key) is None
    with pytest.raises(KeyError):
        results.redraw(key)


def test_a_pack_in_steps(spark, tmp_path):
    rows = [(f"f{k}", f"f{k}.txt", bytearray(b"x%d" % k)) for k in range(4)]
    df = spark.createDataFrame(rows, "id string, relative string, bytes binary")
    p = SteppedPack(spark, str(tmp_path), Options())
    assert p.add(df.where("id < 'f2'")) == 2
    p.add(df.where("id < 'f2'"))  # sent again
    p.add(df.where("id >= 'f2'"))
    got, totals = p.finish()
    assert sorted(r["text"] for r in got.collect()) == ["x0", "x1", "x2", "x3"] and totals.head()["files_extracted"] == 4
    with pytest.raises(RuntimeError):
        p.add(df)
    q = SteppedPack(spark, str(tmp_path), Options())
    q.add(df)
    q.abort()
    assert q.rows() is None and SteppedPack(spark, str(tmp_path), Options()).finish()[0].count() == 0


def test_progress_and_cancel(spark):
    with tagged(spark, "folio-test"):
        assert spark.getTags() == {"folio-test"}
        cancel(spark, "folio-test")
    done, total = progress(spark)
    assert 0 <= done <= total


def test_parts_of_a_stream(spark, tmp_path):
    body = "".join(f"line {k} é\n" for k in range(3000)) + "漢" * 5000
    cut = list(parts.cut_stream(iter([body[k : k + 700] for k in range(0, len(body), 700)]), 4096, 256))
    assert "".join(cut) == body and max(len(c.encode()) for c in cut) <= 4096
    df = spark.createDataFrame([("t", body)], "id string, text string")
    assert [r["part"] for r in parts.parts(df, "id", "text", 4096, 256).orderBy("part_no").collect()] == cut
    n = parts.zip_parts(str(tmp_path / "d.zip"), "a/b:dump.md", iter([body]), 4096, 256)
    with zipfile.ZipFile(tmp_path / "d.zip") as z:
        assert len(z.namelist()) == n == len(cut) and z.namelist()[0] == "a-b-dump-001.md" and "".join(z.read(x).decode() for x in z.namelist()) == body
    assert list(parts.cut_stream(iter([]))) == []


def test_small_ones(spark):
    assert spark.createDataFrame([("abc\ndef",)], "t string").select(text.cap_utf8("t", 3)).head()[0] == "abc"
    row = spark.createDataFrame([("a ``` b", "aGk=\n", "!")], "t string, b string, x string").select(text.report_fence("t"), text.from_base64("b"), text.from_base64("x")).head()
    assert row[0] == "````" and bytes(row[1]) == b"hi" and row[2] is None
    assert text.expand_home("~/x", "/h") == "/h/x" and text.expand_home("~", "/h") == "/h" and text.expand_home("a~", "/h") == "a~"
    assert text.shorten_home("/h/x", "/h") == "~/x" and text.shorten_home("/h", "/h") == "~" and text.shorten_home("/hh", "/h") == "/hh" and text.shorten_home("/x", "/") == "/x"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "1")
        f.writestr("big", "2" * 50)
    assert archive.plain_members(z.getvalue(), "zip", 10) == [("a", b"1")]
    assert render.directory_map(spark.createDataFrame([("a/b",)], "relative string"), "top", "xml") == "<document_tree>\ntop/\n└── a/\n    └── b\n\n</document_tree>\n"
    assert "".join(render.in_chunks(iter(["ab", "c" * 25, "", "d"]), 10)) == "ab" + "c" * 25 + "d"


def test_running_sums_and_ranks(spark):
    df = spark.createDataFrame([(k % 3, None if k % 7 == 0 else k) for k in range(200)] + [(None, 5)] * 3, "g int, v int").repartition(5)
    got = [(r["total"], r["n"]) for r in shared.running(df, [F.col("v"), F.col("g")], {"total": F.col("v"), "n": F.lit(1)}).collect()]
    assert sorted(n for _, n in got) == list(range(1, 204)) and max(t for t, _ in got) == sum(k for k in range(200) if k % 7) + 15
    ranks: dict = {}
    for r in shared.ranked(df, "g", [F.col("v")], "rank").collect():
        ranks.setdefault(r["g"], []).append((r["rank"], r["v"]))
    for g, own in ranks.items():
        own.sort()
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own if v] == sorted(v for _, v in own if v)
    assert len(ranks[None]) == 3 and shared.ranked(df.where("false"), "g", [F.col("v")]).count() == 0
    assert shared.running(df.where("false"), [F.col("v")], {"n": F.lit(1)}).count() == 0


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://x"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)})())})())})

        @staticmethod
        def getConf():
            return type("C", (), {"get": staticmethod(lambda _: None)})()

    fake = type("D", (), {"sparkSession": type("P", (), {"sparkContext": Context()})()})()
    with pytest.raises(RuntimeError):
        shared.materialized(fake)


def test_sample_project(tmp_path):
    root = sample.materialize(str(tmp_path))
    assert root == sample.materialize(str(tmp_path)) and len(sample.files()) == 13
