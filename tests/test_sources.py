from __future__ import annotations

import datetime as dt
import io
import os
import zipfile

import pytest

from folio.incremental import VersionedTable, latest, pending_files
from folio.options import Options
from folio.operators.pack import pack_df
from folio.operators.stats import warning_lines
from folio.sources.files import ignored, labels, open_beneath, read_file, rules, scan, scan_all, warnings, with_bytes
from folio.streaming.repack import repack, watch, watched


def test_walk_ignores_and_labels(spark, tmp_path):
    a, b = tmp_path / "p" / "src", tmp_path / "q" / "src"
    for d in (a, b):
        d.mkdir(parents=True)
        (d / "_u.txt").write_text("u")
        (d / ".h").write_text("h")
    (a / ".gitignore").write_text("*.log\n!keep.log\n/only\nsub/\n")
    for n in ("x.log", "keep.log", "only"):
        (a / n).write_text(n)
    for n in ("sub", "node_modules", ".git"):
        (a / n).mkdir()
        (a / n / "f.txt").write_text("f")
    os.symlink(a / "_u.txt", a / "link")
    os.mkfifo(a / "pipe")
    got = scan(spark, Options(roots=(str(a), str(b)))).orderBy("id").collect()
    assert [r["id"] for r in got] == ["0:p/src/_u.txt", "0:p/src/keep.log", "1:q/src/_u.txt"]
    rows = {r["id"]: r for r in with_bytes(scan(spark, Options(roots=(str(a),))), 1).collect()}
    assert rows["keep.log"]["bytes"] is None and rows["keep.log"]["size"] == 8 and bytes(rows["_u.txt"]["bytes"]) == b"u"
    with pytest.raises(ValueError):
        scan(spark, Options(roots=(str(tmp_path / "none"),)))


def tree(base, files: dict[str, str]) -> None:
    for name, body in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(body)


def names(spark, root, **given) -> list[str]:
    return [r["relative"] for r in scan(spark, Options(roots=(str(root),), **given)).orderBy("relative").collect()]


def test_ignore_files_above_and_beside(spark, tmp_path, monkeypatch):
    tree(tmp_path, {"home/.config/git/ignore": "*.user\n", "repo/.gitignore": "/pkg/a.txt\n*.tmp\n", "repo/.git/info/exclude": "*.ex\n", "repo/.ignore": "!k.tmp\n"})
    tree(tmp_path / "repo" / "pkg", {"a.txt": "", "b.txt": "", "c.tmp": "", "k.tmp": "", "d.ex": "", "e.user": "", "own/.git/x": "", "own/z.tmp": "", "own/y.ex": ""})
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    assert names(spark, tmp_path / "repo" / "pkg") == ["b.txt", "k.tmp", "own/y.ex", "own/z.tmp"]
    assert "c.tmp" in names(spark, tmp_path / "repo" / "pkg", gitignore=False)
    tree(tmp_path / "bare", {".gitignore": "*.tmp\n", ".ignore": "*.no\n", "a.tmp": "", "a.no": ""})
    assert names(spark, tmp_path / "bare") == ["a.tmp"]  # no repository: only .ignore holds


def test_partitions_and_warnings(spark, tmp_path):
    tree(tmp_path, {f"d{k}/{n}.txt": "x" for k in range(5) for n in "ab"} | {"top.txt": "t"})
    os.symlink(tmp_path, tmp_path / "d0" / "loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "d1" / "broken")
    rows = scan_all(spark, Options(roots=(str(tmp_path),), follow_links=True))
    assert rows.rdd.getNumPartitions() == 6
    assert rows.where("warning IS NULL").count() == 11
    n, kept = warnings(rows, keep=1)
    assert n == 2 and len(kept) == 1 and "d0/loop" in kept[0]
    assert warning_lines(n, kept, 1) == [f"warning: {kept[0]}", "warning: 1 more paths could not be walked"]


def test_why_a_file_changed(tmp_path):
    tree(tmp_path, {"f": "abc", "g": "x"})
    at = lambda name: str(tmp_path / name)
    assert read_file(at("f"), "f", False, 9) == (b"abc", 3, None) and read_file(at("f"), "f", False, 2) == (None, 3, None)
    assert read_file(at("none"), "none", False, 9)[2] == "no longer there"
    os.symlink(at("f"), at("l"))
    os.mkfifo(at("p"))
    assert read_file(at("l"), "l", False, 9)[2] == "replaced by a symlink" and read_file(at("f"), "f", True, 9)[2] == "no longer a symlink"
    assert read_file(at("p"), "p", False, 9)[2] == "no longer a regular file" and read_file(at("l"), "l", True, 9)[0] == b"abc"


def test_big_files_keep_their_size(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "big.txt").write_bytes(b"a" * (9 << 20))
    with zipfile.ZipFile(tmp_path / "r" / "big.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("x.bin", b"b" * (12 << 20))
    opts = Options(roots=(str(tmp_path / "r"),), follow_archives=True)
    got = {r["id"]: r for r in pack_df(with_bytes(scan(spark, opts), opts.max_file_size), opts).collect()}
    assert got["big.txt"]["text"] == f"[too large: {9 << 20} bytes; limit {8 << 20} bytes]"
    assert got["big.zip"]["status"] == "too_large" and got["big.zip"]["size"] > 12 << 20


def test_a_root_archive_is_expanded(spark, tmp_path):
    (tmp_path / "z.zip").write_bytes(bytes(zipped(a="1")))
    opts = Options(roots=(str(tmp_path / "z.zip"),))
    assert [r["text"] for r in pack_df(with_bytes(scan(spark, opts), 1 << 20), opts).collect()] == ["1"]
    opts = Options(roots=(str(tmp_path),))
    assert [r["status"] for r in pack_df(with_bytes(scan(spark, opts), 1 << 20), opts).collect()] == ["skipped_archive"]


def test_open_beneath_refuses_links(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_text("x")
    os.close(open_beneath(str(tmp_path / "d" / "f"), str(tmp_path)))
    os.symlink(tmp_path / "d", tmp_path / "l")
    with pytest.raises(OSError):
        open_beneath(str(tmp_path / "l" / "f"), str(tmp_path))
    os.mkfifo(tmp_path / "d" / "p")
    with pytest.raises(OSError):
        open_beneath(str(tmp_path / "d" / "p"), str(tmp_path))


def test_ignore_rules():
    chain = [("", rules("*.o\n!k.o\ndir/\na/**/z\n"))]
    assert ignored(chain, "x/y.o", False) and not ignored(chain, "k.o", False)
    assert ignored(chain, "q/dir", True) and not ignored(chain, "q/dir", False)
    assert ignored(chain, "a/b/c/z", False) and ignored(chain, "a/z", False)


def test_labels_grow_until_free_of_prefixes():
    assert labels(["/a/x", "/b/x"]) == ["a/x", "b/x"]
    assert labels(["/a/x", "/b/y"]) == ["x", "y"]


T = dt.datetime(2025, 1, 1)


def test_pending_files_cases(spark):
    w = "id string, absolute string, size bigint, modified timestamp, scan_no int, seen_at timestamp"
    rows = [("same", "/s", 1, T, 5, T), ("new", "/n", 1, T, 5, T), ("moved", "/m2", 1, T, 5, T), ("grown", "/g", 2, T, 5, T), ("nulltime", "/t", 1, None, 5, T), ("twice", "/w", 9, T, 5, T), ("twice", "/w", 1, T, 5, T + dt.timedelta(1)), ("old", "/o", 1, T, 4, T), ("failed", "/f", 1, T, 5, T)]
    walked = spark.createDataFrame([*rows, rows[0]], w)
    c = "run_id bigint, id string, path string, size bigint, modified timestamp, written_at timestamp"
    cache = spark.createDataFrame([(1, "same", "/s", 1, T, T), (1, "same", "/s", 1, T, T), (1, "moved", "/m", 1, T, T), (1, "grown", "/g", 1, T, T), (1, "nulltime", "/t", 1, None, T), (1, "twice", "/w", 1, T, T), (2, "failed", "/f", 1, T, T), (3, "new", "/n", 1, T, T)], c)
    runs = spark.createDataFrame([(1, 4, "succeeded", "f"), (2, 4, "failed", "f"), (3, 4, "succeeded", "other"), (4, 5, "pending", "f")], "run_id bigint, scan_no int, run_status string, fingerprint string")
    got = sorted(r["id"] for r in pending_files(walked, cache, runs).collect())
    assert got == ["failed", "grown", "moved", "new", "nulltime"]
    assert pending_files(walked.where("false"), cache, runs).count() == 0
    assert pending_files(walked, cache.where("false"), runs).count() == 7


def test_latest_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z")], "k string, o int, v string")
    assert latest(df, ["k"], ["o"], ["v"]).collect() == [("a", "y")]


def test_versions_are_published_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id", ["size", "modified"])
    schema = "id string, size bigint, modified timestamp"
    src = spark.createDataFrame([("a", 1, T), ("a", 1, T), ("b", 2, None)], schema)
    seen: list[list[str]] = []

    def process(changed):
        seen.append(sorted(r["id"] for r in changed.collect()))
        return changed

    assert t.run(src, process) == 1
    assert t.run(src, process) == 2
    assert seen == [["a", "b"], ["b"]]  # an unknown time is always new

    def broken(changed):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        t.run(spark.createDataFrame([("c", 1, T)], schema), broken)
    assert [v for v, _ in t.published()] == [1, 2]
    t.run(spark.createDataFrame([("c", 1, T), ("a", 5, T)], schema), process)
    assert seen[-1] == ["a", "c"]
    assert {r["id"]: r["size"] for r in t.state().collect()} == {"a": 5, "b": 2, "c": 1}
    number = t.published()[-1][0]
    with pytest.raises(Exception):  # noqa: B017 - a version that exists cannot be published again
        t._publish(number, "data/x")


def test_a_key_with_two_versions_is_processed_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id", ["v"])
    src = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "id string, v int")
    seen: list[list] = []

    def process(changed):
        seen.append(sorted((r["id"] or "", r["v"]) for r in changed.collect()))
        return changed

    for _ in range(3):
        t.run(src, process)
    assert seen[0] == [("", 1), ("a", 2), ("b", 1)] and seen[1] == seen[2] == [("", 1)]


def test_order_decides_which_row_is_newest(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id", ["v"], order=["at"])
    t.run(spark.createDataFrame([("a", 5, 1), ("a", 3, 2)], "id string, v int, at int"), lambda c: c)
    assert [(r["v"], r["at"]) for r in t.state().collect()] == [(3, 2)]
    assert t.changed(spark.createDataFrame([("a", 3, 9), ("c", None, 1)], "id string, v int, at int")).select("id").collect() == [("c",)]


def test_a_death_while_publishing_leaves_no_marker(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), "id", ["v"])
    src = spark.createDataFrame([("a", 1)], "id string, v int")
    with monkeypatch.context() as m:
        m.setattr(os, "link", lambda *_: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            t.run(src, lambda c: c)
    assert t.published() == [] and t.run(src, lambda c: c) == 1 and t.state().count() == 1


def test_a_rename_never_replaces(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), "id", ["v"])
    tree(tmp_path, {"a": "1", "b": "2", "c": "3"})
    fs, _ = t._fs(f"file://{tmp_path}/a")
    t._rename(fs, f"file://{tmp_path}/a", f"file://{tmp_path}/d")
    assert (tmp_path / "d").read_text() == "1" and not (tmp_path / "a").exists()
    with pytest.raises(Exception, match="exist"):
        t._rename(fs, f"file://{tmp_path}/b", f"file://{tmp_path}/c")
    assert (tmp_path / "c").read_text() == "3"


def test_compacted_versions_replace_those_before(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id", ["v"])
    assert t.compact() is None
    for rows in ([("a", 1), ("b", 1)], [("a", 2)], [("c", 1)]):
        t.run(spark.createDataFrame(rows, "id string, v int"), lambda c: c)
    before = sorted(map(tuple, t.state().collect()))
    assert t.compact() == 4 and len(t.published()) == 1 and sorted(map(tuple, t.state().collect())) == before
    assert t.changed(spark.createDataFrame([("a", 2), ("b", 2)], "id string, v int")).collect() == [("b", 2)]


@pytest.mark.parametrize("given", [{"max_entries": 2}, {"selection": ("a.txt",)}, {"max_total_bytes": 7}, {"include": ("*.txt",)}, {}])
def test_repack_equals_fresh_under_budgets_and_selection(spark, tmp_path, given):
    schema = "id string, relative string, bytes binary, size bigint, modified timestamp"
    files = spark.createDataFrame([(n, n, bytearray(b), len(b), T) for n, b in (("a.txt", b"one"), ("b!b.txt", b"two"), ("c.txt", b"three"), ("z.zip", bytes(zipped(x="1", y="2"))))] + [("d.txt", "d.txt", bytearray(b"new"), 3, None)], schema)
    opts = Options(follow_archives=True, **given)
    fresh = sorted(map(str, pack_df(files, opts).collect()))
    repack(spark, files, str(tmp_path / "cache"), Options(follow_archives=True, include=opts.include)).count()
    for _ in range(2):
        assert sorted(map(str, repack(spark, files, str(tmp_path / "cache"), opts).collect())) == fresh


def test_repack_equals_fresh(spark, tmp_path):
    schema = "id string, relative string, bytes binary, size bigint, modified timestamp"
    files = spark.createDataFrame([("a", "a.csv", bytearray(b"x\n1\n"), 4, T), ("b", "b.txt", bytearray(b"hi"), 2, T), ("c", "c.pdf", bytearray(b"%PDF-1"), 6, T)], schema)
    from folio.operators.pack import pack_df

    fresh = sorted(map(str, pack_df(files.select("id", "relative", "bytes"), Options()).collect()))
    for _ in range(2):
        assert sorted(map(str, repack(spark, files, str(tmp_path / "cache"), Options()).collect())) == fresh


def test_watch_publishes_each_batch_once(spark, tmp_path):
    src = spark.createDataFrame([("a", "a.txt", bytearray(b"one"))], "id string, relative string, bytes binary")
    src.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), src.schema, str(tmp_path / "out"), str(tmp_path / "cp"), Options()).awaitTermination()
    t = VersionedTable(spark, str(tmp_path / "out"), "id", ["relative"])
    assert [v for v, _ in t.published()] == [1] and t.state().head()["text"] == "one"


def zipped(**files: str) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(f"{name}.txt"), body)
    return bytearray(out.getvalue())


def test_watch_takes_changed_bytes_and_archives_over_batches(spark, tmp_path):
    schema = "id string, relative string, bytes binary"
    batches = [
        [("a", "a.txt", bytearray(b"one")), ("b!c", "b.txt", bytearray(b"same")), ("z", "z.zip", zipped(x="1", y="2")), ("n", "n.txt", None)],
        [("a", "a.txt", bytearray(b"two")), ("b!c", "b.txt", bytearray(b"same")), ("z", "z.zip", zipped(x="1", y="2")), ("n", "n.txt", bytearray(b"now"))],
        [("a", "a.txt", bytearray(b"one")), ("z", "z.zip", zipped(x="3"))],
        [("z", "z.zip", zipped())],
    ]
    new, texts = [], []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = spark.createDataFrame(rows, schema)
        watch(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), Options(follow_archives=True)).awaitTermination()
        last = VersionedTable(spark, str(tmp_path / "out"), "owner", []).published()[-1][1]
        new.append(sorted({r["owner"] for r in spark.read.parquet(f"{tmp_path}/out/{last}").collect()}))
        texts.append({r["id"]: r["text"] for r in watched(spark, str(tmp_path / "out")).collect()})
    assert new == [["a", "b!c", "n", "z"], ["a", "n"], ["a", "z"], ["z"]]
    assert [t["a"] for t in texts] == ["one", "two", "one", "one"] and texts[1]["n"] == "now" and texts[3]["b!c"] == "same"
    members = [{i: x for i, x in t.items() if i.startswith("z")} for t in texts]
    assert members == [{"z!z.zip/x.txt": "1", "z!z.zip/y.txt": "2"}] * 2 + [{"z!z.zip/x.txt": "3"}, {}]


def test_watch_keeps_the_last_delivery_of_a_batch(spark, tmp_path):
    schema = spark.createDataFrame([("a", "a.txt", bytearray(b""))], "id string, relative string, bytes binary").schema
    for k, body in enumerate((b"old", b"new", b"mid")):
        spark.createDataFrame([("a", "a.txt", bytearray(body))], schema).coalesce(1).write.parquet(str(tmp_path / f"d{k}"))
        (part,) = (tmp_path / f"d{k}").glob("part*")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(part, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1e9 + k, 1e9 + k))
    watch(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), Options()).awaitTermination()
    assert [r["text"] for r in watched(spark, str(tmp_path / "out")).collect()] == ["mid"]
