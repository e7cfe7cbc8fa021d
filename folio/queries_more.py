"""Queries of readers over generated files, of manifests and outcomes, and of versioned tables."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import incremental
from folio.functions import classify, tables, text
from folio.functions import paths as predicates
from folio.operators import archive, joins, manifest, pack, stats
from folio.operators.extract import markup
from folio.operators.extract.dispatch import extract
from folio.options import Options
from folio.plans.shared import materialized
from folio.sources import files
from folio.streaming.repack import repack

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_M = "m AS (SELECT * FROM manifest_entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = _read(spark, sf, "manifest_entries")
    return incremental.latest(m, ["id"], ["scanned_at"], [c for c in m.columns if c != "id"])


def _shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    materialized(spark.range(1))  # sets the folder where the session has none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


# ---- readers: rows are put into a format and read back -------------------------------------------


def made(make: Callable[..., bytes], kind: str, *columns: Column) -> Column:
    """The text that the reader of a kind finds in what ``make`` builds of a row's strings."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for df in batches:
            yield pd.Series([extract(make(*r), kind).text for r in df.itertuples(index=False)], dtype=object)

    return run(F.struct(*columns))


def _zip(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_nationkey").cast("string").alias("n"))


def _read_back(spark: SparkSession, sf: str, make: Callable[..., bytes], kind: str) -> DataFrame:
    return _customers(spark, sf).select("c_custkey", made(make, kind, F.col("a"), F.col("b"), F.col("n")).alias("text"))


def _docx(a: str, b: str, n: str) -> bytes:
    runs = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in (a, b)) + f"<w:p><w:r><w:t>n</w:t><w:tab/><w:t>{n}</w:t></w:r></w:p>"
    return _zip({"word/document.xml": f"<w:document xmlns:w='w'>{runs}</w:document>"})


@query("SELECT c_custkey, c_name || chr(10) || c_mktsegment || chr(10) || 'n' || chr(9) || c_nationkey AS text FROM customer")
def extract_docx(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, _docx, "docx")


def _pptx(a: str, b: str, n: str) -> bytes:
    slide = "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:t>{}</a:t></a:p></p:sld>"
    return _zip({"ppt/slides/slide10.xml": slide.format(b), "ppt/slides/slide2.xml": slide.format(a)})


@query("SELECT c_custkey, '## Slide 2' || chr(10) || c_name || chr(10) || chr(10) || '## Slide 10' || chr(10) || c_mktsegment AS text FROM customer")
def extract_pptx(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, _pptx, "pptx")


def _odt(a: str, b: str, n: str) -> bytes:
    return _zip({"content.xml": f"<o xmlns:t='t'><t:h>{a}</t:h><t:p>{b}<t:s t:c='3'/>{n}<t:tab/>end</t:p></o>"})


@query("SELECT c_custkey, c_name || chr(10) || c_mktsegment || '   ' || c_nationkey || chr(9) || 'end' AS text FROM customer")
def extract_odt(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, _odt, "odt")


def _xlsx(a: str, b: str, n: str) -> bytes:
    return _zip({
        "xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='S' r:id='r1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>",
        "xl/sharedStrings.xml": f"<sst><si><t>{a}</t></si><si><t>{b}</t></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c></row><row r='2'><c r='B2'><v>{n}</v></c></row></sheetData></worksheet>",
    })


@query("SELECT c_custkey, '## S' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |' || chr(10) || '| --- | --- |' || chr(10) || '|  | ' || c_nationkey || ' |' AS text FROM customer")
def extract_xlsx(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, _xlsx, "sheet")


def _ods(a: str, b: str, n: str) -> bytes:
    cell = "<t:table-cell t:number-columns-repeated='{}'>{}</t:table-cell>"
    row = "<t:table-row t:number-rows-repeated='{}'>{}</t:table-row>"
    rows = row.format(1, cell.format(1, a) + cell.format(2, b)) + row.format(2, cell.format(1, n)) + row.format(1_000_000, cell.format(16_000, ""))
    return _zip({"content.xml": f"<o xmlns:t='t'><t:table t:name='T'>{rows}</t:table></o>"})


@query("SELECT c_custkey, '## T' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' | ' || c_mktsegment || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || c_nationkey || ' |  |  |' || chr(10) || '| ' || c_nationkey || ' |  |  |' AS text FROM customer")
def extract_ods(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, _ods, "sheet")


def _epub(a: str, b: str, n: str) -> bytes:
    return _zip({
        "META-INF/container.xml": "<container><rootfiles><rootfile full-path='O/c.opf'/></rootfiles></container>",
        "O/c.opf": "<package><manifest><item id='b' href='b.xhtml'/><item id='a' href='a.xhtml'/></manifest><spine><itemref idref='b'/><itemref idref='a'/></spine></package>",
        "O/a.xhtml": f"<h1>{a}</h1><p>{n}</p>", "O/b.xhtml": f"<p>{b}</p>",
    })


@query("SELECT c_custkey, '# O/b.xhtml' || chr(10) || c_mktsegment || chr(10) || chr(10) || '# O/a.xhtml' || chr(10) || '# ' || c_name || chr(10) || chr(10) || c_nationkey AS text FROM customer")
def extract_epub(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, _epub, "epub")


def _rtf(a: str, b: str, n: str) -> bytes:
    return rb"{\rtf1\ansi{\fonttbl{\f0 X;}}{\*\generator no;}" + a.encode() + rb"\par caf\'e9 \u8364?\par " + b.encode() + rb"{\footnote note " + n.encode() + rb"}\bin3 }}}\par}"


@query("SELECT c_custkey, c_name || chr(10) || 'café €' || chr(10) || c_mktsegment || '[1]' || chr(10) || chr(10) || '[1] note ' || c_nationkey AS text FROM customer")
def extract_rtf(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, _rtf, "rtf")


def _pdf(a: str, b: str, n: str) -> bytes:
    def page(k: int, s: str) -> str:
        return f"{k} 0 obj\n<< >>\nstream\nBT /F1 12 Tf ({s}) Tj ET\nendstream\nendobj\n"

    tree = "1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [7 0 R 6 0 R] >>\nendobj\n6 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n7 0 obj\n<< /Type /Page /Contents [5 0 R] >>\nendobj\n"
    return ("%PDF-1.4\n" + page(4, b) + page(5, a) + tree).encode()


@query("SELECT c_custkey, c_name || chr(10) || chr(10) || c_mktsegment AS text FROM customer")
def extract_pdf(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in the order of the page tree, not of the file."""
    return _read_back(spark, sf, _pdf, "pdf")


def _npy(a: str, b: str, n: str) -> bytes:
    out = io.BytesIO()
    np.save(out, np.array([[int(n), 1], [2, 3]], "<i8"))
    return out.getvalue()


_NPY = "'format: npy' || chr(10) || 'descr: <i8' || chr(10) || 'fortran_order: false' || chr(10) || 'shape: (2, 2)' || chr(10) || 'elements: 4' || chr(10) || 'preview: [[' || c_nationkey || ', 1], [2, 3]]'"


@query(f"SELECT c_custkey, {_NPY} AS text FROM customer")
def extract_npy(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, _npy, "npy")


@query(f"SELECT c_custkey, '## x.npy' || chr(10) || {_NPY} AS text FROM customer")
def extract_npz(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(spark, sf, lambda a, b, n: _zip({"x.npy": _npy(a, b, n)}), "npz")


def _html(a: str, b: str, n: str) -> bytes:
    return f"<!doctype html><head><title>no</title></head><h2>{a}</h2><p>See <a href='/s?x=1&amp;n={n}'>the <em>{b}</em></a><ul><li>one<li>{n}</ul><table><tr><th>k<th>v<tr><td>n<td>{n}</table><script>'</p>'</script><pre> as\n  is</pre>".encode()


@query("""SELECT c_custkey, '## ' || c_name || chr(10) || chr(10) || 'See [the *' || c_mktsegment || '*][1]' || chr(10) || chr(10) || '* one' || chr(10) || '* ' || c_nationkey || chr(10) || chr(10)
|| '─┬' || repeat('─', w) || chr(10) || 'k│v' || chr(10) || '─┼' || repeat('─', w) || chr(10) || 'n│' || c_nationkey || chr(10) || '─┴' || repeat('─', w) || chr(10) || chr(10) || ' as' || chr(10) || '  is' || chr(10) || chr(10) || '[1]: /s?x=1&n=' || c_nationkey || chr(10) AS text
FROM (SELECT *, length(CAST(c_nationkey AS VARCHAR)) AS w FROM customer)""")
def html_render(spark: SparkSession, sf: str) -> DataFrame:
    """Headings, links, lists, tables and preformatted text of a page with the usual faults."""
    return _read_back(spark, sf, _html, "html")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decode_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in UTF-16 with a mark, and in UTF-8 with one, come back as they were."""
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))

    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: extract(bytes(b), "text").text)

    return _read(spark, sf, "documents").select("doc_id", F.md5(read(F.when(F.col("doc_id") % 2 == 0, wide).otherwise(marked))).alias("text_md5"))


@query("SELECT p_partkey, CASE WHEN length(t) > 60 THEN regexp_replace(left(t, 57), ' [^ ]*$', '') || '...' ELSE t END AS title FROM (SELECT p_partkey, repeat(p_name || ' & ', 1 + p_size % 4) || p_brand AS t FROM part)")
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("<html><head><TITLE id=x>\n "), F.expr("repeat(concat(p_name, ' &amp; '), cast(1 + p_size % 4 as int))"), F.col("p_brand"), F.lit("  </title>"))

    @F.pandas_udf("string")
    def title(pages: pd.Series) -> pd.Series:
        return pages.map(markup.page_title)

    return _read(spark, sf, "part").select("p_partkey", title(page).alias("title"))


def _tar(text_: str | None) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name in ("in/a.txt", "../out.txt", "in/b.txt"):
            body = (text_ or "").encode()
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


@query("SELECT 'd' || doc_id || '!x/d' || doc_id || '.tar.gz/in/' || n || '.txt' AS id, md5(text) AS text_md5, 'extracted' AS status FROM documents, (VALUES ('a'), ('b')) AS t(n)")
def tar_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed tar archives; a name that climbs out is left out."""

    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(_tar)

    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    tars = _read(spark, sf, "documents").select(name.alias("id"), F.concat(F.lit("x/"), name, F.lit(".tar.gz")).alias("relative"), packed("text").alias("bytes"))
    return pack.pack_df(tars, Options(follow_archives=True, max_total_bytes=1 << 62)).select("id", F.md5("text").alias("text_md5"), "status")


@query("""WITH s AS (SELECT doc_id, strlen(text) AS n FROM documents), a AS (SELECT *, n <= 6000 AS a FROM s), b AS (SELECT *, CASE WHEN a THEN 6000 - n ELSE 6000 END AS l FROM a),
c AS (SELECT *, 900 <= l AS b FROM b) SELECT doc_id, a AS has_a, b AS has_b, n <= l - CASE WHEN b THEN 900 ELSE 0 END AS has_c, NOT a OR NOT b OR NOT n <= l - CASE WHEN b THEN 900 ELSE 0 END AS cut FROM c""")
def archive_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A member that does not fit what is left is skipped, smaller ones after it may still fit."""

    @F.pandas_udf("has_a boolean, has_b boolean, has_c boolean, cut boolean")
    def taken(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spent = archive.Budget(copied=6_000)
            names = [m.name for m in archive.zip_members(_zip({"a": t or "", "b": "b" * 900, "c": t or ""}), 1 << 20, spent)]
            rows.append(("a" in names, "b" in names, "c" in names, spent.cut))
        return pd.DataFrame(rows, columns=["has_a", "has_b", "has_c", "cut"])

    return _read(spark, sf, "documents").select("doc_id", taken("text").alias("t")).select("doc_id", "t.*")


# ---- kinds by content ----------------------------------------------------------------------------

_HEADS = {0: ("%PDF-1.7", "pdf"), 1: ("{\\rtf1 ", "rtf"), 2: ("<!DOCTYPE html>", "html"), 3: ("<?xml version='1.0'?>", "xml"), 4: ("GIF89a", "binary"), 5: ("", "text"), 6: ("\x01\x02\x03\x04", "binary")}


@query("SELECT doc_id, CASE doc_id % 14 " + " ".join(f"WHEN {2 * k} THEN '{kind}'" for k, (_, kind) in _HEADS.items()) + " ELSE 'json' END AS kind FROM documents")
def sniff_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Names that do not decide the kind are sniffed by their first 8 KiB, the rest is not."""
    k = F.col("doc_id") % 14
    start = F.lit("x")
    for n, (head, kind) in _HEADS.items():
        start = F.when(k == 2 * n, F.concat(F.lit(head), F.repeat(F.lit("\x01 "), 4_096)) if kind == "binary" and not head.startswith("GIF") else F.concat(F.lit(head), F.lit(" "), F.coalesce("text", F.lit("")))).otherwise(start)
    d = _read(spark, sf, "documents").select("doc_id", F.when(k % 2 == 0, "a/noext").otherwise("a/b.json").alias("relative"), F.col("n_chars").alias("size"), F.substring(F.encode(start, "UTF-8"), 1, 8_192).alias("head"))
    return pack.scan_df(d, Options()).select("doc_id", "kind")


@query("""WITH p AS (SELECT id, CASE WHEN ord(right(id, 1)) % 3 = 0 THEN replace(text, 'e', chr(1)) ELSE text END AS t FROM packed_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY packed_at DESC) = 1),
b AS (SELECT id, regexp_replace(left(hex(encode(t)), 16384), '(..)', '\\1 ', 'g') AS h FROM p)
SELECT id, coalesce((length(h) - length(regexp_replace(h, '(0[0-8EF]|1[0-9AC-F]) ', '', 'g'))) * 32 > length(h), false) AS binary_like FROM b""")
def looks_binary_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Every record, in a third of them a letter replaced by a control character."""
    p = _read(spark, sf, "packed_files")
    p = incremental.latest(p, ["id"], ["packed_at"], ["text"])
    t = F.when(F.ascii(F.right("id", F.lit(1))) % 3 == 0, F.replace("text", F.lit("e"), F.lit("\x01"))).otherwise(F.col("text"))
    return p.select("id", classify.looks_binary(F.encode(t, "UTF-8")).alias("binary_like"))


@query(f"WITH {_M} SELECT kind, kind IN ('pdf', 'docx', 'pptx', 'sheet', 'odt', 'odp', 'epub', 'rtf') AS heavy, count(*) AS n FROM m GROUP BY ALL")
def isolation_class(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).groupBy("kind", classify.is_heavy("kind").alias("heavy")).agg(F.count(F.lit(1)).alias("n")).withColumn("heavy", F.when(F.col("kind").isNull(), F.lit(None)).otherwise(F.col("heavy")))


# ---- paths ---------------------------------------------------------------------------------------


@query(f"WITH {_M} SELECT id, array_to_string(list_filter(string_split('./a//' || relative || '/.', '/'), lambda c: c NOT IN ('', '.')), '/') AS joined FROM m")
def join_relative(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("id", text.join_relative(F.concat(F.lit("./a//"), F.col("relative"), F.lit("/."))).alias("joined"))


@query(f"WITH {_M} SELECT id, ord(right(id, 1)) % 5 <> 0 OR starts_with(relative, '/') AS unsafe FROM m")
def unsafe_members(spark: SparkSession, sf: str) -> DataFrame:
    k = F.ascii(F.right("id", F.lit(1))) % 5
    name = F.concat(F.when(k == 0, "").when(k == 1, "/").when(k == 2, "../").when(k == 3, "C:").otherwise("a/..\\"), F.col("relative"))
    return _manifest(spark, sf).select("id", text.is_unsafe_member(name).alias("unsafe"))


@query(f"WITH {_M} SELECT id, relative || '\\n\\u{{202e}}\\u{{7f}}' AS shown FROM m")
def display_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("id", text.display_path(F.concat(F.col("relative"), F.lit("\n\u202e\x7f"))).alias("shown"))


@query("WITH g AS (SELECT root_id, CASE WHEN min(split_part(relative, '/', 1)) = max(split_part(relative, '/', 1)) AND min(length(relative) - length(replace(relative, '/', ''))) > 0 THEN min(split_part(relative, '/', 1)) END AS root FROM manifest_entries GROUP BY root_id) SELECT DISTINCT m.id, CASE WHEN g.root IS NULL THEN m.relative ELSE substr(m.relative, length(g.root) + 2) END AS inner_path FROM manifest_entries m JOIN g USING (root_id)")
def strip_grant_root(spark: SparkSession, sf: str) -> DataFrame:
    """Paths without the folder that all of a project share."""
    m = _read(spark, sf, "manifest_entries").select("id", "root_id", "relative")
    return m.join(joins.shared_root(m, by=["root_id"]), "root_id").select("id", manifest.under_root("relative", "root").alias("inner_path")).distinct()


@query(f"""WITH {_M}, d AS (SELECT DISTINCT array_to_string(string_split(root_relative, '/')[:-2], '/') AS folder FROM m)
SELECT folder, folder = '' OR NOT (list_bool_or(list_transform(string_split(folder, '/'), lambda c: starts_with(c, '.') AND c NOT IN ('.', '..'))) OR list_has_any(string_split(folder, '/'), [{', '.join(repr(d) for d in tables.GENERATED_DIRS)}])
 OR regexp_matches(folder, '\\.(egg|dist)-info(/|$)') OR regexp_matches(folder, '(^|/)(\\.env\\.[^/]*|id_rsa\\.[^/]*)/')) AS enter FROM d""")
def folder_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Which folders of the manifest a walk would open."""
    parts = F.split("root_relative", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder")
    return _manifest(spark, sf).select(folder).distinct().select("folder", manifest.may_enter("folder").alias("enter"))


@query(f"WITH {_M} SELECT root_id, count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes FROM m GROUP BY root_id")
def manifest_totals(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.manifest_bytes(_manifest(spark, sf), "root_id")


# ---- ticks, selections, batches ------------------------------------------------------------------

_OFF = "coalesce(oversized, false)"


@query(f"WITH {_M} SELECT id, CASE WHEN {_OFF} THEN coalesce(default_on, false) WHEN suffix(lower(relative), '.md') THEN false WHEN starts_with(relative, split_part(relative, '/', 1) || '/docs/') THEN true ELSE coalesce(default_on, false) END AS ticked FROM m")
def bulk_select(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of every project ticked, then a pattern unticked."""
    m = _manifest(spark, sf)
    docs = manifest.tick(m, True, F.col("relative").startswith(F.concat(F.split_part("relative", F.lit("/"), F.lit(1)), F.lit("/docs/"))))
    return manifest.tick_pattern(docs, "*.md", False).select("id", "ticked")


@query(f"""WITH {_M}, l AS (SELECT coalesce(language, 'text') AS language, bool_and(coalesce(default_on, false)) AS full_ FROM m WHERE NOT {_OFF} AND coalesce(language, 'text') IN ('python', 'rust') GROUP BY 1)
SELECT m.id, CASE WHEN NOT {_OFF} AND l.language IS NOT NULL THEN NOT l.full_ ELSE coalesce(default_on, false) END AS ticked FROM m LEFT JOIN l ON l.language = coalesce(m.language, 'text')""")
def toggle_languages(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.toggle_languages(_manifest(spark, sf), ["python", "rust"]).select("id", "ticked")


@query(f"WITH {_M} SELECT (SELECT count(*) FROM (SELECT id FROM m WHERE default_on EXCEPT SELECT id FROM m WHERE {_OFF} IS FALSE AND default_on)) + (SELECT count(*) FROM (SELECT id FROM m WHERE {_OFF} IS FALSE AND default_on EXCEPT SELECT id FROM m WHERE default_on)) = 0 AS same")
def same_selection(spark: SparkSession, sf: str) -> DataFrame:
    m = _manifest(spark, sf)
    return manifest.same_selection(m.where("default_on").select("id"), m.where("default_on AND NOT coalesce(oversized, false)").select("id"))


@query(f"WITH {_M} SELECT id FROM m WHERE id IN (SELECT id FROM packed_files) UNION SELECT id FROM m WHERE relative IN (SELECT id FROM packed_files WHERE id NOT IN (SELECT id FROM m))")
def stored_selection(spark: SparkSession, sf: str) -> DataFrame:
    """A stored manifest cut to what was packed."""
    return manifest.selected_manifest(_manifest(spark, sf), _read(spark, sf, "packed_files").select("id"), "id").select("id")


@query(f"WITH {_M} SELECT count(*) AS n_files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total, 0 AS over_files, 0 AS over_bytes, 0 AS not_alone FROM m")
def read_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Every file in one batch, and no batch over its limits."""
    b = manifest.batches(_manifest(spark, sf).select("id", "relative", "kind", "size"))
    alone = F.col("kind").isin(*tables.HEAVY_KINDS, *tables.ARCHIVE_KINDS)
    own = b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("s"), F.count_if(alone).alias("h"))
    return own.agg(
        F.sum("n").alias("n_files"), F.sum("s").alias("total"), F.count_if(F.col("n") > manifest.BATCH_FILES).cast("int").alias("over_files"),
        F.count_if((F.col("n") > 1) & (F.col("s") > manifest.BATCH_BYTES)).cast("int").alias("over_bytes"), F.count_if((F.col("h") > 0) & (F.col("n") > 1)).cast("int").alias("not_alone"),
    )


@query("SELECT DISTINCT id, CAST(i - 1 AS INTEGER) AS place, positions[i] AS position FROM (SELECT id, positions, unnest(range(1, len(positions) + 1)) AS i FROM cache_entries)")
def cached_positions(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.cached_positions(_read(spark, sf, "cache_entries")).distinct()


@query("""WITH c AS (SELECT DISTINCT c.id, c.path, c.size, c.modified, c.archive_cut, c.fingerprint, c.run_id FROM cache_entries c), m AS (SELECT DISTINCT id, absolute, size, modified FROM manifest_entries WHERE modified IS NOT NULL)
SELECT DISTINCT m.id FROM m JOIN c ON c.id = m.id AND c.path = m.absolute AND c.size = m.size AND c.modified = m.modified WHERE c.fingerprint = (SELECT max(fingerprint) FROM pack_runs) AND (NOT c.archive_cut OR c.run_id = 2)""")
def reusable_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Reuse under equal text settings; what an archive left, under equal member settings too."""
    key = _read(spark, sf, "pack_runs").agg(F.max("fingerprint")).head()[0]
    had = _read(spark, sf, "cache_entries").select("id", F.col("path").alias("relative"), "size", "modified", F.col("archive_cut").alias("archive"), F.col("fingerprint").alias("text_key"), F.col("run_id").cast("string").alias("member_key"))
    now = _read(spark, sf, "manifest_entries").select("id", F.col("absolute").alias("relative"), "size", "modified")
    return manifest.reusable(now, had, key, "2").distinct()


# ---- outcomes ------------------------------------------------------------------------------------

_NOTES = """CASE status WHEN 'skipped_binary' THEN '[binary file, ' || size || ' bytes]' WHEN 'too_large' THEN '[too large: ' || size || ' bytes; limit ' || status_limit || ' bytes]' WHEN 'error' THEN '[error extracting ' || relative || ': ' || status_detail || ']'
 WHEN 'unreadable' THEN '[' || kind || ' unreadable: ' || status_detail || ']' WHEN 'changed' THEN '[changed since scan: ' || status_detail || ']' WHEN 'skipped_archive' THEN '[archive ' || relative || ', ' || size || ' bytes; ' || coalesce(status_detail, 'pass --archives to expand nested archives') || ']' END"""


@query(f"SELECT DISTINCT id, {_NOTES} AS note FROM packed_files")
def notes(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "packed_files").select("id", text.note("status", "relative", "kind", "size", "status_limit", "status_detail").alias("note")).distinct()


@query("""WITH p AS (SELECT DISTINCT id, relative, kind, size, status, status_limit, status_detail, text FROM packed_files)
SELECT count(*) AS n, count(*) FILTER (status = 'extracted') AS n_extracted, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes, CAST(sum(status_limit) AS BIGINT) AS limits FROM p""")
def wire_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes written as JSON and read again lose nothing."""
    columns = ["id", "relative", "kind", "size", "status", "status_limit", "status_detail", "text"]
    back = manifest.from_wire(manifest.to_wire(_read(spark, sf, "packed_files"))).select(*columns).distinct()
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "extracted").alias("n_extracted"), F.sum("size").alias("bytes"), F.sum(F.octet_length("text").cast("bigint")).alias("text_bytes"), F.sum("status_limit").alias("limits"))


@query("""WITH p AS (SELECT DISTINCT id, relative, status, status_detail FROM packed_files WHERE status = 'changed')
SELECT 'Nothing extracted. Check size limits / binaries / archives. Sample: ' || string_agg(relative || ' [changed]: File changed on disk after the scan. Rescan, then pack again so the dump matches the current bytes.', ', ' ORDER BY relative, id) AS error FROM (SELECT * FROM p ORDER BY relative, id LIMIT 5)""")
def nothing_extracted(spark: SparkSession, sf: str) -> DataFrame:
    """The error of a pack all of whose files had changed (five are its feature)."""
    p = _read(spark, sf, "packed_files").where("status = 'changed'")
    return manifest.nothing_extracted(incremental.latest(p, ["id"], ["packed_at"], [c for c in p.columns if c != "id"]))


@query("""WITH h AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)
SELECT doc_id, md5(CASE WHEN length(h) <= 2000 THEN text WHEN substr(h, 2001, 1) NOT IN ('8', '9', 'A', 'B') THEN decode(from_hex(left(h, 2000))) WHEN substr(h, 1999, 1) NOT IN ('8', '9', 'A', 'B') THEN decode(from_hex(left(h, 1998)))
 WHEN substr(h, 1997, 1) NOT IN ('8', '9', 'A', 'B') THEN decode(from_hex(left(h, 1996))) ELSE decode(from_hex(left(h, 1994))) END) AS head_md5 FROM h""")
def preview_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The longest prefix of whole characters within 1,000 bytes."""
    return _read(spark, sf, "documents").select("doc_id", F.md5(text.cap_utf8("text", 1_000)).alias("head_md5"))


@query("""SELECT count(*) FILTER (status = 'extracted') AS files_extracted, bool_or(status = 'skipped_archive') OR true AS truncated, false AS cancelled FROM (SELECT DISTINCT id, status FROM packed_files)""")
def pack_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a pack whose budget cut files off."""
    p = _read(spark, sf, "packed_files")
    once = incremental.latest(p, ["id"], ["packed_at"], ["status", "text", "size"]).withColumn("archive_cut", F.lit(False))
    return stats.finished(once, cut=3).select("files_extracted", "truncated", "cancelled")


# ---- versions ------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT * FROM walked_files QUALIFY row_number() OVER (PARTITION BY scan_no, id ORDER BY seen_at DESC, absolute DESC NULLS LAST, size DESC NULLS LAST, modified DESC NULLS LAST) = 1),
s AS (SELECT * FROM w WHERE scan_no IN (3, 4) QUALIFY row_number() OVER (PARTITION BY id ORDER BY scan_no DESC) = 1)
SELECT n.id FROM w n LEFT JOIN s ON s.id = n.id WHERE n.scan_no = 5 AND (s.id IS NULL OR s.absolute IS DISTINCT FROM n.absolute OR s.size IS DISTINCT FROM n.size OR s.modified IS NULL OR n.modified IS NULL OR s.modified <> n.modified)""")
def p4_third_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two scans are published as versions of a table; what a run over the third would process."""
    w = _read(spark, sf, "walked_files").select("id", "absolute", "size", "modified", "seen_at", "scan_no")
    table = incremental.VersionedTable(spark, _shared_folder(spark), "id", ["absolute", "size", "modified"], order=["seen_at"])
    for n in (3, 4):
        table.run(w.where(F.col("scan_no") == n), lambda changed: changed)
    return table.changed(w.where("scan_no = 5")).select("id")


@query("SELECT 'd' || doc_id AS id, md5(text) AS text_md5, 'extracted' AS status FROM documents")
def repack_equals_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """A first pack of half the documents fills the cache; the second pack of all of them uses it."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    raw = F.encode("text", "UTF-8")
    docs = _read(spark, sf, "documents").select("doc_id", name.alias("id"), F.concat(F.lit("x/"), name, F.lit(".txt")).alias("relative"), raw.alias("bytes"), F.octet_length("text").cast("bigint").alias("size"), F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("modified"))
    cache, opts = _shared_folder(spark), Options(max_total_bytes=1 << 62)
    repack(spark, docs.where("doc_id % 2 = 0"), cache, opts).agg(F.count(F.lit(1))).collect()
    return repack(spark, docs, cache, opts).select("id", F.md5("text").alias("text_md5"), "status")


@query(f"WITH {_M}, k AS (SELECT *, row_number() OVER (ORDER BY string_split(relative, '/'), id) AS n FROM m) SELECT id, kind FROM k WHERE n <= 900")
def admitted_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan of supplied names and sizes under an entry budget, no byte read."""
    m = _manifest(spark, sf).select("id", "relative", "size", "kind")
    return pack.admitted(m, Options(hidden=True, default_excludes=False, max_entries=900, max_total_bytes=1 << 62)).select("id", "kind")



# ---- folders -------------------------------------------------------------------------------------


def _written(spark: SparkSession, sf: str, name: str = "tree") -> str:
    """The nations as files below a new folder that all executors share, with files a walk leaves out."""
    root = f"{_shared_folder(spark)}/{name}".removeprefix("file:")
    root = "/" + root.lstrip("/")
    for r in _read(spark, sf, "nation").toLocalIterator():  # 25 rows
        made_of = {f"r{r['n_regionkey']}/n{r['n_nationkey']}.txt": r["n_name"], f"r{r['n_regionkey']}/.n{r['n_nationkey']}": "hidden", f"node_modules/n{r['n_nationkey']}.js": "left out", f"r{r['n_regionkey']}/n{r['n_nationkey']}.tmp": "ignored"}
        for path, body in made_of.items():
            os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
            with open(f"{root}/{path}", "w") as f:
                f.write(body)
    with open(f"{root}/.ignore", "w") as f:
        f.write("*.tmp\n!n7.tmp\n/r3/\n")
    return root


@query("SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.txt' AS id, n_name AS text, 'extracted' AS status FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 'r' || n_regionkey || '/n7.tmp', 'ignored', 'extracted' FROM nation WHERE n_nationkey = 7 AND n_regionkey <> 3")
def walk_and_pack(spark: SparkSession, sf: str) -> DataFrame:
    """A folder walked, filtered, read and packed: ignore files, hidden and default names."""
    opts = Options(roots=(_written(spark, sf),), max_total_bytes=1 << 62)
    return pack.read_rows(files.with_bytes(pack.admitted(files.scan(spark, opts), opts), opts.max_file_size), opts).select("id", "text", "status")


@query("SELECT k || ':' || l || '/r' || n_regionkey || '/n' || n_nationkey || '.txt' AS id, l || '/r' || n_regionkey || '/n' || n_nationkey || '.txt' AS relative, 'r' || n_regionkey || '/n' || n_nationkey || '.txt' AS root_relative, CAST(length(n_name) AS BIGINT) AS size FROM nation, (VALUES (0, 'one'), (1, 'two')) AS t(k, l)")
def walk_two_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Two roots at once: labels, ids and paths under each root, ignore files not asked."""
    opts = Options(roots=(_written(spark, sf, "one"), _written(spark, sf, "two")), gitignore=False, exclude=("*.tmp",))
    return files.scan(spark, opts).select("id", "relative", "root_relative", "size")


@query("""SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.txt' AS id, CASE n_nationkey % 3 WHEN 0 THEN 'extracted' ELSE 'changed' END AS status,
CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN '[changed since scan: no longer there]' ELSE '[changed since scan: replaced by a symlink]' END AS text FROM nation""")
def changed_since_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files that vanish or become links between the scan and the pack."""
    root = _written(spark, sf)
    opts = Options(roots=(root,), gitignore=False, include=("*.txt",), max_total_bytes=1 << 62)
    found = materialized(files.scan(spark, opts))
    for r in _read(spark, sf, "nation").where("n_nationkey % 3 > 0").toLocalIterator():
        path = f"{root}/r{r['n_regionkey']}/n{r['n_nationkey']}.txt"
        os.unlink(path)
        if r["n_nationkey"] % 3 == 2:
            os.symlink("/etc/hostname", path)
    return pack.read_rows(files.with_bytes(pack.admitted(found, opts), opts.max_file_size), opts).select("id", "status", "text")


@query("SELECT count(*) AS n_warnings, least(count(*), 10) AS n_kept FROM nation")
def walk_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Links that lead nowhere, each a warning; the first are kept."""
    root = _written(spark, sf)
    for r in _read(spark, sf, "nation").toLocalIterator():
        os.symlink("nowhere", f"{root}/r{r['n_regionkey']}/broken{r['n_nationkey']}")
    n, kept = files.warnings(files.scan_all(spark, Options(roots=(root,), follow_links=True, gitignore=False)), keep=10)
    return spark.createDataFrame([(n, len(kept))], "n_warnings bigint, n_kept bigint")


@query("SELECT 'r' || n_regionkey AS folder, count(*) AS n_files FROM nation GROUP BY ALL")
def walk_skips_the_output(spark: SparkSession, sf: str) -> DataFrame:
    """A dump that stands in the folder it is made of, and a second name for it, are left out."""
    root = _written(spark, sf)
    with open(f"{root}/r0/dump.txt", "w") as f:
        f.write("the dump")
    os.link(f"{root}/r0/dump.txt", f"{root}/r1/other.txt")
    walked = files.scan(spark, Options(roots=(root,), gitignore=False, include=("*.txt",), exclude=("*.tmp",)))
    st = os.stat(f"{root}/r0/dump.txt")
    skip = spark.createDataFrame([(f"{root}/r0/dump.txt", st.st_dev, st.st_ino)], "absolute string, dev bigint, ino bigint")
    return predicates.skip_files(walked, skip).groupBy(F.split_part("relative", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))
