"""Queries of the readers: the tables' rows are put into each format, read back and compared."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import parts
from folio.operators.extract import markup
from folio.operators.extract.dispatch import extract
from folio.operators.pack import pack_df
from folio.options import Options

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WS = text.WHITE[1:-1]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def extracted(body: Column, kind: str) -> Column:
    """Text of bytes of a kind; Arrow batches in and out."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: extract(bytes(b), kind).text if b is not None else None)

    return run(body)


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[{WS}]+', ' ', 'g'), '^ | $', '', 'g')) AS text_md5 FROM documents")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    """The tag stripper, which reads what is not laid out."""

    @F.pandas_udf("string")
    def stripped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: markup.strip_tags(t) if t is not None else None)

    page = F.concat(F.lit("<!doctype html><html><head><style>p { x }</style></head><body><script>'</p>'</script><!-- <p>no</p> --><div><p>"), text.xml_escape("text"), F.lit("</p></div></body></html>"))
    return _read(spark, sf, "documents").select("doc_id", F.md5(stripped(page)).alias("text_md5"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')) AS text_md5 FROM documents")
def xml_text(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("<?xml version='1.0'?><doc><p>"), text.xml_escape("text"), F.lit("</p></doc>"))
    return _read(spark, sf, "documents").select("doc_id", F.md5(extracted(_bytes(page), "xml")).alias("text_md5"))


@query("SELECT event_id, regexp_replace(regexp_replace(regexp_replace(props, '^\\{', '{' || chr(10) || '  '), '\\}$', chr(10) || '}'), ', ', ',' || chr(10) || '  ', 'g') AS pretty FROM events")
def json_pretty_props(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_id", extracted(_bytes(F.col("props")), "json").alias("pretty"))


@query("SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey) AS markdown FROM nation")
def csv_markdown_nation(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(','), F.col("n_name"), F.lit("\n"))
    body = _read(spark, sf, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "").alias("body"))
    return body.select(extracted(_bytes(F.concat(F.lit("n_nationkey,n_name\n"), F.col("body"))), "csv").alias("markdown"))


@query("SELECT doc_id, md5('## Cell 0 (markdown)' || chr(10) || text || CASE WHEN text = '' OR suffix(text, chr(10)) THEN '' ELSE chr(10) END || chr(10) || '## Cell 1 (code)' || chr(10) || 'x = 1' || chr(10)) AS text_md5 FROM documents")
def notebook_cells(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda kind, source: F.struct(F.lit(kind).alias("cell_type"), source.alias("source"))
    book = F.to_json(F.struct(F.array(cell("markdown", F.col("text")), cell("code", F.lit("x = 1"))).alias("cells")))
    return _read(spark, sf, "documents").select("doc_id", book.alias("book")).select("doc_id", extracted(_bytes(F.col("book")), "ipynb").alias("t")).select("doc_id", F.md5("t").alias("text_md5"))


def _zipped(texts: Column, nested: bool) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> bytes:
            body, name = (t or "").encode(), "in/note.txt"
            for _ in range(1 + nested):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(name, body)
                body, name = out.getvalue(), "inner.zip"
            return body

        return s.map(one)

    return run(texts)


@query("SELECT 'd' || doc_id || '!x/d' || doc_id || '.zip/in/note.txt' AS id, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS text_md5, 'extracted' AS status FROM documents")
def archive_expand(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    files = _read(spark, sf, "documents").select(name.alias("id"), F.concat(F.lit("x/"), name, F.lit(".zip")).alias("relative"), _zipped(F.col("text"), False).alias("bytes"))
    return pack_df(files, Options(follow_archives=True, max_total_bytes=1 << 62)).select("id", "size", F.md5("text").alias("text_md5"), "status")


@query("SELECT 'd' || doc_id || '!x/d' || doc_id || '.zip/inner.zip!x/d' || doc_id || '.zip/inner.zip/in/note.txt' AS id, md5(text) AS text_md5 FROM documents")
def archive_nested(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    files = _read(spark, sf, "documents").select(name.alias("id"), F.concat(F.lit("x/"), name, F.lit(".zip")).alias("relative"), _zipped(F.col("text"), True).alias("bytes"))
    return pack_df(files, Options(follow_archives=True, max_total_bytes=1 << 62)).select("id", F.md5("text").alias("text_md5"))


@query("SELECT 'd' || doc_id AS id, 'pdf' AS kind, md5('[not a PDF: ' || CASE WHEN text = '' THEN 'the file is empty]' ELSE 'it holds plain text]' || chr(10) || text END) AS text_md5 FROM documents")
def misnamed_documents(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    files = _read(spark, sf, "documents").select(name.alias("id"), F.concat(name, F.lit(".pdf")).alias("relative"), _bytes(F.col("text")).alias("bytes"))
    return pack_df(files, Options(max_total_bytes=1 << 62)).select("id", "kind", F.md5("text").alias("text_md5"))


@query("SELECT DISTINCT id, md5(text) AS joined_md5, true AS within FROM packed_files")
def dump_parts(spark: SparkSession, sf: str) -> DataFrame:
    cut = parts.parts(_read(spark, sf, "packed_files").select("id", "text"), "id", "text")  # rows packed twice fall together in the set
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("part_no", "part"))), lambda x: x["part"]), "")
    return cut.groupBy("id").agg(F.md5(joined).alias("joined_md5"), (F.max(F.octet_length("part")) <= parts.LIMIT).alias("within"))
