"""The registered queries of the core and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import incremental, queries_extract, queries_more
from folio.functions import classify, paths, tables, text
from folio.operators import budget, joins, render, stats, tree
from folio.plans.shared import numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


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
    """The newest row of each manifest entry."""
    m = _read(spark, sf, "manifest_entries")
    return incremental.latest(m, ["id"], ["scanned_at"], [c for c in m.columns if c != "id"])


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    """Each packed record once (rows packed again have equal texts)."""
    p = _read(spark, sf, "packed_files")
    return incremental.latest(p, ["id"], ["packed_at"], [c for c in p.columns if c != "id"])


def _values(table: dict[str, str], k: str, v: str) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in table.items()) + f") AS t({k}, {v})"


def _in(names) -> str:  # noqa: ANN001
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _re(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


# SQL fragments shared by the comparisons
_M = "m AS (SELECT * FROM manifest_entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)"
_P = "p AS (SELECT * FROM packed_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY packed_at DESC) = 1)"
_BASE = "list_extract(string_split(relative, '/'), -1)"
_EXT = f"nullif(regexp_extract(lower({_BASE}), '^.+\\.([^.]*)$', 1), '')"
_WIDE = f"(length(text) - length(regexp_replace(text, {_re(text.WIDE)}, '', 'g')))"
_OTHER = f"(length(regexp_replace(text, {_re(text.WHITE)}, '', 'g')) - {_WIDE})"



def _xml(c: str) -> str:
    return f"regexp_replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), {_re(text.NOT_XML)}, chr(65533), 'g')"


_HIDDEN = "list_bool_or(list_transform(string_split(relative, '/'), lambda c: starts_with(c, '.') AND c NOT IN ('.', '..')))"
_FENCE = "(greatest(2, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0)) + 1)"


# ---- incremental ----------------------------------------------------------------------------


@query("""
WITH pending AS (SELECT scan_no, fingerprint FROM pack_runs WHERE run_status = 'pending'),
now AS (
  SELECT w.* FROM walked_files w JOIN pending p USING (scan_no)
  QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY w.seen_at DESC, w.absolute DESC NULLS LAST, w.size DESC NULLS LAST, w.modified DESC NULLS LAST) = 1),
known AS (
  SELECT c.* FROM cache_entries c JOIN pack_runs r USING (run_id) JOIN pending p ON p.fingerprint = r.fingerprint
  WHERE r.run_status = 'succeeded'
  QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY c.run_id DESC, c.written_at DESC) = 1)
SELECT n.id FROM now n LEFT JOIN known k ON n.id = k.id
WHERE k.id IS NULL OR k.path IS DISTINCT FROM n.absolute OR k.size IS DISTINCT FROM n.size
   OR k.modified IS NULL OR n.modified IS NULL OR k.modified <> n.modified""")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.pending_files(_read(spark, sf, "walked_files"), _read(spark, sf, "cache_entries"), _read(spark, sf, "pack_runs")).select("id")


@query(f"""WITH {_M}, c AS (SELECT DISTINCT id, path, size, modified FROM cache_entries WHERE modified IS NOT NULL)
SELECT m.id, count(c.id) > 0 AS reused FROM m LEFT JOIN c ON c.id = m.id AND c.path = m.absolute AND c.size = m.size AND c.modified = m.modified GROUP BY m.id""")
def cache_reuse_join(spark: SparkSession, sf: str) -> DataFrame:
    cache = _read(spark, sf, "cache_entries").withColumnRenamed("path", "absolute")
    return joins.reuse_cached(_manifest(spark, sf), cache).select("id", "reused")


@query(f"WITH {_M} SELECT id, coalesce(modified + INTERVAL 2 SECOND <= TIMESTAMP '2025-03-01 00:00:00', false) AS settled FROM m")
def cache_settle(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("id", joins.is_settled("modified", F.expr("TIMESTAMP '2025-03-01 00:00:00'")).alias("settled"))


@query(f"""WITH {_P}, e AS (SELECT DISTINCT id FROM packed_files), i AS (SELECT DISTINCT id FROM manifest_entries)
SELECT e.id, max(i.id) AS owner FROM e LEFT JOIN i ON i.id = e.id OR (contains(e.id, '!') AND i.id = split_part(e.id, '!', 1)) GROUP BY e.id""")
def attribute_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return joins.owners(_read(spark, sf, "packed_files").select("id"), _read(spark, sf, "manifest_entries").select("id"))


# ---- paths ------------------------------------------------------------------------------------


@query(f"WITH {_M} SELECT id, CAST(row_number() OVER (ORDER BY string_split(relative, '/'), id) AS BIGINT) AS ordinal FROM m")
def path_order_rank(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(_manifest(spark, sf).select("id", "relative"), [paths.path_order("relative"), F.col("id")]).select("id", "ordinal")


@query(f"WITH {_M} SELECT id, CAST(row_number() OVER (ORDER BY relative, id) AS BIGINT) AS ordinal FROM m")
def dump_order_rank(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(_manifest(spark, sf).select("id", "relative"), [F.col("relative"), F.col("id")]).select("id", "ordinal")


_BUDGET = """WITH {m}, c AS (
  SELECT id, CAST(sum(CASE WHEN coalesce(size, 0) > 1000000 THEN 0 ELSE coalesce(size, 0) END) OVER w AS BIGINT) AS cum_bytes, CAST(row_number() OVER w AS BIGINT) AS ordinal
  FROM m WINDOW w AS (ORDER BY string_split(relative, '/'), id ROWS UNBOUNDED PRECEDING))
SELECT id, cum_bytes, ordinal, {kept} AS kept FROM c"""


@query(_BUDGET.format(m=_M, kept="cum_bytes <= 5000000"))
def byte_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return budget.apply_budgets(_manifest(spark, sf).select("id", "relative", "size"), 5_000_000, 0, 1_000_000).select("id", "cum_bytes", "ordinal", "kept")


@query(_BUDGET.format(m=_M, kept="cum_bytes <= 1073741824 AND ordinal <= 700"))
def entry_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return budget.apply_budgets(_manifest(spark, sf).select("id", "relative", "size"), 1 << 30, 700, 1_000_000).select("id", "cum_bytes", "ordinal", "kept")


@query(f"WITH {_M} SELECT id, {_HIDDEN} AS hidden FROM m")
def hidden_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("id", paths.is_hidden("relative").alias("hidden"))


@query(f"""WITH {_M} SELECT id FROM m
WHERE (suffix(relative, '.py') OR suffix(relative, '.rs') OR regexp_matches(relative, '(^|/)docs/')) AND NOT regexp_matches(relative, '(^|/)tests/')""")
def glob_include_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).where(paths.keep_path("relative", ["*.py", "*.rs", "docs/**"], ["tests/**"], hidden=True, defaults=False)).select("id")


@query(f"""WITH {_M} SELECT id FROM m WHERE NOT {_HIDDEN.replace('relative', 'root_relative')}
AND NOT regexp_matches(root_relative, '(^|/)({'|'.join(d.replace('.', chr(92) + '.') for d in tables.GENERATED_DIRS)})/.')
AND NOT regexp_matches({_BASE.replace('relative', 'root_relative')}, '(\\.min\\.js|\\.min\\.css|\\.tsbuildinfo|\\.pem|\\.key|\\.pyc|\\.pyo|\\.class|\\.o|\\.a|\\.so|\\.dylib|\\.dll|\\.exe|\\.wasm|\\.bin)$')
AND NOT regexp_matches(root_relative, '\\.(egg|dist)-info/')
AND {_BASE.replace('relative', 'root_relative')} NOT IN ('next-env.d.ts', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'bun.lock', 'bun.lockb', '.env', 'id_rsa', '.DS_Store', 'Thumbs.db')
AND NOT starts_with({_BASE.replace('relative', 'root_relative')}, '.env.') AND NOT starts_with({_BASE.replace('relative', 'root_relative')}, 'id_rsa.')""")
def default_excludes(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).where(paths.keep_path("relative", under_root="root_relative")).select("id")


@query(f"WITH {_M} SELECT id FROM m WHERE regexp_matches(lower(relative), '^(.*/)?src/[^/]*_[^/]*\\.r.$')")
def ui_path_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).where(paths.matches_screen("relative", "**/SRC/*_*.r?")).select("id")


@query(f"WITH {_M} SELECT id FROM m WHERE contains(lower(relative), 'rust') OR coalesce(contains(lower(language), 'rust'), false)")
def ui_text_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).where(paths.contains_text("relative", "language", " Rust ")).select("id")


_NAMES = "(SELECT id AS n FROM m WHERE kind = 'json' UNION SELECT relative FROM m WHERE language = 'sql')"


@query(f"WITH {_M} SELECT id FROM m WHERE id IN {_NAMES} UNION SELECT id FROM m WHERE relative IN {_NAMES} AND relative NOT IN (SELECT id FROM m)")
def selection_fallback(spark: SparkSession, sf: str) -> DataFrame:
    m = _manifest(spark, sf).select("id", "relative", "kind", "language")
    names = m.where("kind = 'json'").select(F.col("id").alias("name")).union(m.where("language = 'sql'").select("relative"))
    return paths.select_files(m.select("id", "relative"), names).select("id")


@query("""WITH s AS (SELECT * FROM walked_files WHERE scan_no = 1), w AS (SELECT DISTINCT id, absolute, dev, ino FROM walked_files WHERE scan_no = 5)
SELECT count(*) AS n FROM w WHERE absolute NOT IN (SELECT absolute FROM s) AND (dev, ino) NOT IN (SELECT (dev, ino) FROM s WHERE dev IS NOT NULL AND ino IS NOT NULL)""")
def skip_set_anti(spark: SparkSession, sf: str) -> DataFrame:
    w = _read(spark, sf, "walked_files").select("id", "absolute", "dev", "ino", "scan_no")
    now = w.where("scan_no = 5").drop("scan_no").distinct()
    return paths.skip_files(now, w.where("scan_no = 1")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT root_id, CASE WHEN min(split_part(relative, '/', 1)) = max(split_part(relative, '/', 1)) AND min(length(relative) - length(replace(relative, '/', ''))) > 0 THEN min(split_part(relative, '/', 1)) END AS root FROM manifest_entries GROUP BY root_id")
def grant_roots(spark: SparkSession, sf: str) -> DataFrame:
    return joins.shared_root(_read(spark, sf, "manifest_entries"), by=["root_id"])


@query("SELECT id, relative, CASE WHEN n = 1 THEN id ELSE id || '#' || n END AS unique_id FROM (SELECT id, relative, row_number() OVER (PARTITION BY id ORDER BY seen_at, scan_no) AS n, seen_at, scan_no FROM (SELECT DISTINCT id, relative, seen_at, scan_no FROM walked_files))")
def unique_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "walked_files").select("id", "relative", "seen_at", "scan_no").distinct().withColumn("o", F.struct("seen_at", "scan_no"))
    return budget.unique_ids(rows, "o").select("id", "relative", "unique_id")


# ---- kinds and labels --------------------------------------------------------------------------

_KIND = f"""CASE WHEN lower({_BASE}) IN {_in(tables.TEXT_NAMES)} THEN 'text' WHEN regexp_matches(lower(relative), '\\.(tar\\.gz|tgz)$') THEN 'targz'
 WHEN suffix(lower(relative), '.tar') THEN 'tar' WHEN regexp_matches({_EXT}, '^[0-9]{{1,4}}$') THEN 'text' ELSE k.kind2 END"""
_KIND_JOIN = f"LEFT JOIN {_values(tables.kind_of_extension(), 'e', 'kind2')} ON e = {_EXT}".replace("AS t(", "AS k(")


@query(f"WITH {_M} SELECT m.id, {_KIND} AS kind_by_name FROM m {_KIND_JOIN}")
def kind_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("id", classify.kind_from_name("relative").alias("kind_by_name"))


@query(f"WITH {_M} SELECT {_KIND} AS kind_by_name, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM m {_KIND_JOIN} GROUP BY 1")
def kind_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).groupBy(classify.kind_from_name("relative").alias("kind_by_name")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"""WITH {_M} SELECT m.id, coalesce(a.l, CASE WHEN regexp_matches({_EXT}, '^[0-9]{{1,4}}$') THEN 'text' END, b.l, CASE WHEN regexp_matches({_EXT}, '^[a-z0-9_+-]{{1,32}}$') THEN {_EXT} END,
 CASE WHEN coalesce(kind, 'unknown') = 'unknown' THEN 'text' ELSE kind END) AS label
FROM m LEFT JOIN {_values(tables.spread(tables.LANGUAGE_OF_NAME), 'n', 'l').replace('AS t', 'AS a')} ON a.n = lower({_BASE})
LEFT JOIN {_values(tables.language_of_extension(), 'e', 'l').replace('AS t', 'AS b')} ON b.e = {_EXT}""")
def language_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("id", classify.language("relative", "kind").alias("label"))


@query(f"WITH {_M} SELECT m.id, CASE WHEN kind IN ('html', 'xml') THEN '' ELSE coalesce(f.l, '') END AS fence FROM m LEFT JOIN {_values(tables.spread(tables.FENCE_OF_EXTENSION), 'e', 'l').replace('AS t', 'AS f')} ON f.e = {_EXT}")
def fence_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("id", classify.fence_language("relative", "kind").alias("fence"))


_LOWDIRS = f"list_has_any(list_transform(string_split(relative, '/')[:-2], lambda c: lower(c)), [{', '.join(repr(d.lower()) for d in tables.GENERATED_DIRS)}])"
_TICK = f"""NOT (coalesce(kind, '') = 'binary' OR {_LOWDIRS} OR lower({_BASE}) IN {_in((*tables.GENERATED_NAMES, *tables.LOCK_NAMES, *tables.VENV_NAMES))}
 OR regexp_matches(lower({_BASE}), '({'|'.join(e.replace('.', chr(92) + '.') for e in (*tables.GENERATED_ENDS, *tables.LOCK_ENDS))})$')
 OR coalesce({_EXT}, '') IN {_in((*tables.IMAGE_EXTENSIONS, *tables.PGP_EXTENSIONS, *tables.CYTHON_EXTENSIONS))})"""


@query(f"WITH {_M} SELECT id, {_TICK} AS selected, {_TICK} AND coalesce(size, 0) <= 8388608 AND coalesce(kind, '') NOT IN ('zip', 'tar', 'targz') AS ticked FROM m")
def default_selected(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("id", classify.default_selected("relative", "kind").alias("selected"), classify.default_on("relative", "kind", "size", 8 << 20).alias("ticked"))


# byte by byte in hexadecimal, so the cut at byte 8192 is exact for every text
@query(f"""WITH {_P}, b AS (SELECT id, regexp_replace(left(hex(encode(text)), 16384), '(..)', '\\1 ', 'g') AS h FROM p)
SELECT id, coalesce((length(h) - length(regexp_replace(h, '(0[0-8EF]|1[0-9AC-F]) ', '', 'g'))) * 32 > length(h), false) AS binary_like FROM b""")
def looks_binary_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every packed record: texts of any length, empty and null ones too."""
    return _packed(spark, sf).select("id", classify.looks_binary(F.encode("text", "UTF-8")).alias("binary_like"))


# ---- text ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST({_WIDE} + ceil({_OTHER} / 4.0) AS BIGINT) AS tokens, CAST(length(text) AS BIGINT) AS chars FROM documents")
def token_estimate_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", text.token_estimate("text").alias("tokens"), F.length("text").cast("bigint").alias("chars"))


@query(f"SELECT language, CAST(sum({_WIDE}) + ceil(sum({_OTHER}) / 4.0) AS BIGINT) AS tokens FROM documents GROUP BY language")
def token_total_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").groupBy("language").agg(text.token_estimate_sum("text").alias("tokens"))


@query(f"SELECT doc_id, md5({_xml('text')}) AS escaped_md5 FROM documents")
def xml_escape_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", F.md5(text.xml_escape("text")).alias("escaped_md5"))


@query(f"SELECT doc_id, CAST({_FENCE} AS BIGINT) AS fence FROM documents")
def md_fence_width(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", text.fence_width("text").alias("fence"))


@query("SELECT p_partkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0) ELSE printf('%.1f GiB', b / 1073741824.0) END AS human FROM (SELECT p_partkey, p_partkey * p_partkey * p_partkey AS b FROM part)")
def human_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part").select("p_partkey", text.human_bytes(F.col("p_partkey") * F.col("p_partkey") * F.col("p_partkey")).alias("human"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size::BIGINT * 1024 WHEN 2 THEN p_size::BIGINT * 1048576 WHEN 3 THEN p_size::BIGINT * 1073741824 WHEN 4 THEN p_size::BIGINT * 1000 ELSE -1 END::BIGINT AS bytes FROM part""")
def parse_size(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 6
    size = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("k"))).when(k == 2, F.concat(n, F.lit(" MiB"))).when(k == 3, F.concat(n, F.lit("gb"))).when(k == 4, F.concat(n, F.lit("_000"))).otherwise(F.concat(n, F.lit("x")))
    return _read(spark, sf, "part").select("p_partkey", F.coalesce(text.parse_size(size), F.lit(-1)).cast("bigint").alias("bytes"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, md5(text) AS text_md5 FROM documents")
def document_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", text.utf8_bytes("text").alias("bytes"), F.md5("text").alias("text_md5"))


@query("""SELECT id, CASE status WHEN 'extracted' THEN '' WHEN 'skipped_binary' THEN 'Skipped a binary file (' || size || ' bytes): the dump holds no text for it.'
 WHEN 'too_large' THEN 'File is ' || size || ' bytes, over the ' || status_limit || '-byte cap. Raise the cap or leave this file unchecked.'
 WHEN 'skipped_archive' THEN 'Archive (' || size || ' bytes) was not expanded. Turn on archives to unpack zip and tar members into the dump.'
 WHEN 'changed' THEN 'File changed on disk after the scan. Rescan, then pack again so the dump matches the current bytes.'
 WHEN 'error' THEN 'Extraction failed for a ' || size || '-byte file. ' || coalesce(status_detail, '')
 WHEN 'unreadable' THEN 'Could not parse this ' || size || '-byte file, so the dump holds a one-line note in its place. It may be damaged, encrypted, or too large to unpack. ' || coalesce(status_detail, '') END AS message
FROM packed_files GROUP BY ALL""")
def status_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "packed_files").select("id", text.status_message("status", "size", "status_limit", "status_detail").alias("message")).distinct()


# ---- sections, totals, trees -----------------------------------------------------------------------

_SHOWN = f"{_P}, d AS (SELECT *, CAST(row_number() OVER (ORDER BY relative, id) AS BIGINT) AS ordinal FROM p WHERE status IS NULL OR status <> 'skipped_binary')"
_NL = "CASE WHEN suffix(text, chr(10)) THEN '' ELSE chr(10) END"


@query(f"WITH {_SHOWN} SELECT ordinal, id, md5(repeat('=', 48) || chr(10) || 'FILE: ' || relative || chr(10) || repeat('=', 48) || chr(10) || text || {_NL} || chr(10)) AS section_md5 FROM d")
def plain_sections(spark: SparkSession, sf: str) -> DataFrame:
    return render.sections(_packed(spark, sf), "plain").select("ordinal", "id", F.md5("section").alias("section_md5"))


@query(f"""WITH {_SHOWN}, e AS (SELECT d.*, repeat('`', {_FENCE}) AS fence, CASE WHEN kind IN ('html', 'xml') THEN '' ELSE coalesce(f.l, '') END AS lang FROM d LEFT JOIN {_values(tables.spread(tables.FENCE_OF_EXTENSION), 'e', 'l').replace('AS t', 'AS f')} ON f.e = {_EXT})
SELECT ordinal, id, md5('## ' || relative || chr(10) || chr(10) || fence || lang || chr(10) || text || {_NL} || fence || chr(10) || chr(10)) AS section_md5 FROM e""")
def md_sections(spark: SparkSession, sf: str) -> DataFrame:
    return render.sections(_packed(spark, sf), "markdown").select("ordinal", "id", F.md5("section").alias("section_md5"))


@query(f"""WITH {_SHOWN} SELECT ordinal, id, md5('<document index="' || ordinal || '">' || chr(10) || '<source>' || {_xml('relative')} || '</source>' || chr(10) || '<document_content>' || chr(10) || {_xml('text')} || chr(10) || '</document_content>' || chr(10) || '</document>' || chr(10)) AS section_md5 FROM d""")
def xml_sections(spark: SparkSession, sf: str) -> DataFrame:
    return render.sections(_packed(spark, sf), "xml").select("ordinal", "id", F.md5("section").alias("section_md5"))


@query(f"WITH {_SHOWN} SELECT CAST(sum(strlen(relative) + strlen(text) + length({_NL}) + 106) AS BIGINT) AS dump_bytes, count(*) AS n_sections FROM d")
def dump_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return render.dumped(_packed(spark, sf)).select(F.octet_length(render.plain_section()).cast("bigint").alias("b")).agg(F.sum("b").alias("dump_bytes"), F.count(F.lit(1)).alias("n_sections"))


_STATS = f"""SELECT @BY@ count(*) FILTER (status = 'extracted') AS files_extracted, count(*) FILTER (coalesce(status, '') <> 'extracted') AS files_skipped,
 count(*) FILTER (status = 'unreadable') AS files_unreadable, CAST(coalesce(sum(size) FILTER (status = 'extracted'), 0) AS BIGINT) AS bytes_read,
 CAST(coalesce(sum(length(text)) FILTER (status = 'extracted'), 0) AS BIGINT) AS chars_emitted,
 CAST(coalesce(sum({_WIDE}) FILTER (status = 'extracted') + ceil(sum({_OTHER}) FILTER (status = 'extracted') / 4.0), 0) AS BIGINT) AS tokens_est FROM p @GROUP@"""


@query(f"WITH {_P} " + _STATS.replace("@BY@", "batch_id,").replace("@GROUP@", "GROUP BY batch_id"))
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.pack_stats(_packed(spark, sf), "batch_id")


@query(f"""WITH {_P}, s AS ({_STATS.replace('@BY@', '').replace('@GROUP@', '')})
SELECT *, 'packed ' || files_extracted || ' files (' || CASE WHEN bytes_read < 1024 THEN bytes_read || ' B' WHEN bytes_read < 1048576 THEN printf('%.1f KiB', bytes_read / 1024.0) WHEN bytes_read < 1073741824 THEN printf('%.1f MiB', bytes_read / 1048576.0) ELSE printf('%.1f GiB', bytes_read / 1073741824.0) END
 || ' read, ' || chars_emitted || ' chars, ~' || tokens_est || ' tokens)' || CASE WHEN files_unreadable > 0 THEN ', ' || files_unreadable || ' unreadable' ELSE '' END
 || CASE WHEN files_skipped > files_unreadable THEN ', ' || (files_skipped - files_unreadable) || ' skipped' ELSE '' END AS summary FROM s""")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.with_summary(stats.pack_stats(_packed(spark, sf)))


_UP = "unnest(range(1, len(string_split(relative, '/'))))"


@query(f"""WITH {_M}, x AS (SELECT coalesce(oversized, false) AS o, coalesce(default_on, false) AS t, coalesce(size, 0) AS size, string_split(relative, '/') AS q, {_UP} AS i FROM m)
SELECT array_to_string(q[1:i], '/') AS folder, count(*) AS n_files, count(*) FILTER (NOT o) AS n_tickable, count(*) FILTER (t AND NOT o) AS n_ticked,
 CAST(coalesce(sum(size) FILTER (t AND NOT o), 0) AS BIGINT) AS ticked_bytes FROM x GROUP BY 1""")
def folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return tree.folder_rollup(_manifest(spark, sf))


@query(f"WITH {_M} SELECT coalesce(language, 'text') AS language, count(*) FILTER (NOT coalesce(oversized, false)) AS n_tickable, count(*) FILTER (coalesce(default_on, false) AND NOT coalesce(oversized, false)) AS n_ticked FROM m GROUP BY 1")
def language_chips(spark: SparkSession, sf: str) -> DataFrame:
    return tree.language_chips(_manifest(spark, sf))


@query(f"""WITH {_M}, x AS (SELECT string_split(relative, '/') AS q, unnest(range(1, len(string_split(relative, '/')) + 1)) AS i FROM m),
n AS (SELECT q[1:i] AS key, max(i < len(q)) AS is_dir FROM x GROUP BY 1), l AS (SELECT *, key[-1] = max(key[-1]) OVER (PARTITION BY key[1:len(key) - 1]) AS is_last FROM n),
b AS (SELECT c.key, string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY c.k) AS bars FROM (SELECT key, unnest(range(1, len(key))) AS k FROM l) c JOIN l a ON a.key = c.key[1:c.k] GROUP BY c.key)
SELECT array_to_string(l.key, '/') AS path, CAST(len(l.key) AS BIGINT) AS depth, coalesce(bars, '') || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || l.key[-1] || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM l LEFT JOIN b ON b.key = l.key""")
def tree_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tree.tree_lines(_manifest(spark, sf)).select(F.array_join("key", "/").alias("path"), "depth", "line")


QUERIES |= queries_extract.QUERIES | queries_more.QUERIES
SQL |= queries_extract.SQL | queries_more.SQL


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Packed files within a budget, in dump order, as XML sections."""
    fit = budget.apply_budgets(_packed(spark, sf).select("id", "relative", "size", "text", "kind", "status")).where("kept")
    return render.sections(fit, "xml")
