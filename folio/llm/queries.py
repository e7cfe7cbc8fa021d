"""The queries of the text operators over the tables of a folder, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import chunking, leakage, mixing, mojibake, pii, provenance, secrets, tokens


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.found_ids(_read(spark, sf, "packed_files"))


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.repair(_read(spark, sf, "packed_files"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_scores(spark, sf).where("NOT hand_written").select("id")


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.classify(_read(spark, sf, "packed_files"), _read(spark, sf, "manifest_entries"))


def p2_validation(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.validation(_read(spark, sf, "packed_files"), _read(spark, sf, "manifest_entries"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.found_lines(_read(spark, sf, "packed_files"))


def p3_masked(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(_read(spark, sf, "packed_files")).select("id", F.size("findings").cast("bigint").alias("n_findings"), "masked")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.found_ids(_read(spark, sf, "packed_files"))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.pieces(_read(spark, sf, "packed_files"), only_oversized=True)


def p5_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Every packed text cut and, overlaps left out, put together again (each part of a text once)."""
    cut = chunking.pieces(_read(spark, sf, "packed_files"))
    body = F.substring(F.decode(F.encode("piece", "UTF-8"), "ISO-8859-1"), F.col("overlap_bytes").cast("int") + 1, F.lit(chunking.LIMIT))
    parts = F.array_sort(F.collect_set(F.struct("piece_no", F.decode(F.encode(body, "ISO-8859-1"), "UTF-8").alias("body"))))
    joined = F.array_join(F.transform(parts, lambda x: x["body"]), "")
    return cut.groupBy("id").agg(F.md5(joined).alias("joined_md5"), (F.max("n_bytes") <= chunking.LIMIT).alias("within"), (F.max("n_pieces") > 1).alias("was_cut"))


def p6_record_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.record_tokens(_read(spark, sf, "packed_files"))


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.totals(p6_record_tokens(spark, sf), _read(spark, sf, "manifest_entries"), _read(spark, sf, "scan_roots"))


def p6_cross(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.cross_totals(p6_record_tokens(spark, sf), _read(spark, sf, "manifest_entries"), _read(spark, sf, "scan_roots"))


def p6_batches(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.batch_totals(p6_record_tokens(spark, sf), _read(spark, sf, "pack_stats"))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.copies(mixing.counted(_read(spark, sf, "documents")), _read(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    records, targets = mixing.counted(_read(spark, sf, "documents")), _read(spark, sf, "mix_targets")
    return mixing.shares(mixing.copies(records, targets), records, targets)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.found_lines(_read(spark, sf, "documents"), _read(spark, sf, "name_lexicon"))


def p9_masked(spark: SparkSession, sf: str) -> DataFrame:
    return pii.scan(_read(spark, sf, "documents"), _read(spark, sf, "name_lexicon")).select("doc_id", F.size("items").cast("bigint").alias("n_items"), "masked")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_scores, p2_validation, p3_found, p3_masked, p5_found, p5_pieces, p5_joined, p6_record_tokens, p6_totals, p6_cross, p6_batches, p7_found, p7_leaks, p8_mix, p8_shares, p9_found, p9_masked)}


_CF = "[\\x{AD}\\x{600}-\\x{605}\\x{61C}\\x{6DD}\\x{70F}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{FEFF}\\x{FFF9}-\\x{FFFB}]"
_BLOCK_TAGS = "address|article|aside|blockquote|br|caption|dd|details|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|img|input|label|legend|li|main|nav|ol|option|p|pre|section|select|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul"
#: Three readings of a text as in ``leakage.readings`` (references: the numeric ones and the four
#: of markup), every run of ten words of each, and the documents and items that share one.
_P7 = f"""WITH t AS (SELECT 'd' AS side, doc_id AS k, regexp_replace(lower(text), '{_CF}', '', 'g') AS low FROM documents UNION ALL SELECT 'i', item_id, regexp_replace(lower(text), '{_CF}', '', 'g') FROM eval_items),
h AS (SELECT *, regexp_replace(low, '-\\s*\\n\\s*(?:[>#*|/]+\\s*)*', '', 'g') AS j FROM t),
u AS (SELECT *, replace(replace(replace(replace(list_reduce(list_prepend(j, list_distinct(regexp_extract_all(j, '&#[0-9]+;'))), lambda a, e: replace(a, e, chr(CAST(regexp_extract(e, '[0-9]+') AS INTEGER)))), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&') AS bare FROM h),
r AS (SELECT side, k, low AS s, false AS trim_ FROM u UNION ALL SELECT side, k, regexp_replace(regexp_replace(bare, '</?[a-z][^<>]*>|<!--|-->', '', 'g'), '{_CF}', '', 'g'), true FROM u
 UNION ALL SELECT side, k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '</?(?:{_BLOCK_TAGS})\\b[^<>]*>', ' ', 'g'), '</?[a-z][^<>]*>|<!--|-->', '', 'g'), '([\\p{{L}}\\p{{N}}_])(\\*{{1,3}}|~~|`)([\\p{{L}}\\p{{N}}_])', '\\1\\3', 'g'), '{_CF}', '', 'g'), true FROM u),
w AS (SELECT side, k, CASE WHEN trim_ THEN list_filter(list_transform(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'), lambda x: trim(x, '_')), lambda x: x <> '') ELSE regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+') END AS ws FROM r),
g AS (SELECT DISTINCT side, k, array_to_string(ws[n:n + 9], ' ') AS gram FROM (SELECT side, k, ws, unnest(range(1, len(ws) - 8)) AS n FROM w))
SELECT DISTINCT d.k AS doc_id, i.k AS item_id FROM g d JOIN g i ON d.gram = i.gram WHERE d.side = 'd' AND i.side = 'i'"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": "SELECT DISTINCT id FROM packed_files WHERE strlen(text) > 102400",
        "p5_joined": "SELECT id, md5(text) AS joined_md5, true AS within, strlen(text) > 102400 AS was_cut FROM packed_files WHERE strlen(text) > 0 GROUP BY id, text",
        "p7_found": _P7,
    }
