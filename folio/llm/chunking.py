"""Cut oversized texts at natural boundaries, inside the JVM.

The UTF-8 bytes of a text are viewed as a Latin-1 string, one character a byte.  One regular
expression then extracts the bodies: its alternatives are ordered by the strength of the
boundary, each consumes up to the limit by a bounded quantifier, the last falls back to single
characters and never ends inside one.  Array functions turn the bodies into offsets and join
each body to the end of those before it, the overlap; no text leaves the JVM, and no piece is
cut out of the whole text again, so the work grows with the text's length.

Defined results: null or empty text gives no piece; a text of at most ``limit`` bytes is one
piece; pieces of repeated rows repeat with them; a text of any length is cut whole, and every
piece but the last ends at the strongest boundary in the second half of its window, at any
line or blank before that, or between two characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 102_400, 512
_CONT = r"[\x80-\xBF]"
# not before a combining mark, a variation selector or a joined emoji
_WHOLE = r"(?!\xCC[\x80-\xBF]|\xCD[\x80-\xAF]|\xEF\xB8[\x80-\x8F]|\xE2\x80\x8D)"


def body_pattern(limit: int, overlap: int) -> str:
    top = limit - overlap
    low = max(1, top // 2)

    def upto(end: str, width: int, least: int = low) -> str:
        return rf"[\x00-\xFF]{{{max(1, least - width)},{max(1, top - width)}}}{end}"

    return "|".join(
        (
            rf"[\x00-\xFF]{{1,{top}}}\z",
            upto(r"\n[ \t]*\r?\n", 4),  # blank line
            upto(r"\n", 1),
            upto(r"(?:[.!?]|\xE3\x80\x82|\xEF\xBC[\x81\x9F])(?=[\s\xC2\xE3-\xED]|\z)", 3),  # sentence
            upto(r"[ \t]", 1),
            upto(r"\n", 1, 1),
            upto(r"[ \t]", 1, 1),
            rf"[\x00-\xFF]{{1,{top}}}(?!{_CONT}){_WHOLE}(?<!\xE2\x80\x8D)",
            rf"[\x00-\xFF]{{1,{top}}}(?!{_CONT})",
        )
    )


def pieces(df: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = False) -> DataFrame:
    """One row a piece: id, piece_no (from 1), n_pieces, byte_start, n_bytes, overlap_bytes, piece."""
    if not 0 <= overlap < limit - 8:
        raise ValueError("the overlap must leave room in a piece")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") > (limit if only_oversized else 0))
    raw = rows.withColumn("raw", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).drop("text")
    bodies = F.when(F.length("raw") <= limit, F.array("raw")).otherwise(F.regexp_extract_all("raw", F.lit(body_pattern(limit, overlap)), F.lit(0)))
    cut = raw.select("id", bodies.alias("bodies"))
    parts = cut.select("id", "bodies", F.transform("bodies", F.length).alias("lens"), F.transform("bodies", lambda b: F.right(b, F.lit(overlap))).alias("tails"))
    starts = F.aggregate("lens", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    # of three neighbouring bodies one fills at least half of its room, so this many reach over the overlap
    reach = 3 * -(-2 * overlap // (limit - overlap)) + 3

    def before(i: Column) -> Column:
        """The last ``overlap`` bytes before body ``i`` (from 0), or the next fewer that start a character."""
        joined = F.array_join(F.slice("tails", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), "")
        return F.regexp_replace(F.right(joined, F.lit(overlap)), f"^{_CONT}+", "")

    placed = parts.select("id", "bodies", F.size("lens").cast("bigint").alias("n_pieces"), F.slice(starts, F.lit(1), F.size("lens")).alias("starts"), F.transform("tails", lambda _, i: before(i)).alias("overlaps"))
    out = placed.select("id", "n_pieces", F.posexplode(F.arrays_zip("bodies", "starts", "overlaps")).alias("k", "b"))
    ov = F.length("b.overlaps")
    return out.select(
        "id",
        (F.col("k") + 1).cast("bigint").alias("piece_no"),
        "n_pieces",
        (F.col("b.starts") - ov).cast("bigint").alias("byte_start"),
        (ov + F.length("b.bodies")).cast("bigint").alias("n_bytes"),
        ov.cast("bigint").alias("overlap_bytes"),
        F.decode(F.encode(F.concat("b.overlaps", "b.bodies"), "ISO-8859-1"), "UTF-8").alias("piece"),
    )


def found_ids(df: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Each id once whose text had to be cut."""
    return pieces(df, id_col, text_col, limit, overlap, only_oversized=True).where("piece_no = 1 AND n_pieces > 1").select("id").distinct()
