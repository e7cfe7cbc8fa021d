"""Cut a dump into download parts that join back exactly."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, SLACK = 102_400, 4_096


def parts(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, slack: int = SLACK) -> DataFrame:
    """id, part_no, part: at most ``limit`` bytes each, ending on a line break if one falls within
    the last ``slack`` bytes, never inside a character.  One regular expression over the bytes."""
    near = max(1, limit - slack)
    # the cap, and the same cap less the tail of a character that does not fit
    rx = rf"[\x00-\xFF]{{1,{limit}}}\z|[\x00-\xFF]{{{near - 1},{limit - 1}}}\n|[\x00-\xFF]{{1,{limit}}}(?![\x80-\xBF])"
    raw = F.decode(F.encode(F.col(text_col), "UTF-8"), "ISO-8859-1")
    cut = F.when(F.length(raw) <= limit, F.array(raw)).otherwise(F.regexp_extract_all(raw, F.lit(rx), F.lit(0)))
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(cut).alias("k", "raw"))
    return rows.select("id", (F.col("k") + 1).cast("bigint").alias("part_no"), F.decode(F.encode("raw", "ISO-8859-1"), "UTF-8").alias("part"))


def part_name(filename: str, index: int, count: int) -> str:
    """'dump.md' becomes 'dump-001.md'; numbers as wide as the count, three digits at least."""
    stem, dot, ext = filename.rpartition(".")
    if not dot:
        stem, ext = filename, ""
    return f"{stem}-{index:0{max(3, len(str(count)))}d}{dot}{ext}"


def safe_name(name: str) -> str:
    """A name for a download: no separators, control or reserved characters."""
    clean = re.sub(r'[\x00-\x1f\x7f<>:"/\\|?*]+', "-", name).strip(" .")
    return clean or "dump"


def cut_stream(chunks: Iterator[str], limit: int = LIMIT, slack: int = SLACK) -> Iterator[str]:
    """The parts of a dump that comes in chunks, by the rule of ``parts``; one part is held at a time."""
    raw = b""
    for chunk in chunks:
        raw += chunk.encode()
        at = 0
        while len(raw) - at > limit:
            end = at + limit
            line = raw.rfind(b"\n", max(at, end - slack), end)
            if line >= 0:
                end = line + 1
            else:
                while raw[end] & 0xC0 == 0x80:
                    end -= 1
            yield raw[at:end].decode()
            at = end
        raw = raw[at:]
    if raw:
        yield raw.decode()


def zip_parts(target: str, filename: str, chunks: Iterator[str], limit: int = LIMIT, slack: int = SLACK) -> int:
    """Writes a dump as a stored zip of numbered parts, beside the target and then in its place.

    The numbers need as many digits as there are parts, so the parts wait in a file; returns how many.
    """
    with tempfile.TemporaryFile() as spool:
        sizes = []
        for part in cut_stream(chunks, limit, slack):
            raw = part.encode()
            spool.write(raw)
            sizes.append(len(raw))
        spool.seek(0)
        name = safe_name(filename)
        temp = f"{target}.part"
        with zipfile.ZipFile(temp, "w", zipfile.ZIP_STORED) as z:
            for k, n in enumerate(sizes, 1):
                raw = spool.read(n)
                entry = zipfile.ZipInfo(part_name(name, k, len(sizes)), (1980, 1, 1, 0, 0, 0))
                z.writestr(entry, raw)
                if z.getinfo(entry.filename).CRC != crc32(raw):
                    raise OSError(f"{entry.filename} was not written as it is")
    os.replace(temp, target)
    return len(sizes)


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
