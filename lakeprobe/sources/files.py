"""Binary files: format by their first bytes, size and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of each format, in hex.
MAGIC = (("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("pdf", "25504446"), ("zip", "504B0304"), ("gzip", "1F8B"))


def format_of(content: Column) -> Column:
    start = F.hex(F.substring(content, 1, 12))
    out = F.when(start.startswith("52494646") & F.substring(start, 17, 8).eqNullSafe("57454250"), "webp")
    for name, magic in MAGIC:
        out = out.when(start.startswith(magic), name)
    return out.otherwise("unknown")


#: Media types of the formats.
MIME = {
    "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "pdf": "application/pdf", "gzip": "application/gzip", "zip": "application/zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def office_of(content: Column) -> Column:
    """docx, xlsx, pptx or zip, by the names of the parts that an archive lists in its directory."""
    names = F.decode(content, "ISO-8859-1")
    return F.when(names.contains("word/document.xml"), "docx").when(names.contains("xl/workbook.xml"), "xlsx").when(names.contains("ppt/presentation.xml"), "pptx").otherwise("zip")


def number_at(content: Column, at: int, bytes_: int, little: bool = False) -> Column:
    """The unsigned number of some bytes at a place (from 0)."""
    digits = F.hex(F.substring(content, at + 1, bytes_))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(bytes_ - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("int")


def dimensions(content: Column, kind: Column) -> Column:
    """struct<width, height> of PNG images, and of JPEG ones by their first frame header; null for others."""
    png = F.struct(number_at(content, 16, 4).alias("width"), number_at(content, 20, 4).alias("height"))
    frame = F.regexp_extract(F.hex(content), "^FFD8(?:FF(?:E[0-9A-F]|DB|C4|FE|DD)(?:[0-9A-F]{2})*?)*?FFC[0-2]([0-9A-F]{4})([0-9A-F]{2})([0-9A-F]{8})", 3)
    part = lambda i: F.conv(F.substring(frame, i, 4), 16, 10).cast("int")
    jpeg = F.when(frame != "", F.struct(part(5).alias("width"), part(1).alias("height")))
    return F.when(kind == "png", png).when(kind == "jpeg", jpeg)


def inspected(files: DataFrame) -> DataFrame:
    """files (path, content) with format, media type, size, SHA-256 and dimensions."""
    c = F.col("content")
    kind = F.when(format_of(c) == "zip", office_of(c)).otherwise(format_of(c))
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    rows = files.select("path", "content", kind.alias("format"))
    return rows.select("path", "format", F.coalesce(F.element_at(known, F.col("format")), F.lit("application/octet-stream")).alias("mime"), F.length(c).cast("long").alias("size"), F.sha2(c, 256).alias("sha256"), dimensions(c, F.col("format")).alias("dimensions"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return inspected(spark.read.format("binaryFile").load(path).select("path", "content"))
