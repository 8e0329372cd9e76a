"""Exports whose parts, put one after the other, are one file: CSV with one header and mark, one JSON array, JSON lines.

The lines of a file are rows that Spark sorts by range: the head first, then the records in
their order, then the foot. Every partition is written as a part, and the parts' names are
in the order of their contents, so `cat part-*` is the file, byte by byte the same however
many partitions made it. Nothing is gathered, and no writer needs to know of another.

Defined results:
* null cells are empty in CSV and null in JSON; cells with the separator, quotes or line
  breaks are quoted, quotes doubled; a lone empty cell is written as two quotes;
* equal records are all written; records that are equal in the order given (or where none
  is given) are put in order of their text;
* a table without rows gives the head and foot alone; names of columns may clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("csv", "tsv", "jsonl", "json")
MARK = "\N{ZERO WIDTH NO-BREAK SPACE}"


def _cell(c: Column, sep: str, alone: bool) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.contains(sep) | text.rlike('["\\r\\n]') | (F.lit(alone) & (text == "")), quoted).otherwise(text)


def _plain_cell(text: str, sep: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(x in text for x in (sep, '"', "\r", "\n")) else text


def lines(df: DataFrame, order: list[str], kind: str = "csv", bom: bool = False) -> DataFrame:
    """Rows (section, at, line, copy) that, sorted by these, are the lines of the file."""
    if kind not in KINDS:
        raise ValueError(f"unknown format: {kind}")
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    cells = [F.col(n) for n in names]
    sep = "\t" if kind == "tsv" else ","
    if kind in ("csv", "tsv"):
        line = F.concat_ws(sep, *(_cell(c, sep, len(cells) == 1) for c in cells))
    else:
        line = F.to_json(F.struct(*(c.alias(n) for c, n in zip(cells, df.columns, strict=True))), {"ignoreNullFields": "false"})
    at = F.struct(*(F.col(names[df.columns.index(c)]).alias(f"k{i}") for i, c in enumerate(order))) if order else F.struct(F.lit(0).alias("k0"))
    # equal records are counted before they are sorted: a record repeated without end is no hot key
    made = rows.select(at.alias("at"), line.alias("line")).groupBy("at", "line").agg(F.count(F.lit(1)).alias("n"))
    made = made.select(F.lit(1).alias("section"), "at", "line", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    edge = lambda section, text: df.sparkSession.range(1).select(F.lit(section).alias("section"), F.lit(None).cast(made.schema["at"].dataType).alias("at"), F.lit(text).alias("line"), F.lit(1).cast("long").alias("copy"))
    if kind in ("csv", "tsv"):
        return edge(0, (MARK if bom else "") + sep.join(_plain_cell(c, sep) for c in df.columns)).unionByName(made)
    if kind == "jsonl":
        return made
    last = made.agg(F.max(F.struct("at", "line", "copy")).alias("last"))  # one row
    made = made.join(F.broadcast(last)).withColumn("line", F.when(F.struct("at", "line", "copy") == F.col("last"), F.col("line")).otherwise(F.concat("line", F.lit(",")))).drop("last")
    return edge(0, "[").unionByName(made).unionByName(edge(2, "]"))


def write(df: DataFrame, path: str, order: list[str], kind: str = "csv", bom: bool = False, crlf: bool = False) -> None:
    """Write df as the parts of one file."""
    sorted_lines = lines(df, order, kind, bom).orderBy("section", "at", "line", "copy")
    sorted_lines.select(F.col("line").alias("value")).write.option("lineSep", "\r\n" if crlf else "\n").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The parts of an export: part, bytes, sha256, in the order in which they make the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("part")


def assets(df: DataFrame, row: str) -> DataFrame:
    """Every cell that is an address: (row, field, url); the column `row` tells the record."""
    others = [c for c in df.columns if c != row]
    cells = df.select(row, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("url")) for c in others))).alias("x"))
    return cells.select(F.col(row).alias("row"), "x.field", "x.url").filter(F.col("url").rlike("^https?://"))
