"""Reading untyped tables: format and delimiter are sniffed, every cell is text or null."""

from __future__ import annotations

import csv
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import cells
from lakeprobe.functions.json_ops import is_json
from lakeprobe.session import shared_dir
from lakeprobe.sources import exports

#: Delimiters that are tried, encodings in the order they are tried, and keys under which a JSON object may hold its list of records.
DELIMITERS = (",", ";", "\t", "|")
ENCODINGS = ("UTF-8", "windows-1251", "ISO-8859-1")
LISTS = ("data", "items", "records", "rows", "results")


@dataclass(frozen=True)
class Loaded:
    """A table, the encoding it was read in, whether rows were cut off, and the columns that were."""

    df: DataFrame
    encoding: str
    truncated: bool
    dropped_columns: list[str]


#: What the bytes from 128 on are in Latin-1 and in windows-1251.
UPPER = bytes(range(0x80, 0x100))
LATIN, CYRILLIC = UPPER.decode("latin-1"), UPPER.decode("cp1251", "replace")


def read_as(encoding: str) -> str:
    """The encoding that Spark reads in: windows-1251 is none of its own, and is read byte by byte."""
    return "UTF-8" if encoding == "UTF-8" else "ISO-8859-1"


def decoded(c: Column, encoding: str) -> Column:
    """Text that was read by read_as() in its own letters."""
    return F.translate(c, LATIN, CYRILLIC) if encoding == "windows-1251" else c


def line(encoding: str) -> Column:
    """A line of a text file, whose bytes Spark's reader leaves as they are."""
    value = F.col("value")
    return value if encoding == "UTF-8" else decoded(F.decode(value.cast("binary"), read_as(encoding)), encoding)


def head(spark: SparkSession, path: str, lines: int = 20, encoding: str = "UTF-8") -> list[str]:
    """The first lines of a file that are not blank, read by Spark."""
    return [r["value"] for r in spark.read.text(path).select(line(encoding).alias("value")).filter(F.trim("value") != "").limit(lines).collect()]


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first encoding in which no line of a file has an unreadable byte; all lines are looked at, where they are."""
    for name in ENCODINGS[:-1]:
        bad = ~F.is_valid_utf8("value") if name == "UTF-8" else F.contains(line(name), F.lit("\ufffd"))
        if spark.read.text(path).filter(bad).isEmpty():
            return name
    return ENCODINGS[-1]


def sniff(lines: list[str]) -> str:
    """The delimiter that most lines have as often as the first one does, outside of quotes; of equals the one that makes more columns."""

    def columns(line: str, delimiter: str) -> int:
        return len(next(csv.reader([line], delimiter=delimiter)))

    def fit(delimiter: str) -> tuple[int, int]:
        widths = [columns(line, delimiter) for line in lines]
        return (widths.count(widths[0]), widths[0]) if widths and widths[0] > 1 else (0, 0)

    best = max(DELIMITERS, key=fit)
    return best if fit(best) > (0, 0) else ","


def dedupe(names: list[str]) -> list[str]:
    """Blank names become column_i; the first repetition of a name ends in __1, the next in __2."""
    named = [(n or "").strip() or f"column_{i}" for i, n in enumerate(names, 1)]
    times = [named[:i].count(n) for i, n in enumerate(named)]
    return [f"{n}__{k}" if k else n for n, k in zip(named, times, strict=True)]


def normalized(df: DataFrame) -> DataFrame:
    """All columns as text, missing tokens as null."""
    return df.select(*[cells.normalize(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A delimited file: encoding and delimiter sniffed, headers made unique, quoted line breaks kept, short rows padded, long ones cut."""
    encoding = encoding or encoding_of(spark, path)
    lines = head(spark, path, encoding=encoding)
    if not lines:
        raise ValueError("the file is empty")
    # only a quoted line break leaves a line with an odd number of quotes; without any, the file is read in parallel
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    broken = not spark.read.text(path).filter(odd).isEmpty()
    options = {"sep": sniff(lines), "encoding": read_as(encoding), "multiLine": broken, "escape": '"'}
    first = spark.read.options(**options).csv(path)
    header = first.select(*[decoded(F.col(c), encoding).alias(c) for c in first.columns]).first()
    names = dedupe([(v or "").lstrip("\ufeff") for v in header])
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    df = spark.read.schema(schema).options(**options, header=True, enforceSchema=True, mode="PERMISSIVE").csv(path)
    return normalized(df.select(*[decoded(F.col(c), encoding).alias(c) for c in df.columns]).toDF(*names))


def _members(path: str, spark: SparkSession, order: list[str]) -> list[str]:
    """Columns in the order in which their names first occur in the file's head; the others after them, by name."""
    text = "".join(head(spark, path, 200))
    at = {c: text.find(f'"{c}"') for c in order}
    return sorted(order, key=lambda c: (at[c] < 0, at[c], c))


def listed_lines(spark: SparkSession, path: str) -> str | None:
    """The path of JSON lines made of a JSON list that has one object on each line; None for lists that are written in another way.

    Such a list is read in parallel: brackets stand at the first and the last line, and
    one comma between any two objects.
    """
    t = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), t.alias("t")).filter("t <> ''")
    inner = F.trim(F.regexp_replace(F.regexp_replace("t", r"^\s*\[?\s*,?\s*", ""), r"\s*,?\s*\]?\s*$", ""))
    rows = rows.withColumn("object", F.when(F.col("t").rlike(r"^[\[,{]") & F.col("t").rlike(r"[\],}]$") & inner.startswith("{"), inner))
    lone = F.col("t").isin("[", "]", ",")
    comma = F.col("t").rlike(r"^\[?\s*,").cast("int") + (F.col("t").rlike(r",\s*\]?$") & (F.col("t") != ",")).cast("int")
    opens, closes = F.col("t").startswith("["), F.col("t").endswith("]")
    got = rows.agg(
        F.count_if(~lone & ~is_json(F.coalesce("object", F.lit("")))).alias("odd"), F.count("object").alias("objects"), F.sum(comma).alias("commas"), F.count_if(opens).alias("opens"), F.count_if(closes).alias("closes"),
        (F.min(F.when(opens, F.col("at"))) == F.min("at")).alias("first"), (F.max(F.when(closes, F.col("at"))) == F.max("at")).alias("last"),
    ).first()
    if got["odd"] or not got["objects"] or got["commas"] != got["objects"] - 1 or (got["opens"], got["closes"]) != (1, 1) or not (got["first"] and got["last"]):
        return None
    made = f"{shared_dir(spark)}/json-lines-{uuid.uuid4().hex}"
    rows.filter("object IS NOT NULL").select(F.col("object").alias("value")).write.text(made)
    return made


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, a JSON list, or an object that holds its records under a known key; keys as first seen, nested values stay JSON text.

    An item of a list that is no object, and a line that is no JSON, raise ValueError; a line's number is told.
    """
    first = head(spark, path, 1)
    if not first:
        raise ValueError("the file is empty")
    start = first[0].lstrip("\ufeff").strip()
    names = path
    if start.startswith("[") and (made := listed_lines(spark, path)):
        path, start = made, "{}"
    whole = start.startswith("[") or not start.endswith("}")
    if not whole:
        bad = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
        bad = bad.filter((F.trim("value") != "") & (F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"))).agg(F.min("at")).first()[0]
        if bad is not None:
            before = spark.read.text(path).select(F.monotonically_increasing_id().alias("at")).filter(F.col("at") <= bad).count()
            raise ValueError(f"line {before} is no JSON object")
    elif start.startswith("["):
        text = spark.read.option("wholetext", True).text(path)
        odd = text.select(F.explode(F.from_json(F.regexp_replace("value", "^\ufeff", ""), "array<string>")).alias("item")).filter(~F.trim("item").startswith("{"))
        if not odd.isEmpty():
            raise ValueError("an item of the list is no object")
    df = spark.read.option("multiLine", whole).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    held = next((k for k in LISTS if k in df.columns and df.schema[k].dataType.typeName() == "array"), None)
    if held:
        df = df.select(F.explode(held).alias("r")).select("r.*")
    flat = {f.name: F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`") for f in df.schema}
    return normalized(df.select(*[flat[c] for c in _members(names, spark, df.columns)]))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the name's ending or the first character: JSON, else a delimited file."""
    first = head(spark, path, 1)
    if not first:
        raise ValueError("the file is empty")
    if path.endswith((".json", ".ndjson", ".jsonl")) or first[0].lstrip("\ufeff \t")[:1] in ("[", "{"):
        return read_json(spark, path)
    return read_csv(spark, path)


def load_table(spark: SparkSession, path: str, max_rows: int | None = None, max_columns: int | None = None, max_bytes: int | None = None) -> Loaded:
    """read_table() within limits: what is cut off is told. A file of more than max_bytes is refused before it is read."""
    if max_bytes is not None:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        if size > max_bytes:
            raise ValueError(f"the file has {size} bytes; {max_bytes} are allowed")
    df = read_table(spark, path)
    dropped = df.columns[max_columns:] if max_columns is not None else []
    df = df.drop(*dropped) if dropped else df
    truncated = max_rows is not None and df.limit(max_rows + 1).count() > max_rows
    return Loaded(df.limit(max_rows) if truncated else df, encoding_of(spark, path), truncated, dropped)


def write_table(df: DataFrame, path: str, kind: str = "csv", sep: str = ",", crlf: bool = False, bom: bool = False) -> None:
    """csv, tsv, ndjson or json (one list, whose parts are put one after the other); bom marks csv and tsv files, whose headers begin with it."""
    if kind in ("csv", "tsv"):
        marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else df
        marked.write.option("header", True).option("sep", "\t" if kind == "tsv" else sep).option("lineSep", "\r\n" if crlf else "\n").csv(path)
    elif kind == "ndjson":
        df.write.json(path)
    elif kind == "json":
        exports.write(df, path, [], "json")
    else:
        raise ValueError(f"unknown format: {kind}")
