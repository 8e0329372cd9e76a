"""A catalog of interfaces from its JSON file: a declared schema, and one rule for what a record doesn't say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a record, with their types and what they are where the file doesn't say; None: no default.
FIELDS = {
    "id": ("string", None), "name": ("string", None), "category": ("string", None), "description": ("string", None), "auth": ("string", "none"), "free_type": ("string", "free_forever"),
    "request_limit": ("string", "Not specified"), "rate_limit": ("string", "Not specified"), "commercial_use": ("string", "Not specified"), "cors": ("boolean", False), "https": ("boolean", True),
    "formats": ("array<string>", []), "sdk": ("boolean", False), "docs_url": ("string", ""), "verify_url": ("string", None), "source": ("string", "official_docs"), "why_useful": ("string", ""), "project_ideas": ("array<string>", []),
}
REQUIRED = ("id", "name", "category", "description")
VERIFIED = "docs_verified"
SCHEMA = "curated_at string, apis array<struct<" + ", ".join(f"{n}: {t}" for n, (t, _) in FIELDS.items()) + ", last_verified_at: string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of catalog files ({curated_at, apis: [...]}): FIELDS, status and last_verified_at.

    A record without one of the required fields, and a file that is no such object, are
    left out; a record that doesn't tell when it was verified was so when the file was curated.
    """
    files = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    rows = files.select("curated_at", F.explode("apis").alias("a"))
    for name in REQUIRED:
        rows = rows.filter(F.col(f"a.{name}").isNotNull())
    value = lambda n, kind, default: F.col(f"a.{n}") if default is None else F.coalesce(F.col(f"a.{n}"), F.array().cast(kind) if default == [] else F.lit(default))
    return rows.select(
        *(value(n, kind, default).alias(n) for n, (kind, default) in FIELDS.items()), F.lit(VERIFIED).alias("status"), F.coalesce("a.last_verified_at", "curated_at", F.lit("")).alias("last_verified_at")
    )
