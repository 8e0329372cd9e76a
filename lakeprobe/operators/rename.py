"""Batch rename planning: a chain of rules, name checks, collisions and a summary."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprobe.operators.ordering import numbered

#: Characters and device names that a file name must not hold.
RESERVED = r'[<>:"/\\|?*]'
DEVICES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


@dataclass(frozen=True)
class Rule:
    """kind: prefix, suffix, replace, regex, lower, upper, title or numbering; numbering takes start, step, width and where."""

    kind: str
    a: str = ""
    b: str = ""
    start: int = 1
    step: int = 1
    width: int = 1
    where: str = "prefix"


def base(name: Column) -> Column:
    """The name up to its last dot; a leading dot begins no extension."""
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1)


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)


def _padded(n: Column, width: int) -> Column:
    size = F.abs(n).cast("string")
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lpad(size, F.greatest(F.length(size), F.lit(width)), F.lit("0")))


def apply(rule: Rule, stem: Column, index: Column) -> Column:
    """A rule on a base name; index counts the rows from 0."""
    if rule.kind == "regex":
        try:
            re.compile(rule.a)
        except re.error:  # a rule that can't be applied is skipped
            return stem
        return F.regexp_replace(stem, rule.a, re.sub(r"\\(\d)", r"$\1", rule.b))
    number = _padded(index * rule.step + rule.start, rule.width)
    return {
        "prefix": lambda: F.concat(F.lit(rule.a), stem),
        "suffix": lambda: F.concat(stem, F.lit(rule.a)),
        "replace": lambda: F.replace(stem, F.lit(rule.a), F.lit(rule.b)) if rule.a else stem,
        "lower": lambda: F.lower(stem),
        "upper": lambda: F.upper(stem),
        "title": lambda: F.array_join(F.transform(F.regexp_extract_all(stem, F.lit(r"(\p{L}+|\P{L}+)"), 1), lambda w: F.initcap(w)), ""),
        "numbering": lambda: F.concat(number, F.lit(rule.a), stem) if rule.where == "prefix" else F.concat(stem, F.lit(rule.a), number),
    }[rule.kind]()


def faults(rules: list[Rule]) -> list[tuple[int, str]]:
    """Number and fault of the rules that can't be applied; renamed() skips them."""
    out = []
    for i, rule in enumerate(rules):
        if rule.kind == "regex":
            try:
                re.compile(rule.a)
            except re.error as e:
                out.append((i, f"{rule.a}: {e}"))
    return out


def renamed(df: DataFrame, rules: list[Rule], name: str = "name", key: str = "id") -> DataFrame:
    """df with new_name: the rules in order on the part before the extension."""
    rows = numbered(df, key, "__index") if any(r.kind == "numbering" for r in rules) else df.withColumn("__index", F.lit(0))
    stem = base(F.col(name))
    for rule in rules:
        stem = apply(rule, stem, F.col("__index"))
    return rows.withColumn("new_name", F.concat(stem, extension(F.col(name)))).drop("__index")


def problems(c: Column) -> Column:
    """array<string> of what is wrong with a name; a blank name has that problem only."""
    checks = [
        F.when(c.isin(".", ".."), "dot_name"), F.when(c.rlike(RESERVED), "reserved_character"), F.when(c.rlike(r"[\x00-\x1f\x7f]"), "control_character"),
        F.when(F.lower(F.substring_index(c, ".", 1)).isin(*DEVICES), "reserved_name"), F.when(F.length(c) > 255, "too_long"), F.when(c.rlike(r"[ .]$"), "trailing_space_or_dot"),
    ]
    return F.when(F.trim(c) == "", F.array(F.lit("empty"))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))


def folded(name: str) -> Column:
    """A name without its case: through upper case, so that letters with several lower forms, and those that become two, are alike."""
    # lower(upper(x)) alone would be simplified to lower(x)
    return F.lower(F.concat(F.upper(name), F.lit("")))


def conflicts(plan: DataFrame) -> DataFrame:
    """Names that two rows or more end up with, whatever their case."""
    groups = plan.groupBy(folded("new_name").alias("folded")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("new_name").alias("spellings"))
    return groups.filter("rows >= 2").withColumn("case_only", F.col("spellings") > 1)


def conflict_members(plan: DataFrame, key: str, name: str = "name") -> DataFrame:
    """The rows of every conflict: key, folded name, old and new name, whether the spellings differ, and the new name of the member with the smallest key."""
    shown = plan.groupBy(folded("new_name").alias("folded")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("new_name").alias("spellings"), F.min_by("new_name", key).alias("shown"))
    found = plan.withColumn("folded", folded("new_name")).join(shown.filter("rows >= 2"), "folded")
    return found.select(key, "folded", F.col(name).alias("old_name"), "new_name", (F.col("spellings") > 1).alias("case_only"), "shown")


def checked(plan: DataFrame) -> DataFrame:
    """A plan's rows with the problems of their new names and whether another row ends up with the same name; valid without either."""
    clashing = conflicts(plan).select("folded", F.lit(True).alias("clash"))
    rows = plan.withColumn("problems", problems(F.col("new_name"))).withColumn("folded", folded("new_name")).join(clashing, "folded", "left").drop("folded")
    return rows.withColumn("clash", F.coalesce("clash", F.lit(False))).withColumn("valid", ~F.col("clash") & (F.size("problems") == 0))


def summary(plan: DataFrame, name: str = "name") -> DataFrame:
    """Totals of a plan; it is valid without conflicts and problems."""
    bad = F.size(problems(F.col("new_name"))) > 0
    totals = plan.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(name) != F.col("new_name")).alias("changed"), F.count_if(bad).alias("errors"))
    clashes = conflicts(plan).agg(F.count(F.lit(1)).alias("conflicts"))
    return totals.join(F.broadcast(clashes)).withColumn("valid", (F.col("errors") == 0) & (F.col("conflicts") == 0))
