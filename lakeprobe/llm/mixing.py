"""Mixing to target weights by soft membership.

A classifier learned from the labelled table gives each document posteriors over the
domains, since a document's source does not say what it is about. Each document then
gets a rate of at least 0 (how often it is to be read); the rates solve the least
squares problem that the expected tokens of each domain, sum of rate * tokens *
posterior, match the target, by projected gradient steps from rate 1.

A gradient step needs only the residual of each domain, so a step is one aggregation
of the written posteriors, and a rate is a fold over the last residuals; it is written
down every FOLDED steps. A bound on the rates (`most`) is projected onto as 0 is. Squares are weighted by one over the domain's tokens and gradients
by one over the document's, so the step 1 is never too long and long documents move
like short ones.

Defined results:
* null text is the empty text, with no tokens and flat posteriors; documents whose
  posteriors favour no domain are moved by all targets alike;
* by default targets are in proportion to the square root of the domains' tokens, and
  their sum is the least for which no domain must shrink, so documents are repeated
  rather than dropped; given targets may let rates fall to 0;
* where no rates meet the targets, the last step's are taken and a warning tells what
  is missed;
* copies rounds the rate up or down by a hash of the id and text, so that copies are
  right on average; repeated rows get equal rates;
* without labelled rows there is one domain, `all`, and every rate is 1; an empty table
  gives an empty result; other columns are carried along by mixed().
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm import trigrams
from lakeprobe.llm.common import discard, field, packed, text_of, unpacked, written

#: Steps at most, those after which rates are written down, and the relative residuals at which to stop and to be content.
STEPS, FOLDED, TOLERANCE, ENOUGH = 120, 10, 1e-6, 1e-3
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, label): the language of the documents that the labelled table calls good."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("__good")).distinct()
    return docs.join(good, F.col("doc_id") == F.col("__good")).select("doc_id", F.col("lang").alias("label"))


def posteriors(docs: DataFrame, model: trigrams.Trigrams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written rows (doc_id, t, tokens, p): the posterior of each domain for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if not model.labels:
        tokens = F.regexp_count("text", F.lit(WORD.pattern)).cast("long")
        return written(rows.select("doc_id", F.xxhash64("text").alias("t"), tokens.alias("tokens"), F.array(F.lit(1.0)).alias("p")), "mix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, p = [], []
            for text in b.column("text"):
                s = text.as_py()
                e = np.exp(model.likelihoods(s))
                tokens.append(len(WORD.findall(s)))
                p.append((e / e.sum()).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["doc_id", "t", "tokens", "p"])

    return written(rows.withColumn("t", F.xxhash64("text")).mapInArrow(run, "doc_id long, t long, tokens long, p array<double>"), "mix")


def rate_after(history: list[list[float]], most: float | None = None) -> Column:
    """The rate of a document after the steps whose gradients (one number per domain) are given, from the column `rate`."""
    if not history:
        return F.col("rate")
    step = lambda p, g: F.aggregate(F.zip_with(p, g, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    held = (lambda r: F.greatest(F.lit(0.0), r)) if most is None else (lambda r: F.least(F.lit(most), F.greatest(F.lit(0.0), r)))
    return F.aggregate(F.lit(history), F.col("rate"), lambda r, g: held(r - step(F.col("p"), g)))


def totals(rows: DataFrame, domains: int, rate: Column) -> np.ndarray:
    """Expected tokens of each domain at the given rates."""
    sums = rows.agg(*[F.coalesce(F.sum(F.get("p", F.lit(k)) * F.col("tokens") * rate), F.lit(0.0)).alias(f"d{k}") for k in range(domains)]).first()
    return np.array(list(sums), dtype=float)


def default_targets(have: np.ndarray) -> np.ndarray:
    """Totals in proportion to the square roots, none below what is there."""
    weight = np.sqrt(have)
    held = have > 0
    return weight * (have[held] / weight[held]).max() if held.any() else have


def solve(rows: DataFrame, domains: int, targets: np.ndarray | None = None, most: float | None = None) -> tuple[DataFrame, float]:
    """rows (tokens, p...) with their rates, and what is left of the largest relative residual.

    Steps are folded over the gradients since the rates were last written down, every FOLDED steps.
    """
    rows = rows.withColumn("rate", F.lit(1.0))
    have = totals(rows, domains, F.col("rate"))
    targets = default_targets(have) if targets is None else np.asarray(targets, dtype=float)
    scale = np.where(have > 0, 1 / np.maximum(have, 1e-9), 0.0)
    now, history, kept = have, [], None
    for step in range(STEPS):
        residual = now - targets
        if np.abs(residual * scale).max(initial=0) <= TOLERANCE:
            break
        history.append((residual * scale).tolist())
        if len(history) == FOLDED:
            last, kept = kept, written(rows.withColumn("rate", rate_after(history, most)), "rates")
            rows, history = kept, []
            if last is not None:
                discard(last)
        now = totals(rows, domains, rate_after(history, most))
    left = float(np.abs((now - targets) * scale).max(initial=0))
    if left > ENOUGH:
        # documents whose posteriors are mixed, or a bound on the rates, may leave no better ones
        logging.getLogger(__name__).warning("mixing: after %d steps the targets are missed by %.2g of what is there", step + 1, left)
    return rows.withColumn("rate", rate_after(history, most)), left


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """Rows (doc_id, t, tokens, p, rate, copies), and the domains in the order of p. targets: tokens by domain; most: the highest rate, if any."""
    model = trigrams.fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labelled)
    domains = model.labels or ["all"]
    rows = posteriors(docs, model, id_col, text_col)
    solved, _ = solve(rows, len(domains), None if targets is None else np.array([targets.get(d, 0.0) for d in domains]), most)
    # sums of doubles depend on their order: a millionth more or less must not decide on a copy
    out = solved.withColumn("rate", F.round("rate", 4))
    chance = F.pmod(F.xxhash64("doc_id", "t", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", F.floor(F.col("rate") + chance).cast("int")), domains


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, least: int = 0, most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as often as its rate says, at least `least` times, with the columns of docs."""
    chosen, _ = rates(docs, labelled, targets, most, id_col, text_col)
    times = chosen.groupBy(F.col("doc_id").alias("id"), "t").agg(F.greatest(F.max("copies"), F.lit(least)).alias("copies"))
    marked = packed(docs).withColumn("own", F.xxhash64(text_of(field(docs, text_col))))
    joined = marked.join(times, F.col(field(docs, id_col)).cast("long").eqNullSafe(F.col("id")) & (F.col("own") == F.col("t")))
    return unpacked(joined.withColumn("nth", F.explode(F.array_repeat(F.lit(1), F.col("copies")))), docs)


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Posteriors, rate and copies of every document."""
    out, domains = rates(docs, labelled_domains(docs, labels))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return out.select("doc_id", "tokens", F.get(F.lit(domains), best - 1).alias("domain"), F.transform("p", lambda x: F.round(x, 6)).alias("posteriors"), "rate", "copies")
