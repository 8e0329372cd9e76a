"""Language ID by Bayesian evidence fusion.

Each record (a page, or a plain document) has up to four pieces of evidence:
* the text: likelihoods of its byte trigrams under each language;
* the language declared in the markup: its probability under each language, estimated
  over all records from their text posteriors;
* the suffix of the address and the host: a prior for the host, smoothed with that of
  its domain, which is smoothed with that of its suffix, which is smoothed with that of
  all records. All are sums of text posteriors by grouped aggregation; a record's own
  posterior is taken out of its host's prior.
The posterior is the normalised product.

Hosts with many records are counted before anything is shuffled and joined by
broadcast (a bounded number of them), so no task gathers the records of one host.

Defined results:
* null text, markup or address is missing evidence: it leaves the posterior as it is;
* ties go to the language that comes first; repeated rows get equal results, but each
  counts as evidence for its host;
* without labelled documents the language is null and the probability 0; an empty
  table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm import trigrams
from lakeprobe.llm.common import join_groups, text_of, written

#: Records that a prior of the next wider group counts for; the same for declarations.
WEIGHT = 5.0
DROPPED = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;")
#: Where markup declares a language, the first that does so counts.
DECLARED = (
    r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,8})", r"(?is)<html\b[^>]*?\sxml:lang\s*=\s*[\"']?([a-z]{2,8})",
    r"(?is)<meta\b[^>]*?content-language[^>]*?\bcontent\s*=\s*[\"']?([a-z]{2,8})", r"(?is)<body\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,8})",
)
#: An address of numbers is its own domain; so is what stands before a second-level suffix.
DOMAIN = r"(\d+(?:\.\d+){3}|[^.]+\.(?:(?:co|com|org|net|ac|gov|edu)\.)?[^.]+)$"


def visible(html: str) -> str:
    """The text of a page without markup, scripts, styles and entities."""
    return " ".join(DROPPED.sub(" ", html).split()) if "<" in html else html


def records(pages: DataFrame | None, docs: DataFrame | None) -> DataFrame:
    """Rows (kind, id, text, declared, host, domain, suffix) of pages and plain documents; a document's source is its host."""
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    parts = []
    if pages is not None:
        p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), text_of("html").alias("html")).withColumn("host", host)
        parts.append(
            p.select(
                F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"),
                F.coalesce(*[F.nullif(F.lower(F.regexp_extract("html", d, 1)), F.lit("")) for d in DECLARED]).alias("declared"), "host",
                F.regexp_extract("host", DOMAIN, 1).alias("domain"), F.regexp_extract("host", r"([^.]+)$", 1).alias("suffix"),
            )
        )
    if docs is not None:
        source = F.coalesce(F.col("source").cast("string"), F.lit(""))
        parts.append(
            docs.select(
                F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), text_of().alias("text"), F.lit(None).cast("string").alias("declared"),
                F.concat(F.lit("source:"), source).alias("host"), F.lit("source:").alias("domain"), F.lit("source:").alias("suffix"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    total = sum(powers[1:], powers[0])
    return [x / total for x in powers]


def identify(rows: DataFrame, model: trigrams.Trigrams) -> DataFrame:
    """A row (kind, id, lang, probability, text_lang, declared, host) for each record."""
    languages = model.labels
    if not languages:
        return rows.select("kind", "id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    k = range(len(languages))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.likelihoods(visible(t.as_py())).tolist() for t in b.column("text")]
            columns = [b.column(c) for c in ("kind", "id", "declared", "host", "domain", "suffix")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.float64()))], ["kind", "id", "declared", "host", "domain", "suffix", "ll"])

    seen = rows.mapInArrow(likelihoods, "kind string, id long, declared string, host string, domain string, suffix string, ll array<double>")
    seen = written(seen.withColumn("declared", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.when(F.col("declared").isNotNull(), F.lit("other")))), "evidence")
    soft = _softmax([F.get("ll", F.lit(i)) for i in k])
    seen = seen.select("*", *[s.alias(f"s{i}") for i, s in zip(k, soft, strict=True)])
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in k]
    hosts = written(seen.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), *sums), "hosts")
    n = hosts.agg(F.sum("n").alias("n"), *sums).first()
    everywhere = [((n[f"s{i}"] or 0.0) + 1) / ((n["n"] or 0) + len(languages)) for i in k]

    def shares(t: DataFrame, level: str, wider: list[Column]) -> list[Column]:
        return [((F.col(f"s{i}") + WEIGHT * wider[i]) / (F.col("n") + WEIGHT)).alias(f"{level}{i}") for i in k]

    # suffixes and domains with many members meet them by broadcast (join_groups): com is no key of one task
    by_domain = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *sums), "domains")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("domains"), *sums)
    suffixes = by_suffix.select("suffix", "domains", *shares(by_suffix, "suffix", [F.lit(x) for x in everywhere]))
    with_suffix = join_groups(by_domain, suffixes, "suffix", "domains", by_domain.count())
    domains = with_suffix.select("domain", "suffix", "hosts", *shares(with_suffix, "domain", [F.col(f"suffix{i}") for i in k]))
    # hosts without a dot have no domain: their suffix tells them apart
    priors = join_groups(hosts, domains, ["domain", "suffix"], "hosts", hosts.count())
    priors = priors.select("host", F.col("n").alias("records"), *[F.col(f"s{i}").alias(f"h{i}") for i in k], *[f"domain{i}" for i in k])
    # one small row for each declaration that is a known language, or "other"
    said = {r["declared"]: r for r in seen.filter("declared IS NOT NULL").groupBy("declared").agg(*sums).collect()}
    totals = [sum(r[f"s{i}"] for r in said.values()) for i in k]
    kinds = len(languages) + 1

    def declared(i: int) -> Column:
        out = F.lit(1.0)
        for name, r in said.items():
            out = F.when(F.col("declared") == name, F.lit((r[f"s{i}"] + WEIGHT / kinds) / (totals[i] + WEIGHT))).otherwise(out)
        return out

    joined = join_groups(seen, priors, "host", "records", n["n"] or 0)
    prior = [(F.greatest(F.col(f"h{i}") - F.col(f"s{i}"), F.lit(0.0)) + WEIGHT * F.col(f"domain{i}")) / (F.col("records") - 1 + WEIGHT) for i in k]
    posterior = _softmax([F.get("ll", F.lit(i)) + F.log(prior[i]) + F.log(declared(i)) for i in k])
    joined = joined.withColumn("p", F.array(*posterior))
    best = lambda c: F.get(F.lit(languages), (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return joined.select("kind", "id", best("p").alias("lang"), F.round(F.array_max("p"), 6).alias("probability"), best("ll").alias("text_lang"), "declared", "host")


def fit(docs: DataFrame) -> trigrams.Trigrams:
    """A text model from documents with a declared language: at most trigrams.SAMPLE of them."""
    return trigrams.fit(docs, docs.select("doc_id", F.col("lang").alias("label")))


def query(spark: SparkSession, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The language of every page and of every document."""
    out = identify(records(pages, docs), fit(docs))
    own = lambda kind, name: F.when(F.col("kind") == kind, F.col("id")).alias(name)
    return out.select("kind", own("document", "doc_id"), own("page", "page_id"), "lang", "probability", "text_lang", "declared", "host")
