"""One query for each training-data operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from lakeprobe.llm import bpe, collocations, exact_dedup, fp_search, jaccard_join, langid, minmax_dedup, mixing, repeats, sharding, suffix_tree_lm, toxicity, winnowing
from lakeprobe.llm.common import documents, table

QUERIES = {
    "op1_ngram_jaccard": lambda spark, d: jaccard_join.query(spark, documents(spark, d)),
    "op2_bpe": lambda spark, d: bpe.query(spark, documents(spark, d)),
    "op3_suffix_dedup": lambda spark, d: repeats.query(spark, documents(spark, d)),
    "op4_mixing": lambda spark, d: mixing.query(spark, documents(spark, d), table(spark, d, "labels")),
    "op5_langid": lambda spark, d: langid.query(spark, table(spark, d, "pages"), documents(spark, d)),
    "op6_winnowing": lambda spark, d: winnowing.query(spark, documents(spark, d)),
    "op7_suffix_tree": lambda spark, d: suffix_tree_lm.query(spark, documents(spark, d)),
    "op8_toxicity": lambda spark, d: toxicity.query(spark, documents(spark, d), table(spark, d, "labels")),
    "op9_exact_dedup": lambda spark, d: exact_dedup.query(spark, documents(spark, d)),
    "op10_sharding": lambda spark, d: sharding.query(spark, documents(spark, d)),
    "op11_fp_search": lambda spark, d: fp_search.query(spark, documents(spark, d), table(spark, d, "benchmark")),
    "op12_collocations": lambda spark, d: collocations.query(spark, documents(spark, d)),
    "op13_minmax_dedup": lambda spark, d: minmax_dedup.query(spark, documents(spark, d)),
}
ORACLES = {"op9_exact_dedup": exact_dedup.SQL, "op11_fp_search": fp_search.SQL, "op12_collocations": collocations.SQL, "op13_minmax_dedup": minmax_dedup.SQL}
