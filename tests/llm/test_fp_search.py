"""Search by FP-trees against scoring every document, with trees and blocks of any size, and its defined results."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lakeprobe.llm import fp_search
from tests.llm.cases import ROWS, empty, frame

ITEMS = [(1, "The quick brown fox, the FOX"), (2, "shared passage of the long kind; zzz"), (3, ""), (4, None), (5, "wörld 😀 ünïcode x"), (6, "unknownword only"), (7, "word1 and3 word44 word500 end"), (7, "word1 and3 word44 word500 end"), (None, "idiot jumps")]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, best=10):
    """The contract, document by document."""
    docs = [(i, terms(t)) for i, t in rows]
    docs = [(i, len(t), Counter(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(n for _, n, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, []).extend(terms(text))
    for item, found in asked.items():
        scored = []
        for i, n, c in docs:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in found if c[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, x[2], x[3]) for rank, x in enumerate(scored[:best], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(n, seed=4):
    some = random.Random(seed)
    words = [f"t{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [(i, " ".join(some.choices(words, weights, k=some.choice([0, 1, 3, 30, 300])))) for i in range(n)], [(i, " ".join(some.choices(words, k=some.randint(1, 12)))) for i in range(15)]


def test_cases_have_a_result(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows_of(fp_search.query(spark, frame(spark), items)) == plain([(i, t) for i, t, _ in ROWS], ITEMS)
    assert rows_of(fp_search.query(spark, empty(spark), items)) == []
    assert rows_of(fp_search.query(spark, frame(spark), items.limit(0))) == []


@pytest.mark.parametrize(("block", "postings"), [(200_000, 1 << 20), (20, 50)])
def test_best_equal_scoring_everything(spark, block, postings):
    rows, items = corpus(300)
    rows += [(1000 + i, rows[7][1] or "t1 t2") for i in range(300)]  # copies make up half of the rows
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(fp_search.search(docs, asked, block=block, postings=postings)) == plain(rows, items)
    assert rows_of(fp_search.search(docs, asked, best=3, block=block, postings=postings)) == plain(rows, items, 3)


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_trees_leave_nothing_out(leaf):
    """Whatever the leaves, the bounds never hide one of the best documents; and few subtrees are opened."""
    some = np.random.default_rng(leaf)
    docs = []
    for key in range(400):
        path = np.flatnonzero(some.random(30) < 1 / (1 + np.arange(30) / 3)).astype(">u4")
        docs.append((path.tobytes(), some.integers(1, 9, len(path)).astype("<i4").tobytes(), int(some.integers(25, 400)), key))
    docs = sorted((d for d in docs if d[0]), key=lambda d: (d[0], d[3]))
    paths, tfs, m, keys = zip(*docs, strict=True)
    tree = fp_search.FPTree(paths, tfs, np.array(m), np.array(keys), leaf)
    for lo, hi in tree.nodes:
        assert lo < hi
    for _ in range(30):
        weight = np.where(some.random(30) < 0.3, some.integers(0, 5000, 30), 0)
        want = []
        for path, tf, m_, key in docs:
            score = sum(int(weight[t]) * int(1_000_000_000 * int(n) // (1000 * int(n) + 8 * m_)) for t, n in zip(np.frombuffer(path, ">u4"), np.frombuffer(tf, "<i4"), strict=True))
            want.append((score, -key))
        best = []
        tree.search(weight, best, 10)
        assert sorted(best) == sorted(x for x in sorted(want)[-10:] if x[0] > 0)


def test_query_equals_plain_scores(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows, asked = ([tuple(r) for r in t.collect()] for t in (docs.select("doc_id", "text"), items.select("item_id", "text")))
    assert rows_of(fp_search.query(spark, docs, items)) == plain(rows, asked)
