"""Near-duplicate components against brute force over all pairs, with blocks of any size, and their defined results."""

from __future__ import annotations

import random
import re

import pytest

from lakeprobe.llm import minmax_dedup
from tests.llm.cases import ROWS, empty, frame


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain(rows):
    """The contract over all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 20 * len(a) >= 17 * len(b) and 20 * len(b) >= 17 * len(a) and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if r not in least or least[r] is None or (doc is not None and doc < least[r]):
            least[r] = doc
    return sorted(((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus(seed, groups=12, size=14):
    some, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{some.randint(0, 400)}" for _ in range(some.choice([3, 5, 9, 60, 200, 400]))]
        for _ in range(some.randint(1, size)):
            words = list(base)
            for _ in range(some.choice([0, 0, 1, 1, 2, 3, 6])):
                at = some.randrange(len(words))
                words[at : at + 1] = some.choice([["new"], [], [words[at].upper(), "x"]])
            rows.append(" ".join(words))
            base = words if g % 3 == 0 else base  # chains, whose ends may be far apart
    some.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("limit", "block"), [(512, 1024), (4, 3)])
def test_components_equal_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(minmax_dedup, "LIMIT", limit)
    monkeypatch.setattr(minmax_dedup, "BLOCK", block)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert len({r[2] for r in want}) < len(rows) - 20
    assert rows_of(minmax_dedup.query(spark, docs)) == want


def test_one_chain_in_half_of_the_rows(spark, monkeypatch):
    """A chain of near copies whose ends have nothing in common, in blocks so small that most links lie between blocks."""
    monkeypatch.setattr(minmax_dedup, "BLOCK", 8)
    monkeypatch.setattr(minmax_dedup, "LIMIT", 6)
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 150])) for i in range(60)] + [(100 + i, " ".join(f"r{i}x{j}" for j in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = plain(rows)
    assert len({r[2] for r in want}) == 61
    assert rows_of(minmax_dedup.query(spark, docs)) == want


def test_cases_have_a_result(spark):
    rows = [(i, t) for i, t, _ in ROWS]
    assert rows_of(minmax_dedup.query(spark, frame(spark))) == plain(rows)
    assert rows_of(minmax_dedup.query(spark, empty(spark))) == []
    assert rows_of(minmax_dedup.query(spark, frame(spark, [(1, None, "en"), (2, "", "en"), (2, " ", None)]))) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_dedup_keeps_the_columns(spark):
    docs = frame(spark)
    kept = minmax_dedup.dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "3", "4", "5", "6", "8", "9", "10", "None", "None", "12", "13"])


def test_signatures_tell_the_similarity():
    """Minima and maxima agree as often as the sets do, and less variably than as many permutations' minima would."""
    import numpy as np

    from lakeprobe.llm.jaccard_join import multipliers

    some = np.random.default_rng(1)
    factors, seen = multipliers(60), []
    for _ in range(60):
        s = some.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(s[:260]), np.unique(s[40:])
        seen.append((minmax_dedup.min_max(a, factors) == minmax_dedup.min_max(b, factors)).mean())
    assert abs(np.mean(seen) - 220 / 300) < 0.02
    assert minmax_dedup.missed() < 1e-6


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(minmax_dedup.query(spark, docs)) == plain(rows)
