"""Removal of long repeats against counting every string of LENGTH bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakeprobe.llm import repeats
from lakeprobe.llm.common import documents
from lakeprobe.llm.run_index import RunIndex
from tests.llm.cases import empty, frame


def brute(items, length=repeats.LENGTH):
    starts = Counter(t[i : i + length] for t in items for i in range(len(t) - length + 1))
    for t in items:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def agree(spark, docs):
    items = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *x) for (i, _), x in zip(items, brute([t for _, t in items]), strict=True))
    assert Counter(tuple(r) for r in repeats.query(spark, docs).collect()) == want


def test_small_table(spark, sf):
    agree(spark, documents(spark, sf))


def test_cases(spark):
    agree(spark, frame(spark))


def periodic(seed=5):
    rng = random.Random(seed)
    words = ["ab", "abc", "the", "of", "zz", "é"]
    base = " ".join(rng.choice(words) for _ in range(120))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(200))), "en") for i in range(20)]
    rows += [(100 + i, base[rng.randrange(50) :] + rng.choice(words) * i + base[: rng.randrange(300)], "en") for i in range(30)]
    rows += [(200, "abc" * 300, "en"), (201, "abc" * 200, "en"), (202, "x" * 199, "en"), (203, "x" * 200, "en"), (204, "y" * 201, "en")]
    return rows


def test_periodic_texts(spark):
    agree(spark, frame(spark, periodic()))


def test_large_anchors_are_divided(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1500)
    agree(spark, frame(spark, periodic(7)))


def some(rng, k, letters="abcdefghijklmnopqrstuvwxyz"):
    return "".join(rng.choices(letters, k=k))


def low_anchor(rng):
    """A string of ANCHOR bytes with a hash that is the smallest wherever it stands."""
    return min((some(rng, repeats.ANCHOR) for _ in range(20_000)), key=lambda a: int(repeats.anchor_hashes(np.frombuffer(a.encode(), np.uint8))[0]))


def test_a_divided_string_does_not_match_itself(spark):
    rng, n, near = random.Random(3), 4000, 70
    anchor, left, right = low_anchor(rng), [some(rng, near) for _ in range(n)], [some(rng, near) for _ in range(n)]
    # each text shares its left part with one text and its right part with another; the last one repeats more of the first
    rows = [(i, some(rng, near) + left[i // 2] + anchor + right[(i + 1) // 2] + some(rng, near), "en") for i in range(n)]
    rows.append((n, some(rng, 50) + rows[0][1][20:300] + some(rng, 50), "en"))
    assert sum(len(t) for _, t, _ in rows) > repeats.BLOCK
    agree(spark, frame(spark, rows).coalesce(1))


def test_a_string_that_comes_to_a_key_by_two_ways_counts_once(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 600)
    rng, gap = random.Random(4), repeats.LENGTH - repeats.ANCHOR
    anchor, left, right = low_anchor(rng), some(rng, gap), some(rng, gap)
    # the first text shares one byte too few with each other text
    rows = [(0, left + anchor + right, "en")]
    rows += [(1 + x, some(rng, gap - x, "ABCDEFGH") + left[gap - x :] + anchor + right[: gap - 1 - x] + some(rng, x + 1, "ABCDEFGH"), "en") for x in range(gap)]
    agree(spark, frame(spark, rows).coalesce(1))


def test_a_passage_in_half_of_the_texts(spark):
    """One hot anchor and hot segments: they meet their texts by broadcast."""
    rng = random.Random(9)
    shared = some(rng, 420)
    rows = [(i, some(rng, 260) + (shared[rng.randrange(3) :] if i % 2 else "") + some(rng, 240), "en") for i in range(400)]
    agree(spark, frame(spark, rows))


def test_edges(spark):
    assert repeats.query(spark, empty(spark)).collect() == []
    assert len(repeats.query(spark, frame(spark, [(None, None, None)])).collect()) == 1


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    text = np.array([rng.randrange(2 + seed) for _ in range(200)] * 2 + [256] + [rng.randrange(3) for _ in range(100)])
    s = text.tolist()
    want = [max(next((k for k in range(len(s)) if p + k >= len(s) or q + k >= len(s) or s[p + k] != s[q + k]), 0) for q in range(len(s)) if q != p) for p in range(len(s))]
    assert RunIndex(text).matching_statistics().tolist() == want
