"""Documents that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, `key` string, row long"

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
SHARED = " ".join(f"shared passage number {i} of the long kind" for i in range(12))

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog. you idiot", "en"),
    (2, "the quick brown fox jumps over the lazy dog. you idiot", "en"),
    (2, "the quick brown fox jumps over the lazy dog. you idiot", "en"),
    (3, "", "en"),
    (4, None, None),
    (5, " \t\n ", "en"),
    (6, LONG, "en"),
    (7, LONG + " end", "en"),
    (8, "héllo wörld — ünïcode 😀 text with spaces", "fr"),
    (9, "x", "en"),
    (10, f"start {SHARED} finish", "en"),
    (11, f"another begin {SHARED} different end", None),
    (None, "a row without an id", "en"),
    (None, None, None),
    (12, "don't I'll <|endoftext|> we've   \n\n  done  ", "en"),
    (13, "zzz " * 120, "de"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, "s", None, 0.5, "w", "k", 1) for i, t, lang in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
