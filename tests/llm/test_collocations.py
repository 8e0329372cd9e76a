"""Phrase mining against plain counting, with and without broadcasts, and its defined results."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from lakeprobe.llm import collocations
from tests.llm.cases import ROWS, empty, frame


def plain(rows, words, least, first):
    """The contract, word by word."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    covers = {}
    for (lang, longer), v in often.items():
        for k in range(2, len(longer)):
            for i in range(len(longer) - k + 1):
                part = (lang, longer[i : i + k])
                covers[part] = max(covers.get(part, 0), v)
    out = []
    for (lang, phrase), a in often.items():
        if 100 * covers.get((lang, phrase), 0) >= 80 * a:
            continue
        cuts = [(2000000 * a // (f[lang, phrase[:k]] + f[lang, phrase[k:]]), k, f[lang, phrase[:k]], f[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(phrase), a, left, right, n[lang], score))
    found = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:first]
        found += [(x[0], i, *x[1:]) for i, x in enumerate(best, 1)]
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("bound", [10**6, 0])
def test_phrases_equal_plain_counts(spark, bound):
    some = random.Random(3)
    rows = []
    for _ in range(60):
        words = [some.choice(["The", "the", "of", "a", "é", "x y", "ok", "zz"]) for _ in range(some.randint(0, 90))]
        rows.append((" ".join(w + some.choice(["", "", "", ",", ".", "\t", "\n", "  "]) for w in words), some.choice(["en", "de", None, ""])))
    rows += [("a a a a a a", "en"), (None, "en"), ("", None), (". , ;", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(collocations.collocations(docs, least=5, first=40, bound=bound)) == plain(rows, 4, 5, 40)
    assert rows_of(collocations.collocations(docs, words=2, least=9, bound=bound)) == plain(rows, 2, 9, 2000)


def test_cases_have_a_result(spark):
    rows = [(t, lang) for _, t, lang in ROWS]
    assert rows_of(collocations.query(spark, frame(spark))) == plain(rows, 4, 30, 2000)
    assert rows_of(collocations.query(spark, empty(spark))) == []
    assert rows_of(collocations.query(spark, frame(spark, [(1, "no phrase here", "en")]))) == []


def test_one_phrase_in_half_of_the_rows(spark):
    rows = [("over and over again" if i % 2 else f"w{i} v{i % 7} of", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    for bound in (10**6, 0):
        assert rows_of(collocations.collocations(docs, bound=bound)) == plain(rows, 4, 30, 2000)


def test_query_equals_sql(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.SQL})").fetchall())
    assert rows_of(collocations.query(spark, documents)) == want
