"""Mixing, language ID and the pipeline."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lakeprobe.llm import bpe, jaccard_join, langid, mixing, toxicity
from lakeprobe.llm.common import documents, table
from tests.llm.cases import ROWS, empty, frame


def expected(rows, size):
    out = np.zeros(size)
    for r in rows:
        out += np.array(r["p"]) * r["tokens"] * r["rate"]
    return out


def test_rates_meet_the_targets(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    out, domains = mixing.rates(docs, mixing.labelled_domains(docs, labels))
    rows = out.collect()
    have = expected([r.asDict() | {"rate": 1.0} for r in rows], len(domains))
    assert expected(rows, len(domains)) == pytest.approx(mixing.default_targets(have), rel=1e-3)
    assert domains == ["de", "en", "es", "fr"] and min(r["rate"] for r in rows) >= 0.999


def test_rates_fall_to_zero_for_a_domain_without_a_target(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    wanted = {"en": 20_000.0, "de": 20_000.0, "fr": 20_000.0}
    out, domains = mixing.rates(docs, mixing.labelled_domains(docs, labels), wanted)
    rows = out.collect()
    got = dict(zip(domains, expected(rows, len(domains)), strict=True))
    assert all(got[d] == pytest.approx(wanted.get(d, 0.0), abs=600) for d in domains)
    assert min(r["rate"] for r in rows) == 0


def test_gradient_steps_match_a_plain_loop(spark):
    rows = spark.createDataFrame([(10, [0.9, 0.1]), (20, [0.5, 0.5]), (5, [0.0, 1.0]), (0, [0.5, 0.5])], "tokens long, p array<double>")
    t, p = np.array([10, 20, 5, 0.0]), np.array([[0.9, 0.1], [0.5, 0.5], [0, 1], [0.5, 0.5]])
    target, rate = np.array([3.0, 40.0]), np.ones(4)
    have = p.T @ t
    for _ in range(mixing.STEPS):
        residual = (p * t[:, None]).T @ rate - target
        if np.abs(residual / have).max() <= mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - p @ (residual / have))
    got, left = mixing.solve(rows, 2, target)
    by = {r["tokens"]: r["rate"] for r in got.collect()}
    assert [by[x] for x in (10, 20, 5, 0)] == pytest.approx(rate.tolist(), abs=1e-9) and left <= mixing.ENOUGH


def test_rates_have_a_bound_and_what_is_missed_is_told(spark, caplog):
    rows = spark.createDataFrame([(10, [0.9, 0.1]), (20, [0.5, 0.5])], "tokens long, p array<double>")
    got, left = mixing.solve(rows, 2, np.array([200.0, 200.0]), most=3.0)
    assert [r["rate"] for r in got.collect()] == [3.0, 3.0] and left > 1 and "missed" in caplog.text


def test_posteriors_are_those_of_the_plain_classifier(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    counts = defaultdict(Counter)
    for i in good & rows.keys():
        data = b" " + (rows[i]["text"] or "").lower().encode() + b" "
        counts[rows[i]["lang"]].update(int(((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 18) for k in range(len(data) - 2))
    langs = sorted(counts)
    logs = {x: {b: np.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * (1 << 14))) for b in range(1 << 14)} for x in langs}
    got = {r["doc_id"]: r for r in mixing.rates(docs, mixing.labelled_domains(docs, labels))[0].collect()}
    for i, r in rows.items():
        data = b" " + (r["text"] or "").lower().encode() + b" "
        at = [int(((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 18) for k in range(len(data) - 2)] if r["text"] else []
        e = np.array([sum(logs[x][b] for b in at) for x in langs]) * (120 / (len(at) + 120))
        p = np.exp(e - e.max())
        assert got[i]["p"] == pytest.approx((p / p.sum()).tolist(), abs=1e-3)
        assert got[i]["tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


def test_mixed_repeats_rows(spark, sf):
    docs = documents(spark, sf)
    domains = mixing.labelled_domains(docs, table(spark, sf, "labels"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.rates(docs, domains)[0].collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed(docs, domains, least=1).collect())
    assert got == Counter({i: max(1, c) for i, c in copies.items()})
    some = mixing.mixed(frame(spark), domains)
    assert some.columns == frame(spark).columns


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.query(spark, frame(spark), none).collect()
    assert len(got) == len(ROWS) and {r["rate"] for r in got} == {1.0}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["tokens"]) for r in got) == Counter((i, words(t)) for i, t, _ in ROWS)


def test_clashing_names_are_carried_along(spark):
    from lakeprobe.llm import exact_dedup

    odd = frame(spark).selectExpr("*", "'x' AS __text", "'y' AS __n", "'z' AS __digest", "'k' AS __key", "'i' AS id", "'t' AS t", "1 AS doc", "2 AS c0")
    none = spark.createDataFrame([], "doc_id long, label string")
    few = spark.createDataFrame([(1, 1), *((i, 0) for i in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13))], "doc_id long, toxic int")
    for out in (mixing.mixed(odd, none), exact_dedup.dedup(odd), jaccard_join.first_of_each(odd), toxicity.accepted(odd, few)):
        assert out.columns == odd.columns
        assert {(r["__text"], r["__n"], r["__digest"], r["__key"], r["id"], r["t"], r["doc"], r["c0"]) for r in out.collect()} == {("x", "y", "z", "k", "i", "t", 1, 2)}
    assert mixing.query(spark, empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_language_of_documents_and_pages(spark):
    d = "/root/testdata/sf0.01"
    docs, pages = documents(spark, d), table(spark, d, "pages")
    got = langid.query(spark, pages, docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    of_docs = {r["doc_id"]: r["lang"] for r in got if r["kind"] == "document"}
    assert of_docs.keys() == lang.keys() and sum(of_docs[i] == x for i, x in lang.items()) > 0.96 * len(lang)
    of_pages = {r["page_id"]: r["lang"] for r in got if r["kind"] == "page"}
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    said = {i: m[1] for i, h in html.items() if (m := re.search(r'<html lang="(\w+)"', h))}
    assert sum(of_pages[i] == x for i, x in said.items()) > 0.97 * len(said)


def test_languages_of_documents_that_the_model_has_not_seen(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    seen, unseen = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    got = {r["id"]: r["lang"] for r in langid.identify(langid.records(None, unseen), langid.fit(seen)).collect()}
    lang = {r["doc_id"]: r["lang"] for r in unseen.collect()}
    assert got.keys() == lang.keys() and sum(got[i] == x for i, x in lang.items()) > 0.95 * len(lang)


def test_fusion_against_a_plain_computation(spark, sf):
    """All pages of the smallest tables, from the text likelihoods on."""
    docs, pages = documents(spark, sf), table(spark, sf, "pages")
    model = langid.fit(docs)
    n = len(model.labels)
    soft = lambda v: np.exp(np.array(v) - max(v)) / np.exp(np.array(v) - max(v)).sum()
    rows = [r.asDict() for r in langid.records(pages, None).collect()]
    for r in rows:
        r["ll"] = model.likelihoods(langid.visible(r["text"]))
        r["s"] = soft(r["ll"])
        r["said"] = None if r["declared"] is None else r["declared"] if r["declared"] in model.labels else "other"
    total = lambda some: sum((r["s"] for r in some), np.zeros(n))
    everywhere = (total(rows) + 1) / (len(rows) + n)
    group = lambda key: {k: [r for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    wide = lambda some, prior: (total(some) + langid.WEIGHT * prior) / (len(some) + langid.WEIGHT)
    suffix = {k: wide(g, everywhere) for k, g in group(lambda r: r["suffix"]).items()}
    domain = {k: wide(g, suffix[k[1]]) for k, g in group(lambda r: (r["domain"], r["suffix"])).items()}
    hosts = group(lambda r: r["host"])
    said = {k: total(g) for k, g in group(lambda r: r["said"]).items() if k is not None}
    told = sum(said.values(), np.zeros(n))
    got = {r["id"]: r for r in langid.identify(langid.records(pages, None), model).collect()}
    for r in rows:
        own = hosts[r["host"]]
        prior = (np.maximum(total(own) - r["s"], 0) + langid.WEIGHT * domain[r["domain"], r["suffix"]]) / (len(own) - 1 + langid.WEIGHT)
        says = (said[r["said"]] + langid.WEIGHT / (n + 1)) / (told + langid.WEIGHT) if r["said"] else np.ones(n)
        p = soft(r["ll"] + np.log(prior) + np.log(says))
        assert got[r["id"]]["probability"] == pytest.approx(p.max(), abs=2e-6) and got[r["id"]]["lang"] == model.labels[int(p.argmax())]


def test_declarations_and_domains(spark):
    rows = [("http://a.b.co.uk/", '<html class="x" lang="DE-at">'), ("http://10.0.0.7/", '<meta http-equiv="Content-Language" content="fr">'), ("http://x.example.org/", "<html xml:lang='es'><body>"), ("http://x/", "<p lang='en'>")]
    got = langid.records(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string"), None).orderBy("id").collect()
    assert [(r["declared"], r["domain"]) for r in got] == [("de", "b.co.uk"), ("fr", "10.0.0.7"), ("es", "example.org"), (None, "")]


def test_evidence_is_combined(spark, sf):
    docs = documents(spark, sf)
    model = langid.fit(docs)
    rows = [("https://a.example.com/1", '<html lang="de"><body>x</body></html>')] * 40 + [("https://a.example.com/2", "<p> </p>"), (None, None), ("https://b.example.org/", '<html lang="xx">')]
    german = docs.filter("lang = 'de'").limit(30).select("text").collect()
    rows += [("https://a.example.com/d", f'<html lang="de"><p>{r["text"]}</p></html>') for r in german]
    pages = spark.createDataFrame([(i, u, h, 3) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host int")
    got = {r["id"]: r for r in langid.identify(langid.records(pages, None), model).collect()}
    assert got[40]["lang"] == "de" and got[0]["lang"] == "de" and got[0]["probability"] > got[40]["probability"]
    assert len(got) == len(rows) and got[42]["declared"] == "other"


def test_langid_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.query(spark, none, empty(spark)).collect() == []
    got = langid.query(spark, none, frame(spark)).collect()
    assert len(got) == len(ROWS)


def test_hosts_without_a_dot_give_one_row_each(spark, sf):
    urls = [None, None, "/relative", "http://localhost/a", "http://localhost/b", "http://intranet/", "http://[::1]/", "http://example.com./", "https://a.example.com/"]
    pages = spark.createDataFrame([(i, u, "<p>the quick brown fox</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = langid.query(spark, pages, documents(spark, sf)).filter("kind = 'page'").collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(urls)))


def test_pipeline_against_its_parts_on_the_driver(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rejected = {r["doc_id"] for r in toxicity.query(spark, docs, labels).filter("predicted = 1").collect()}
    stay = {i: t for i, t in text.items() if i not in rejected}
    first: dict = {}
    for i in sorted(stay):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", stay[i]), i)
    stay = {i: stay[i] for i in first.values()}
    shingles = {}
    for i, t in stay.items():
        w = jaccard_join.WORD.findall(t)
        shingles[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in stay}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(stay)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            a, b = shingles[x], shingles[y]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                u, v = find(x), find(y)
                root[max(u, v)] = min(u, v)
    stay = {i for i in stay if find(i) == i}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    seen = defaultdict(set)
    for r in corpus_pipeline.run(spark, sf).collect():
        seen[r["doc_id"]].add(tuple(r["ids"]))
    assert set(seen) == stay
    assert all(x == {tuple(t.encode(text[i], add_special_tokens=False).ids)} for i, x in seen.items())


def test_stages_keep_the_columns(spark, sf):
    docs = documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents(spark, sf).columns


def test_pipeline_on_nulls_repeats_and_an_empty_table(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("cases", frame(spark)), ("empty", empty(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "cases")).collect()
    assert {r["doc_id"] for r in got} <= {i for i, _, _ in ROWS} and {1, 6, 8, 9, 10, 12, 13} <= {r["doc_id"] for r in got} and 7 not in {r["doc_id"] for r in got}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
