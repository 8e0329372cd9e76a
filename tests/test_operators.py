"""Operators on small tables with known results."""

from __future__ import annotations

import math
import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lakeprobe.functions import cells, dom, json_ops, net, page, text, urls
from lakeprobe.operators import catalog, crawl, drift, ordering, paging, profile, rename, report, security
from lakeprobe.sources import files, tabular
from lakeprobe.streaming import jobs

ROOT = pathlib.Path(__file__).resolve().parents[1]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("1 234,5", 1234.5), ("-7", -7.0), ("1e3", 1000.0), ("1,234.5", None), ("1_000", None), ("0x1", None), ("abc", None), ("1e999", None), ("", None)])
def test_numbers(spark, raw, want):
    assert one(spark, cells.number(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("2024-03-04", "2024-03-04"), ("4.3.2024", "2024-03-04"), ("03/04/2024", "2024-04-03"), ("03/25/2024", "2024-03-25"), ("2024-02-31", None), ("soon", None), ("31.12.2026 10:00", "2026-12-31"), ("2024-01-15T23:00:00-03:00", "2024-01-16"), ("2024-01-15T10:00:00Z", "2024-01-15")])
def test_dates(spark, raw, want):
    assert one(spark, F.date_format(cells.date(F.lit(raw)), "yyyy-MM-dd")) == want


@pytest.mark.parametrize(("raw", "want"), [("да", True), (" Yes ", True), ("ложь", False), ("maybe", None)])
def test_booleans(spark, raw, want):
    assert one(spark, cells.boolean(F.lit(raw))) is want


def test_missing_tokens_and_kinds(spark):
    assert one(spark, cells.normalize(F.lit(" N/A "))) is None and one(spark, cells.normalize(F.lit("—"))) == "—"
    kinds = [one(spark, cells.kind(F.lit(x))) for x in ("12", "1.5", "true", "2024-01-01", "word")]
    assert kinds == ["integer", "float", "boolean", "datetime", "string"]


def test_chi_square_tail_at_critical_values(spark):
    for chi2, df, p in ((3.841, 1, 0.05), (5.991, 2, 0.05), (11.070, 5, 0.05), (6.635, 1, 0.01), (9.210, 2, 0.01)):
        assert one(spark, drift.chi_square_tail(F.lit(chi2), F.lit(df))) == pytest.approx(p, abs=5e-4)
    assert one(spark, drift.chi_square_tail(F.lit(0.0), F.lit(3))) == 1


@pytest.mark.parametrize(("chi2", "df", "p"), [(2000.0, 1, 0.0), (2132.9, 3, 0.0), (1500.0, 900, 6.9e-33), (900.0, 900, 0.4937), (40.0, 30, 0.10486428), (500.0, 499, 0.4784)])
def test_chi_square_tail_far_out(spark, chi2, df, p):
    got = one(spark, drift.chi_square_tail(F.lit(chi2), F.lit(df)))
    assert got == pytest.approx(p, rel=2e-2, abs=1e-30)


def test_statistics(spark):
    v = spark.createDataFrame([("x", float(i)) for i in (2, 4, 4, 4, 5, 5, 7, 9)], "column string, value double")
    s = profile.numeric(v).first()
    assert s["std"] == pytest.approx(2.13809, abs=1e-5) and s["p50"] == 4.5 and s["n"] == 8
    rows = spark.createDataFrame([("c", 1, 0), ("c", 0, 1)], "column string, ref long, cur long")
    d = drift.divergence(rows).first()
    assert d["jsd"] == pytest.approx(1) and d["tvd"] == pytest.approx(1)


def test_same_data_has_no_findings(spark):
    rows = [(s, "x", float(i % 97)) for i in range(500) for s in ("reference", "current")]
    v = spark.createDataFrame(rows, "side string, column string, value double")
    m = drift.numeric_metrics(v, profile.numeric(v, "side"))
    assert drift.numeric_findings(m).collect() == []
    assert m.first()["ks"] == 0 and m.first()["psi"] == pytest.approx(0)


def test_ks_and_shift(spark):
    v = spark.createDataFrame([("reference" if i < 300 else "current", "x", float(i)) for i in range(600)], "side string, column string, value double")
    assert drift.ks(v).first()["ks"] == 1
    found = {r["code"]: r["severity"] for r in drift.numeric_findings(drift.numeric_metrics(v, profile.numeric(v, "side"))).collect()}
    assert found["distribution.psi"] == found["distribution.ks"] == found["distribution.mean_shift"] == "alert"


def test_roles(spark):
    rows = [("id", str(10_000 + i)) for i in range(100)] + [("flag", str(i % 2)) for i in range(100)] + [("town", ("A", "B", "C")[i % 3]) for i in range(100)] + [("none", "N/A")]
    v = spark.createDataFrame(rows, "column string, raw string").select("column", cells.normalize(F.col("raw")).alias("value"))
    roles = {r["column"]: r["role"] for r in profile.classify(profile.features(v)).collect()}
    assert roles == {"id": "identifier", "flag": "boolean", "town": "categorical", "none": "empty"}


def test_transforms(spark):
    assert one(spark, text.number(F.lit("Цена: 1 990,50 ₽"))) == "1990.50"
    assert one(spark, text.number(F.lit("$1,234.50"))) == "1234.50"
    assert one(spark, text.regex(F.lit("SKU-ABC-123"), r"(\d+)", 1)) == "123"
    assert one(spark, text.date(F.lit("Дата 31.12.2026 в 10:00"))) == "2026-12-31"
    assert one(spark, text.date(F.lit(" v 1.2.2024 "))) == "v 1.2.2024" and one(spark, text.date(F.lit("x123.04.20245"))) == "x123.04.20245"
    assert one(spark, text.unescape(text.reversible_escape(F.lit("a\\u0041 é 😀\n")))) == "a\\u0041 é 😀\n"
    assert [x["form"] for x in one(spark, text.forms(F.lit("é")))] == list(text.FORMS)


@pytest.mark.parametrize("bad", ["a​b", "a b", "é", "a‮b", "a­b", "a�b", "a\u0007b"])
def test_unicode_status_and_cleaning(spark, bad):
    assert one(spark, text.status(F.lit(bad))) != "ok"
    once = one(spark, text.nfc(text.spaced(F.lit(bad))))
    assert one(spark, text.nfc(text.spaced(F.lit(once)))) == once


def test_rename_order_matters(spark):
    df = spark.createDataFrame([(1, "cat.png")], "id long, name string")
    number, prefix = rename.Rule("numbering", "_", width=2), rename.Rule("prefix", "img_")
    assert rename.renamed(df, [prefix, number]).first()["new_name"] == "01_img_cat.png"
    assert rename.renamed(df, [number, prefix]).first()["new_name"] == "img_01_cat.png"
    assert rename.renamed(df, [rename.Rule("regex", "(")]).first()["new_name"] == "cat.png"
    assert [i for i, _ in rename.faults([rename.Rule("lower"), rename.Rule("regex", "(")])] == [1]
    assert one(spark, rename.problems(F.lit("   "))) == ["empty"]


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"))
    got = ordering.numbered(df, "k", "n").collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["n"])] == sorted(r["k"] for r in got) and {r["n"] for r in got} == set(range(1000))


def test_quantiles_are_those_of_percentile(spark):
    v = spark.range(700).select(F.lit("x").alias("column"), (F.col("id") * 37 % 101 / 7).alias("value"))
    want = v.agg(F.percentile("value", F.lit(list(profile.QUANTILES.values())))).first()[0]
    got = profile.quantiles(v).first()
    assert [got[q] for q in profile.QUANTILES] == pytest.approx(want)


def test_page_reading():
    html = '<html lang="ru"><head><title>T &amp; t</title><meta name="Description" content="d"><link rel="canonical" href="/c"><script type="application/ld+json">{"a":1}</script></head><body><h1>Head</h1><p>one <b>two<p>three<a href="/x">link</a><a href="http://o.example/">out</a><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><form action="/s" method="POST"><input name="q"></form><img src="i.png"></body></html>'
    p = page.read("https://h.example/p", html)
    assert p["title"] == "T & t" and p["lang"] == "ru" and p["canonical"] == "https://h.example/c" and p["jsonld"] == ['{"a":1}'] and p["metas"] == {"description": "d"}
    assert [(x["href"], x["internal"]) for x in p["links"]] == [("https://h.example/x", True), ("http://o.example/", False)]
    assert p["tables"] == [{"header": ["a", "b"], "rows": [["1", ""]]}] and p["forms"][0]["fields"] == ["q"] and p["headings"] == [{"level": 1, "text": "Head"}]
    assert page.read("", "<<<")["words"] >= 0


def test_selectors():
    root = dom.tree('<ul id="u"><li class="a b"><a href="/1">x</a></li><li><span data-k="v1">y</span></li></ul>')
    pick = lambda s: [n.text() for n in dom.select(root, dom.compile_selector(s))]
    assert pick("ul > li.a") == ["x"] and pick("#u a[href^='/']") == ["x"] and pick("[data-k$=1], a") == ["x", "y"] and pick("ul > a") == []
    for bad in ("li:nth-child(2)", "a + b", ">"):
        with pytest.raises(ValueError, match="unsupported"):
            dom.compile_selector(bad)


def test_urls(spark):
    assert one(spark, urls.normalize(F.lit("HTTP://Ex.Example:8080?q=1#f"))) == "http://ex.example:8080/?q=1"
    assert one(spark, urls.mask(F.lit("https://u:p@h.example/?token=abc&x=1"))) == "https://***@h.example/?token=***&x=1"
    assert one(spark, urls.next_page(F.lit("https://h.example/?offset=20&limit=10"))) == "https://h.example/?offset=30&limit=10"
    assert one(spark, urls.is_safe(F.lit("http://10.0.0.1/"))) is False
    for key in ("refresh_token", "client_secret", "passwd", "pwd", "x-api-key"):
        assert one(spark, urls.mask(F.lit(f"https://h.example/?a=1&{key}=s3cr3t&b=2#f"))) == f"https://h.example/?a=1&{key}=***&b=2#f"
    assert one(spark, urls.resolve(F.lit("https://h.example/a/b/c?q#f"), F.lit("../d"))) == "https://h.example/a/d"
    assert one(spark, urls.http_form(F.lit("HTTP://Bücher.example/ä b?q=%20é#x"))) == "http://xn--bcher-kva.example/%C3%A4%20b?q=%20%C3%A9"
    assert one(spark, urls.secret_params(F.create_map(F.lit("Auth_Token"), F.lit("1"), F.lit("page"), F.lit("2")))) == ["Auth_Token"]


def test_crawl_depths(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 3), (3, 4)], "src long, dst long")
    assert {r["node"]: r["depth"] for r in crawl.bfs(edges, 0, 2).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_crawl_plans_do_not_grow(spark):
    edges = spark.range(64).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    size = lambda n: len(crawl.bfs(edges, 0, n)._jdf.queryExecution().analyzed().toString())
    assert size(6) < 4 * size(2)


def test_security_rules(spark):
    df = spark.createDataFrame([(1, "s", "http://x/", "", [], {"Server": "a/1"})], "page_id long, site string, url string, html string, cookies array<string>, headers map<string,string>")
    got = [r["finding"] for r in security.findings(df).collect()]
    assert {"no_https", "server_version", "missing_csp"} <= set(got) and "cookie_no_secure" not in got and "missing_hsts" not in got and got[0] == "no_https"
    assert spark.createDataFrame([(None,)], "c array<string>").select(security.page_findings(F.create_map().cast("map<string,string>"), F.col("c"), F.lit("https://x/"), F.lit(None).cast("string"))).count() == 1


def test_every_rule_has_a_severity():
    assert len(security.SEVERITY) == 61 and set(security.SEVERITY.values()) == set(security.ORDER)


def test_addresses_inputs_and_robots(spark):
    assert [one(spark, net.ip_class(F.lit(a))) for a in ("127.0.0.1", "::1", "::ffff:10.0.0.1", "8.8.8.8", "198.18.0.1", "fe80::1%eth0", "x")] == ["loopback", "loopback", "private", "global", "private", "private", "invalid"]
    assert one(spark, net.source_kind(F.lit("application/json"), F.lit("a,b\n1,2"))) == "csv"
    rules = net.robots_rules(spark.createDataFrame([("h", "User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y\nUser-agent: b\nDisallow: /")], "host string, text string"))
    assert {(r["prefix"], r["allow"]) for r in rules.collect()} == {("/x", False), ("/x/y", True)}
    import gzip

    packed = spark.createDataFrame([(bytearray(gzip.compress(b"abc")), "gzip"), (bytearray(b"plain"), "gzip"), (bytearray(b"raw"), None)], "b binary, e string")
    assert [bytes(r[0]) for r in packed.select(net.inflated(F.col("b"), F.col("e"))).collect()] == [b"abc", b"plain", b"raw"]


def test_next_page_sources(spark):
    url, none = F.lit("https://h.example/a/b?page=2"), F.lit(None).cast("string")
    kinds = [one(spark, urls.next_link(url, F.lit(h) if h else none, F.lit(b), F.lit(k)))["kind"] for h, b, k in (('<x?p=3>; rel="next"', "", "html"), (None, '{"next": "/n"}', "json"), (None, '<a rel="next" href="n">', "html"), (None, "{}", "json"))]
    assert kinds == ["link_header", "json_next", "rel_next", "query_page"]


def test_paging_audit(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 9), (3, 3)], "page long, item long")
    assert {r["problem"]: r["n"] for r in paging.audit(pages, spark.range(5).withColumnRenamed("id", "item")).collect()} == {"repeated": 1, "lost": 2, "foreign": 1, "short": 0}


def test_catalog_relevance(spark):
    df = spark.createDataFrame([(1, "weather", "w", None, None, None), (2, "b", "weather", "weather", None, None)], "id long, name string, category string, description string, why_useful string, ideas string")
    assert [(r["id"], r["score"]) for r in catalog.search(df, " Weather ", 5).collect()] == [(2, 7), (1, 5)]


def text_values(spark, side, rows):
    return spark.createDataFrame([(side, c, v) for c, values in rows.items() for v in values], "side string, column string, value string")


def test_every_finding_of_the_report(spark):
    """Planted columns give exactly the findings they should."""
    n = 400
    ref = {
        "id": [f"k{i}" for i in range(n)], "num": [str(i % 97) for i in range(n)], "cat": ["ab"[i % 2] for i in range(n)], "day": [f"2020-01-{i % 28 + 1:02d}" for i in range(n)], "gone": ["x"] * n, "typed": [str(i % 9) for i in range(n)],
        "const": ["one"] * n, "vary": ["pq"[i % 2] for i in range(n)], "void": ["v"] * n, "holes": ["h"] * n, "mix": [f"w{i % 5}" for i in range(n)],
    }
    cur = ref | {
        "id": [f"k{i + n // 2}" for i in range(n)], "num": [str(i % 97 + 60 - 70 * (i % 20 == 0)) for i in range(n)], "cat": ["bcd"[i % 3] for i in range(n)], "day": [f"2021-01-{i % 28 + 1:02d}" for i in range(n)], "typed": [f"t{i % 9}" for i in range(n)],
        "const": ["one" if i % 2 else "two" for i in range(n)], "vary": ["p"] * n, "void": [None] * n, "holes": [None if i % 10 == 0 else "h" for i in range(n)], "mix": [f"w{i % 5}" if i % 5 else "17" for i in range(n)], "new": ["n"] * n,
    }
    cur.pop("gone")
    values = text_values(spark, "reference", ref).unionByName(text_values(spark, "current", cur))
    schema = spark.createDataFrame([(c, c in ref, c in cur) for c in sorted({*ref, *cur})], "column string, in_ref boolean, in_cur boolean")
    found, columns = drift.compare(values, schema)
    got = {(r["column"], r["code"]) for r in found.collect()}
    assert {
        ("new", "schema.column_added"), ("gone", "schema.column_removed"), ("typed", "schema.type_changed"), ("const", "quality.no_longer_constant"), ("vary", "quality.became_constant"), ("void", "quality.became_empty"), ("holes", "missing.appeared"),
        ("mix", "quality.mixed_types"), ("id", "leakage.identifier_overlap"), ("day", "datetime.disjoint_period"), ("num", "distribution.psi"), ("num", "distribution.ks"), ("num", "distribution.negatives_appeared"), ("num", "distribution.range_expanded"),
        ("cat", "category.psi"), ("cat", "category.new"), ("cat", "category.disappeared"), ("cat", "category.chi_square"), ("cat", "cardinality.change"),
    } <= got
    assert "[alert] void: quality.became_empty" in report.render(found, columns)
    same, _ = drift.compare(text_values(spark, "reference", ref).unionByName(text_values(spark, "current", ref)), schema.filter("in_ref").withColumn("in_cur", F.lit(True)))
    assert {r["code"] for r in same.collect()} == {"leakage.identifier_overlap"}


def test_new_categories_of_any_rank(spark):
    rows = [("reference", "c", f"v{i:03d}") for i in range(80) for _ in range(3)] + [("current", "c", f"v{i:03d}") for i in range(80) for _ in range(3)] + [("current", "c", "zz")]
    counts = drift.counted(spark.createDataFrame(rows, "side string, column string, value string"))
    assert [(r["value"], r["change"]) for r in drift.one_sided(counts).collect()] == [("zz", "new")]
    assert drift.categories(counts).filter("category = '__other__'").first()["ref"] == 90


def test_json_shapes(spark):
    got = [one(spark, json_ops.shape(F.lit(x))) for x in ('{"a":1}', "[1]", "3", "{oops")]
    assert got == ["object", "array", "scalar", "invalid"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name;name;\n1;x;y;\n2;N/A\n", encoding="utf-8")
    df = tabular.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "name__1", "column_4"] and [tuple(r) for r in df.collect()] == [("1", "x", "y", None), ("2", None, None, None)]
    (tmp_path / "b.json").write_text('{"items": [{"a": 1, "b": {"c": 2}}, {"a": null}]}')
    assert [tuple(r) for r in tabular.read_table(spark, str(tmp_path / "b.json")).collect()] == [("1", '{"c":"2"}'), (None, None)]
    (tmp_path / "c.ndjson").write_text('{"a": true}\n{"a": "x", "z": 1}\n')
    assert sorted(tabular.read_table(spark, str(tmp_path / "c.ndjson")).columns) == ["a", "z"]
    (tmp_path / "d.csv").write_text("\n \n")
    with pytest.raises(ValueError, match="empty"):
        tabular.read_table(spark, str(tmp_path / "d.csv"))
    (tmp_path / "e.csv").write_bytes("имя,x\n\"а\nб, в\",1\n".encode("cp1251"))
    loaded = tabular.load_table(spark, str(tmp_path / "e.csv"), max_columns=1)
    assert loaded.encoding == "windows-1251" and loaded.dropped_columns == ["x"] and [r[0] for r in loaded.df.collect()] == ["а\nб, в"]
    assert tabular.load_table(spark, str(tmp_path / "a.csv"), max_rows=1).truncated and not tabular.load_table(spark, str(tmp_path / "a.csv"), max_rows=2).truncated
    with pytest.raises(ValueError, match="allowed"):
        tabular.load_table(spark, str(tmp_path / "a.csv"), max_bytes=3)
    (tmp_path / "f.ndjson").write_text('{"z": 1, "a": 2}\n\n[1]\n')
    with pytest.raises(ValueError, match="line 3"):
        tabular.read_table(spark, str(tmp_path / "f.ndjson"))
    (tmp_path / "g.json").write_text('[{"z": 1, "a": 2}, {"b": 3}]')
    assert tabular.read_table(spark, str(tmp_path / "g.json")).columns == ["z", "a", "b"]
    (tmp_path / "h.json").write_text("[1, 2]")
    with pytest.raises(ValueError, match="no object"):
        tabular.read_table(spark, str(tmp_path / "h.json"))
    assert tabular.dedupe(["a", " ", "a", "a"]) == ["a", "column_2", "a__1", "a__2"] and tabular.sniff(['"a;b;c",x', '"d;e;f",y']) == ","
    tabular.write_table(df, str(tmp_path / "json"), "json")
    tabular.write_table(df, str(tmp_path / "out"), "tsv")
    assert tabular.sniff(["a\tb", "1\t2"]) == "\t"
    (tmp_path / "p.bin").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    assert [(r["format"], r["size"]) for r in files.read(spark, str(tmp_path / "p.bin")).collect()] == [("png", 9)]


def test_report_store(spark, tmp_path):
    found = spark.createDataFrame([("x", "distribution.psi", "alert")], "column string, code string, severity string")
    metrics = spark.createDataFrame([("x", 0.4)], "column string, psi double")
    assert "[alert] x: distribution.psi" in report.render(found, metrics)
    ids = {report.save(found, str(tmp_path / "store"), t) for t in ("a", "b")}
    assert {r["report"] for r in report.listing(spark, str(tmp_path / "store")).collect()} == ids
    gone = report.evict(spark, str(tmp_path / "store"), limit=1)
    assert len(gone) == 1 and {r["report"] for r in report.listing(spark, str(tmp_path / "store")).collect()} == ids - set(gone)


def test_jobs_stop_at_limits_and_go_on(spark, sf, tmp_path):
    for i in range(5):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"t.parquet/{i}"))
    rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t.parquet/*"))
    ended, so_far, cursor, n, error = jobs.steps(rows, "job", max_steps=2)
    assert ended == jobs.LIMIT and n == 20 and so_far.count() == 20
    ended, so_far, _, _, error = jobs.steps(rows, "job", cursor=cursor)
    assert ended == jobs.DONE and sorted(r["id"] for r in so_far.collect()) == list(range(50))


def test_kolmogorov_series(spark):
    x = 0.8
    want = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))
    n = 1e12
    assert one(spark, drift.ks_tail(F.lit(x / math.sqrt(n / 2)), F.lit(n), F.lit(n))) == pytest.approx(want, abs=1e-5)


def test_entry_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['lakeprobe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'drift_numeric' in e.queries() and 'op1_ngram_jaccard' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "lakeprobe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lakeprobe.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
