"""Queries over pages against their SQL, on small pages written out here."""

from __future__ import annotations

import duckdb
import pytest

from lakeprobe.functions import page
from lakeprobe.plans import registry

PAGE = '<!DOCTYPE html>\n<html lang="en"><head><title>{0}</title><script>var a = "&amp &amp; x && y";</script></head><body><h1>{0}</h1><p>one {0} two</p></body></html>'
#: Texts whose last reference is cut off, as by a limit on the length of a title.
CUT = ("all of it &amp; more", "cut &amp", "cut &am", "cut &", "&&amp;&amp&amp;", "&lt;b&gt &lt", "&copy &copy; &middot", "&ampx; &unknown; &amplt;", "&#x27 &#x27; &quot", "&amp;lt; &amp;amp")


@pytest.mark.parametrize("name", ["page_headings", "page_parse", "page_text"])
def test_references_without_a_semicolon_are_text(spark, tmp_path, name):
    rows = [(i, f"https://a.example/{i}", PAGE.format(t)) for i, t in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), db.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    every = lambda t: sorted(tuple(map(str, r)) for r in t[columns].itertuples(index=False))
    assert every(got) == every(want)


def test_scripts_are_not_decoded_and_attributes_are():
    got = page.read("https://a.example/", '<script type="application/ld+json">{"a": "&amp; &amp &lt;"}</script><a href="/x?a=1&amp;b=2&copy=3&amp">&#233;&eacute;&eacute</a><img alt="&quot;&quot">')
    assert got["jsonld"] == ['{"a": "&amp; &amp &lt;"}']
    assert got["links"] == [{"href": "https://a.example/x?a=1&b=2&copy=3&amp", "text": "éé&eacute", "internal": True}]
    assert got["images"][0]["alt"] == '"&quot'
