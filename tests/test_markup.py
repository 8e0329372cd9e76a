"""Pages as rows, and what is found in them, on small pages written out here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeprobe.operators import assets, markup, sources

SCHEMA = "page_id long, url string, html string"


def pages(spark, *html):
    return spark.createDataFrame([(i, "https://a.example/x/y", h) for i, h in enumerate(html)], SCHEMA)


def tree(spark, html):
    rows = markup.elements(pages(spark, html)).orderBy("pre").collect()
    name = {r["pre"]: r["tag"] for r in rows}
    return [(r["depth"], r["signature"], name.get(r["parent"]), r["text_len"]) for r in rows]


def test_elements_nest_by_their_tags(spark):
    assert tree(spark, "<div class='b  a'><p>one <b>two</b></p><br>x</div><p>y</p>") == [(1, "div.a.b", None, 9), (2, "p", "div", 7), (3, "b", "p", 3), (2, "br", "div", 0), (1, "p", None, 1)]
    # unclosed elements have nothing inside, end tags without a start are skipped
    assert tree(spark, "<ul><li>a<li>b</li></ul></p><i>c") == [(1, "ul", None, 3), (2, "li", "ul", 0), (2, "li", "ul", 1), (1, "i", None, 0)]
    assert tree(spark, "<!DOCTYPE html><head><title>t</title></head><!-- <p> --><p title='a>b' class=q>&lt;&#233;&#x1F600;&amp;lt;</p><script>'<p>'</script><svg><p></p></svg>") == [(1, "p.q", None, 7)]
    assert tree(spark, "no tags") == tree(spark, None) == tree(spark, "") == [] and tree(spark, "a < b <c") == []


def test_character_references(spark):
    got = spark.createDataFrame([("&amp;lt; &#38;#65; &#x41;&#X42;&#67; &nbsp;&copy; &unknown; &#0; &#1114112; & é",)], "t string").select(markup.unescaped(F.col("t"))).first()[0]
    assert got == "&lt; &#65; ABC  © &unknown; � � & é"


def test_attributes(spark):
    tags = ["<a href=x>", "<a HREF = 'x y' b>", '<a title=" href=no" href="&amp;x">', "<a data-href=no>", "<a href>", "<a>"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t string").orderBy("i").select(markup.attribute(F.col("t"), "href")).collect()]
    assert got == ["x", "x y", "&x", "", "", ""]
    every = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate([*tags, "<p a=1 A=2 b/>"])], "i int, t string").orderBy("i").select(markup.attributes(F.col("t"))).collect()]
    assert every == [{"href": "x"}, {"href": "x y", "b": ""}, {"title": " href=no", "href": "&x"}, {"data-href": "no"}, {"href": ""}, {}, {"a": "1", "b": ""}]


def test_assets_of_a_page(spark):
    html = (
        '<html lang=fr><head><title>A &amp; B</title><link rel=canonical href=/c><link rel="alternate" type="application/atom+xml" href=f title=T><style><a href=no>no</a></style></head><a href="y" rel=me>one <b>two</b></a><a>no</a>'
        "<h2>head <a href='#x'>link</a></h2><form action=go method=POST><input type=text name=q required></form><input name=late><script src=s.js></script><script>var a = '<a href=no>'</script><script type=application/ld+json>{}</script><img src=i.png>"
    )
    rows = assets.assets(pages(spark, html, None, "text")).orderBy("pos").collect()
    assert [(r["kind"], r["url"], r["label"], r["extra"]) for r in rows if r["kind"] != "field"] == [
        ("lang", None, "fr", None), ("title", None, "A & B", None), ("canonical", "https://a.example/c", None, None), ("feed", "https://a.example/x/f", "T", "application/atom+xml"), ("link", "https://a.example/x/y", "one two", "me"),
        ("heading", None, "head link", "h2"), ("link", "https://a.example/x/y#x", "link", None), ("form", "https://a.example/x/go", None, "post"), ("script", None, "var a = '<a href=no>'", None), ("image", "https://a.example/x/i.png", "", None),
    ]
    assert [(r["label"], r["extra"]) for r in rows if r["kind"] == "field"] == [("q", "text"), ("late", "input")]


def test_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = markup.elements(pages(spark, deep, f"<p>{'word ' * 200_000}</p>", "<a " + "b='c' " * 20_000 + ">t</a>", "<a " + "b='c' " * 400 + ">t</a>")).collect()
    assert max(r["depth"] for r in rows if r["page_id"] == 0) == 3000 and {r["text_len"] for r in rows if r["page_id"] == 0} == {1}
    assert {r["page_id"]: r["text_len"] for r in rows if r["page_id"] > 0} == {1: 999_999, 3: 1}  # a tag with too many values is text


CARDS = "<main>{}</main>"
CARD = '<article class="card"{i}><h3>Title {n}</h3><a href="/p/{n}">go</a><img src="i.png" alt="pic"><span class="old-price">5</span></article>'


def test_cards_are_found_with_their_fields(spark):
    html = "<nav><ul><li><a href=/a>a</a></li><li><a href=/b>b</a></li></ul></nav>" + CARDS.format("".join(CARD.format(n=n, i=f' id="c{n}"') for n in range(7)))
    p = pages(spark, html, "<p>a</p><p>b</p>", "<p>a</p><p>b</p><p>cd</p>", None)
    nodes = markup.elements(p).cache()
    groups = sources.repeated(nodes)
    assert [tuple(r) for r in groups.orderBy("page_id", "place").select("page_id", "signature", "members").collect()] == [(0, "article.card", 7), (2, "p", 3)]
    fields = {r["page_id"]: [tuple(f) for f in r["fields"]] for r in sources.proposed_fields(nodes, groups).collect()}
    assert fields == {
        0: [("title", "h3", "text", "normalize_ws"), ("link", "a", "url", "none"), ("image", "img", "image", "none"), ("price", "[class*=price]", "text", "number")],
        2: [("text", "", "text", "normalize_ws")],
    }
    got = sources.recommended(p, nodes).orderBy("page_id", "rank").collect()
    assert [(r["page_id"], r["kind"], r["location"], r["records"], r["stable_ids"], r["confidence"], r["selected"]) for r in got] == [
        (0, "repeated_dom", "article.card", 7, True, "high", True), (2, "repeated_dom", "p", 3, False, "medium", True),
    ]
    entity = sources.entity_groups(nodes)
    rows = sources.items(p, nodes, entity).cache()
    first = rows.filter("page_id = 0 AND item = 3").first()
    assert (first["title"], first["link"], first["image"], first["alt"], first["date"], first["text"]) == ("Title 3", "https://a.example/p/3", "https://a.example/x/i.png", "pic", None, "Title 3 go 5")
    found = sources.entities(nodes, entity, rows).orderBy("page_id").collect()
    assert [(r["page_id"], r["signature"], r["container"], r["items"], r["fields"]) for r in found] == [(0, "article.card", "main", 7, ["alt", "image", "link", "text", "title"]), (2, "p", "#root", 3, ["text"])]
    table = sources.dataset(rows, sources.entities(nodes, entity, rows), ["title"]).filter("page_id = 0").orderBy("item").collect()
    assert [r["value"] for r in table] == [f"Title {n}" for n in range(7)]


def test_groups_have_bounds(spark):
    lists = "".join(f"<ul class=l{k}>" + "".join(f"<li class=i{k}>text {n}</li>" for n in range(3 + k)) + "</ul>" for k in range(7))
    nodes = markup.elements(pages(spark, lists, "<div>" * 41 + "<p>a</p><p>b</p><p>c</p>" + "</div>" * 41, "<ul>" + "<li>x</li>" * 300 + "</ul>")).cache()
    got = sources.repeated(nodes).orderBy("page_id", "place").collect()
    assert [(r["page_id"], r["signature"], r["members"]) for r in got] == [(0, f"li.i{k}", 3 + k) for k in (6, 5, 4, 3, 2)] + [(2, "li", 300)]
    p = pages(spark, None, None, "<ul>" + "<li>x</li>" * 300 + "</ul>")
    assert sources.items(p, nodes.filter("page_id = 2"), sources.entity_groups(nodes.filter("page_id = 2"))).count() == 200


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<script>{"a": [1, 2], "b": {"c": [{"x": 1}, 5, {"y": [{"z": 1}, {"z": 2}, {"z": 3}]}]}}</script>', [("embedded_json", 0, '{"z":1}'), ("embedded_json", 1, '{"z":2}'), ("embedded_json", 2, '{"z":3}')]),
        ('<script>{"a": [{"n": 1}], "b": [{"n": 2}]}</script><script>[{"m": 1}]</script>', [("embedded_json", 0, '{"n":1}')]),
        ('<script type="application/ld+json">{"@type": "A"}</script><script type=application/ld+json>[{"@id": 1}, {"@id": 2}]</script>', [("json_ld", 0, '{"@type":"A"}'), ("json_ld", 1, '{"@id":1}'), ("json_ld", 2, '{"@id":2}')]),
        ("<script>{broken</script><script>var x = {}</script><script>[1, 2]</script><script></script>", []),
    ],
)
def test_json_of_a_page(spark, html, want):
    got = sources.json_records(pages(spark, html)).orderBy("kind", "record").collect()
    assert [(r["kind"], r["record"], r["json"]) for r in got] == want


def test_json_sources_win_where_they_hold_more(spark):
    html = CARDS.format("".join(CARD.format(n=n, i="") for n in range(3))) + '<script>[{"itemId": 1}, {"itemId": 2, "b": 0}, {"c": 1}]</script><script type="application/ld+json">{"sku": 1}</script><link rel=alternate type="application/json" href="/api/a">'
    p = pages(spark, html)
    got = sources.recommended(p, markup.elements(p)).orderBy("rank").collect()
    assert [(r["kind"], r["records"], r["fields"], r["stable_ids"], r["confidence"], r["selected"]) for r in got] == [
        ("embedded_json", 3, ["itemId", "b", "c"], True, "high", True), ("repeated_dom", 3, ["title", "link", "image", "price"], False, "medium", False),
        ("json_ld", 1, ["sku"], True, "medium", False), ("api", None, [], False, "high", False),
    ]
    assert got[3]["location"] == "https://a.example/api/a"
