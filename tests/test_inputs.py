"""Bodies, probes and catalogs from files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lakeprobe.functions import json_ops, summary
from lakeprobe.operators import catalog
from lakeprobe.sources import catalog_file


def test_json_is_one_value(spark):
    texts = ["{}", " [1] ", "1", '"s"', "null", "{} {}", "1,2", "1]", "1}", "1],[2", '1},{"v":2', '1, "w": 2', "1]],[[2", "", " ", "{oops", '{"a":1} tail', "[1,]", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(json_ops.is_json(F.col("t"))).collect()]
    assert got == [True] * 5 + [False] * 14


def test_summaries_and_probes(spark):
    many = json.dumps([{f"k{i}": i for i in range(40)}])
    rows = [(0, '{"b": 1, "a": 2}'), (1, many), (2, "[]"), (3, '[1, {"a": 1}]'), (4, "7"), (5, "{"), (6, None)]
    df = spark.createDataFrame(rows, "i int, t string").orderBy("i")
    got = [tuple(r["s"]) for r in df.select(summary.json_summary(F.col("t")).alias("s")).collect()]
    assert got == [
        (True, "object", None, ["b", "a"]), (True, "array", 1, [f"k{i}" for i in range(30)]), (True, "array", 0, None), (True, "array", 2, None), (True, "scalar", None, None), (False, "invalid", None, None), (False, "invalid", None, None),
    ]
    probe = lambda status, kind: [tuple(r["p"]) for r in df.select(summary.probe(F.lit(status).cast("int"), F.lit(kind), F.col("t")).alias("p")).collect()]
    told = probe(204, "Application/JSON")
    assert told[0] == (True, True, "object", None, ["b", "a"], False) and told[1] == (True, True, "array", 1, [f"k{i}" for i in range(20)], True)
    assert told[3] == (True, True, "array", 2, None, False) and told[4] == (True, True, None, None, None, False) and told[5] == (True, False, None, None, None, False)
    assert set(probe(404, "text/html")) == {(False, None, None, None, None, False)} and {p[0] for p in probe(None, None)} == {False}


def test_catalog_files(spark, tmp_path):
    item = {"id": "a", "name": "A", "category": "Weather", "description": "d"}
    full = item | {"id": "b", "auth": "key", "free_type": "paid", "cors": True, "https": False, "formats": ["json"], "sdk": True, "docs_url": "u", "verify_url": "v", "source": "s", "project_ideas": ["x"], "last_verified_at": "2024-02-02", "commercial_use": "no", "unknown": 1}
    (tmp_path / "one.json").write_text(json.dumps({"curated_at": "2024-01-01", "apis": [item, full, {"id": "c"}]}, indent=2))
    (tmp_path / "two.json").write_text(json.dumps({"apis": [item | {"id": "d"}]}))
    (tmp_path / "broken.json").write_text("{")
    got = {r["id"]: r.asDict() for r in catalog_file.read(spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == ["a", "b", "d"] and len(got["a"]) == len(catalog_file.FIELDS) + 2
    a = got["a"]
    assert (a["auth"], a["free_type"], a["rate_limit"], a["cors"], a["https"], a["formats"], a["verify_url"], a["source"], a["status"], a["last_verified_at"]) == (
        "none", "free_forever", "Not specified", False, True, [], None, "official_docs", "docs_verified", "2024-01-01",
    )
    assert {k: got["b"][k] for k in full if k != "unknown"} == {k: v for k, v in full.items() if k != "unknown"} and got["d"]["last_verified_at"] == ""


@pytest.mark.parametrize("topics", [["weather", "sea"], ["ab", "a", "weather"]])
def test_topics_are_found_anywhere_in_a_text(spark, topics):
    texts = ["sea weather", "x", "overseas", "ab", "wea ther", "", None, "weather" * 3]
    got = catalog.contained(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(t,) for t in [*topics, "", None]], "w string"), "w")
    assert {tuple(r) for r in got.collect()} == {(t, w) for t in texts if t for w in topics if w in t}


def test_boost_adds_up_over_many_stems(spark):
    records = spark.createDataFrame([(1, "Weather", "about the sea"), (2, "Sea", None), (3, None, "weather"), (4, "Other", "none")], "id int, category string, description string")
    stems = spark.createDataFrame([("wea", "Weather"), ("wea", "Sea"), ("weath", "Weather"), ("x", "Other")], "stem string, category string")
    plain = {}
    for r in records.collect():
        n = 0
        for word in ("weat", "sea"):
            for stem in ("wea", "weath", "x"):
                if word.startswith(stem) or stem.startswith(word):
                    found = [s["category"].lower() for s in stems.collect() if s["stem"] == stem]
                    n += 4 * ((r["category"] or "").lower() in found) + any(c in (r["description"] or "").lower() for c in found)
        plain[r["id"]] = n
    assert {r["id"]: r["boost"] for r in catalog.boost(records, "Weat sea", stems).collect()} == plain and plain[1] > plain[4] == 0
    assert {r["boost"] for r in catalog.boost(records, "", stems).collect()} == {0}


def test_characters_and_folded_names(spark):
    from lakeprobe.functions import text
    from lakeprobe.operators import rename

    got = spark.createDataFrame([("a\u200b\U0001F600\u202e\u0007e\u0301\U000f0000\ue000\u00ad\ufffd \n",), (None,), ("plain",)], "t string").select(text.characters(F.col("t")).alias("x")).collect()
    assert [tuple(x) for x in got[0]["x"]] == [
        (1, "U+200B", "zero_width", "alert"), (3, "U+202E", "bidi_control", "alert"), (4, "U+0007", "control", "alert"), (6, "U+0301", "combining_mark", "info"), (7, "U+F0000", "private_use", "warn"),
        (8, "U+E000", "private_use", "warn"), (9, "U+00AD", "soft_hyphen", "warn"), (10, "U+FFFD", "replacement_char", "alert"),
    ]
    assert got[1]["x"] is None and got[2]["x"] == []
    plan = spark.createDataFrame([(1, "a", "Straße"), (2, "b", "STRASSE"), (3, "c", "x"), (4, "d", "ΣΑΣ"), (5, "e", "σας"), (6, "f", "y"), (7, "g", "y")], "id int, name string, new_name string")
    found = {r["id"]: (r["case_only"], r["shown"], r["old_name"]) for r in rename.conflict_members(plan, "id").collect()}
    assert found == {1: (True, "Straße", "a"), 2: (True, "Straße", "b"), 4: (True, "ΣΑΣ", "d"), 5: (True, "ΣΑΣ", "e"), 6: (False, "y", "f"), 7: (False, "y", "g")}


def test_requests_become_scripts_that_run(spark, monkeypatch, capsys):
    import sys
    import types

    from lakeprobe.functions import net

    seen = []
    answer = types.SimpleNamespace(raise_for_status=lambda: None, text="done")
    monkeypatch.setitem(sys.modules, "requests", types.SimpleNamespace(request=lambda *a, **k: seen.append((a, k)) or answer))
    monkeypatch.setenv("AUTHORIZATION", "Bearer x")
    rows = [("post", "https://u:p@a.example/x?api_key=1&q=a'b", {"Authorization": "Bearer real", "X": 'quote " \\ and \n line é 😀'}, "body\t'\"\\"), ("get", "http://a.example", {}, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m string, u string, h map<string,string>, b string").orderBy("i")
    scripts = [r[0] for r in df.select(net.to_python(F.col("m"), F.col("u"), F.col("h"), F.col("b"))).collect()]
    for script in scripts:
        assert "real" not in script and "api_key=1" not in script
        exec(compile(script, "script", "exec"), {})
    assert seen[0] == (("POST", "https://***@a.example/x?api_key=***&q=a'b"), {"headers": {"Authorization": "Bearer x", "X": rows[0][2]["X"]}, "data": rows[0][3].encode(), "timeout": 15})
    assert seen[1] == (("GET", "http://a.example"), {"headers": {}, "timeout": 15}) and capsys.readouterr().out == "done\ndone\n"
