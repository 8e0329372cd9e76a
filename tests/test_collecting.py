"""Jobs across sessions, collection step by step, results with broken lines, exports from many partitions."""

from __future__ import annotations

import csv
import io
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lakeprobe.sources import exports, results
from lakeprobe.streaming import collecting, store


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        self.now += 1
        return self.now


def counting(params, internal, budget):
    n = internal.get("n", 0) + min(budget.units, params["by"])
    return store.Outcome({"n": n}, {"n": n}, n / 10, n >= 10)


def test_jobs_go_on_in_another_session(spark, tmp_path):
    folder, clock = f"file://{tmp_path}/jobs", Clock()
    first, second = (store.Jobs(s, folder, store.Limits(job_bytes=2000), clock) for s in (spark, spark.newSession()))
    for jobs in (first, second):
        jobs.register("count", counting)
    job = first.start("count", {"by": 4})
    assert (job["status"], job["progress"], job["version"]) == ("queued", 0.0, 0)
    one = second.step(job["job_id"], job["cursor"])
    assert (one["status"], one["progress"], one["version"], json.loads(one["partial"])) == ("running", 0.4, 1, {"n": 4})
    assert first.step(job["job_id"], job["cursor"]) == one  # the cursor of a step that has been taken
    two = first.step(job["job_id"], one["cursor"], store.Budget(units=3))
    assert json.loads(two["partial"]) == {"n": 7}
    # two sessions at the same step: the one that posts later is stale
    second._post([(job["job_id"], clock(), "advance", two["cursor"], json.dumps({"partial": {"n": 99}, "internal": {"n": 99}, "progress": 0.5, "done": False}))])
    first._post([(job["job_id"], clock(), "advance", two["cursor"], json.dumps({"partial": {"n": 1}, "internal": {"n": 1}, "progress": 0.5, "done": False}))])
    first._apply()
    assert json.loads(second.status(job["job_id"])["partial"]) == {"n": 99}
    done = second.step(job["job_id"])
    assert (done["status"], done["progress"], done["cursor"]) == ("completed", 1.0, None)
    assert first.cancel(job["job_id"])["status"] == "completed" and first.step(job["job_id"])["version"] == done["version"]


def test_jobs_end_and_are_evicted(spark, tmp_path):
    clock = Clock()
    jobs = store.Jobs(spark, f"file://{tmp_path}/jobs", store.Limits(jobs=3, job_bytes=500, seconds=500), clock)
    jobs.register("count", counting)
    jobs.register("broken", lambda params, internal, budget: 1 / 0)
    jobs.register("large", lambda params, internal, budget: store.Outcome("x" * 1000, {}, 0.5, False))
    with pytest.raises(KeyError):
        jobs.start("unknown", {})
    with pytest.raises(ValueError, match="Api_Key"):
        jobs.start("count", {"Api_Key": 1})
    with pytest.raises(KeyError):
        jobs.status("0" * 32)
    a, b, c = (jobs.start(k, {"by": 1})["job_id"] for k in ("count", "broken", "large"))
    failed, large = jobs.step(b), jobs.step(c)
    assert (failed["status"], failed["errors"]) == ("failed", ["ZeroDivisionError: division by zero"])
    assert (large["status"], large["errors"], large["partial"]) == ("failed", ["the state of the job is too large"], None)
    assert jobs.cancel(a)["status"] == "cancelled"
    # lines that can't be read change nothing
    (pathlib.Path(tmp_path) / "jobs/commands/broken.json").write_text('{"job_id": "x", "at"\nnothing\n')
    d, e = jobs.start("count", {"by": 1})["job_id"], jobs.start("count", {"by": 1})["job_id"]
    with pytest.raises(KeyError):  # four jobs were too many: the one touched longest ago went
        jobs.status(b)
    clock.now += 1000
    assert jobs.evict() == 4 and jobs.evict() == 0
    for gone in (a, c, d, e):
        with pytest.raises(KeyError):
            jobs.step(gone)


def test_eviction_by_bytes(spark):
    rows = spark.createDataFrame([("a", 1.0, 10), ("b", 2.0, 50), ("c", 3.0, 30), ("d", 4.0, 30)], "job_id string, updated double, bytes long")
    gone = lambda **k: {r["job_id"] for r in store.evicted(rows, store.Limits(**k), 5.0).collect()}
    assert gone() == set() and gone(total_bytes=60) == {"a", "b"} and gone(jobs=1) == {"a", "b", "c"} and gone(seconds=2) == {"a", "b"}


def plain(rows, limits):
    """The contract, page by page: what is kept, and each job's pages, rows, bytes and stop reason."""
    kept, totals = [], {}
    by_job = {}
    for job, page, pos, value in rows:
        if job is not None and page is not None:
            by_job.setdefault(job, {}).setdefault(page, []).append((pos, value))
    for job, pages in by_job.items():
        n, r, size, stopped = 0, 0, 0, None
        for page in sorted(pages):
            if stopped:
                break
            found = sorted((p, v) for p, v in pages[page] if v is not None)
            if not found:
                n += n == 0
                stopped = "end"
                break
            found = found[: limits.rows - r]
            kept += [(job, page, p, v) for p, v in found]
            n, r, size = n + 1, r + len(found), size + sum(len(json.dumps({"value": v}, separators=(",", ":"))) + 1 for _, v in found)
            stopped = "rows" if r >= limits.rows else "pages" if n >= limits.pages else "bytes" if size >= limits.bytes else None
        totals[job] = (n, r, size, stopped)
    return sorted(kept), totals


def test_many_steps_are_one(spark, tmp_path):
    some, rows = random.Random(2), []
    for job in range(40):
        for page in range(1, some.randint(2, 9)):
            found = [(f"j{job}", page, pos, some.choice(["7", "2024-05-06", "http://a.example", "word", ""])) for pos in range(some.choice([0, 1, 4, 9]))]
            rows += found or [(f"j{job}", page, 0, None)]
    rows += [(None, 1, 0, "x"), ("n", None, 0, "x")]
    rows += [("hot", page, pos, f"v{pos}") for page in range(1, 40) for pos in range(30)]
    schema = "job string, page long, pos int, value string"
    limits = collecting.Limits(pages=5, rows=25, bytes=400)
    want, totals = plain(rows, limits)
    for steps in (1, 4):
        folder = tmp_path / f"in{steps}"
        for i in range(steps):  # pages 1-2, 3-4...
            part = [r for r in rows if steps == 1 or min(3, ((r[1] or 1) - 1) // 2) == i]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
        got = collecting.Collection(stream, ["value"], limits, f"file://{tmp_path}/out{steps}").run()
        assert sorted(tuple(r) for r in got.kept().select("job", "page", "pos", "value").collect()) == want
        assert {r["job"]: (r["pages"], r["rows"], r["bytes"], r["stopped"]) for r in got.totals().collect()} == totals
        drift = sorted(map(tuple, collecting.drift(got.counts()).collect()))
        first = drift if steps == 1 else first
        assert drift == first and len(drift) == len({r[0] for r in want})
        again = collecting.Collection(stream, ["value"], limits, f"file://{tmp_path}/out{steps}").run()  # nothing new: nothing changes
        assert again.totals().count() == len(totals) and again.kept().count() == len(want)


def test_results_with_broken_lines(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2\n[1]\n"s"\n  {"a": "no number"}  \n{"a": 3, "c": {"d": [1]}}', encoding="utf-8")
    assert [tuple(r) for r in results.read(spark, f"file://{path}", "a long, b string").collect()] == [(1, "x"), (None, None), (3, None)]
    assert results.count(spark, f"file://{path}") == 6
    assert tuple(results.quality(spark, f"file://{path}").first()) == (6, 3, 3)
    assert results.read(spark, f"file://{path}", limit=2).count() == 1
    assert {tuple(r) for r in results.keys(results.read(spark, f"file://{path}")).collect()} == {("a", 3), ("b", 1), ("c", 1)}
    assert results.read(spark, f"file://{tmp_path}/none.jsonl").count() == 0


def joined(folder):
    return b"".join(p.read_bytes() for p in sorted(pathlib.Path(folder).glob("part-*")))


@pytest.mark.parametrize("kind", ["csv", "tsv", "jsonl", "json"])
def test_exports_are_one_file_from_any_partitions(spark, tmp_path, kind):
    some = random.Random(1)
    rows = [(some.randint(0, 50), some.choice([None, "", "a,b", 'q"q', "line\nbreak", "tab\tx", "é"]), some.choice([1.5, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "id int, `na,me` string, line double")
    made = []
    for n in (1, 8):
        exports.write(df.repartition(n), f"file://{tmp_path}/{kind}{n}", ["id"], kind, bom=kind == "csv", crlf=False)
        made.append(joined(tmp_path / f"{kind}{n}"))
    assert made[0] == made[1]
    text = made[0].decode("utf-8-sig")
    assert made[0].startswith(b"\xef\xbb\xbf") == (kind == "csv") and text.count("﻿") == 0
    cells = lambda r: tuple("" if c is None else str(c) for c in r)
    if kind in ("csv", "tsv"):
        read = list(csv.reader(io.StringIO(text, newline=""), delimiter="\t" if kind == "tsv" else ","))
        assert read[0] == ["id", "na,me", "line"] and sorted(map(tuple, read[1:])) == sorted(map(cells, rows))
        assert [int(r[0]) for r in read[1:]] == sorted(r[0] for r in rows)
    else:
        read = json.loads(text) if kind == "json" else [json.loads(x) for x in text.splitlines()]
        assert sorted(map(cells, (r.values() for r in read))) == sorted(map(cells, rows)) and [r["id"] for r in read] == sorted(r[0] for r in rows)
    told = exports.manifest(spark, f"file://{tmp_path}/{kind}8").collect()
    assert sum(r["bytes"] for r in told) == len(made[0]) and [r["part"] for r in told] == sorted(r["part"] for r in told)


def test_exports_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "a int")
    for kind, want in (("csv", b"a\n"), ("json", b"[\n]\n"), ("jsonl", b"")):
        exports.write(none, f"file://{tmp_path}/{kind}", ["a"], kind)
        assert joined(tmp_path / kind) == want
    with pytest.raises(ValueError, match="unknown format"):
        exports.lines(none, ["a"], "xml")
    assert [tuple(r) for r in exports.assets(spark.createDataFrame([(1, "http://a", "b https://c", None)], "i int, x string, y string, z string"), "i").collect()] == [(1, "x", "http://a")]


def test_failed_steps_tell_why(spark, tmp_path):
    from lakeprobe.streaming import jobs

    spark.range(10).coalesce(1).write.parquet(f"file://{tmp_path}/t.parquet")
    rows = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/t.parquet").select(F.when(F.col("id") == 7, F.raise_error(F.lit("page seven is broken"))).otherwise(F.lit("x")).cast("string").alias("x"))
    got = jobs.steps(rows, "broken")
    assert (got.status, got.rows) == (jobs.FAILED, 0) and "page seven is broken" in got.error


def test_lists_with_a_record_on_each_line_are_read_in_parallel(spark, tmp_path):
    from lakeprobe.sources import tabular

    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return f"file://{tmp_path}/{name}"

    good = ['[\n{"b": 1, "a": "x"},\n{"b": 2}\n]\n', '[{"b": 1, "a": "x"}\n,{"b": 2}]', '[ {"b": 1, "a": "x"},\n\n {"b": 2} ]', '﻿[{"b": 1, "a": "x"},\n{"b": 2}]']
    for i, text in enumerate(good):
        path = put(f"g{i}.json", text)
        assert tabular.listed_lines(spark, path) and tabular.read_table(spark, path).columns == ["b", "a"]
        assert sorted(tuple(r) for r in tabular.read_table(spark, path).collect()) == [("1", "x"), ("2", None)]
    for i, text in enumerate(['[{"a": 1}\n{"a": 2}]', '[{"a": 1},\n{"a": 2},]', '[\n{\n"a": 1\n}\n]', "[1,\n2]", '[{"a": [\n{"b": 1},\n{"b": 2}\n]}]', "[]", '[{"a": 1}]]']):
        assert tabular.listed_lines(spark, put(f"o{i}.json", text)) is None
    nested = tabular.read_table(spark, put("n.json", '[{"a": [\n{"b": 1},\n{"b": 2}\n]}]')).collect()
    assert len(nested) == 1
    # quoted line breaks are still found
    assert [tuple(r) for r in tabular.read_table(spark, put("q.csv", 'a,b\n1,"two\nlines"\n3,4\n')).collect()] == [("1", "two\nlines"), ("3", "4")]
    assert sorted(tuple(r) for r in tabular.read_table(spark, put("p.csv", 'a,b\n1,"t,""x"""\n3\n')).collect()) == [("1", 't,"x"'), ("3", None)]
