"""Operators that SQL cannot express, against plain Python over whole tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeprobe.llm import bpe, exact_dedup, jaccard_join, sharding, suffix_tree_lm, toxicity, winnowing
from lakeprobe.llm.common import documents, table
from lakeprobe.llm.transducer import Transducer
from tests.llm.cases import ROWS, empty, frame


def texts_of(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in documents(spark, sf).select("doc_id", "text").collect()]


@pytest.fixture(params=["table", "cases"])
def docs(request, spark, sf):
    return documents(spark, sf) if request.param == "table" else frame(spark)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_matches_the_tokenizer(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for i, text in rows_of(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.query(docs.sparkSession, docs).collect()) == want


def test_bpe_decodes_unknown_ids_to_nothing(spark):
    df = spark.createDataFrame([(1, [15496, None, 999999, 995]), (2, None)], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df).orderBy("doc_id").collect()] == ["Hello world", ""]


def test_jaccard_classes_and_links(docs):
    items, classes = rows_of(docs), {}
    big = (1 << 63) - 1
    sets = []
    for i, text in items:
        w = jaccard_join.WORD.findall(text)
        sets.append((big if i is None else i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    links = [0] * len(sets)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    for x, (i, _) in enumerate(sets):
        classes[find(x)] = min(classes.get(find(x), big), i)
    known = lambda i: None if i == big else i
    want = Counter((known(i), known(classes[find(x)]), links[x]) for x, (i, _) in enumerate(sets))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.query(docs.sparkSession, docs).collect())
    assert got == want


def test_rows_without_ids_are_told_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base, "en"), (None, base + " x", "en"), (None, "other words of a text that is not alike at all", "en"), (7, "one more text that nothing else is like", "en"), (7, base + " y", "en")]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.query(spark, frame(spark, rows)).collect())
    assert got == Counter({(None, 7, 2): 2, (7, 7, 2): 1, (None, None, 0): 1, (7, 7, 0): 1})
    assert Counter(r["text"] for r in jaccard_join.first_of_each(frame(spark, rows)).collect()) == Counter([base + " y", rows[2][1], rows[3][1]])


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_runs_reach_the_recall_at_full_depth(threshold):
    n_runs, n_tokens, least = jaccard_join.effort(threshold, 0.9999)
    unmet = (1 - threshold**jaccard_join.DEPTH) ** n_runs
    unlike = sum(math.comb(n_tokens, k) * threshold**k * (1 - threshold) ** (n_tokens - k) for k in range(least))
    assert unmet + unlike <= 1e-4 and n_tokens >= n_runs * jaccard_join.DEPTH


def plain_links(items, threshold):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in items if (w := jaccard_join.WORD.findall(t))}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8])
def test_recall_where_buckets_split_and_clusters_have_blocks(spark, monkeypatch, threshold):
    """Families of near copies that share much of their text: buckets are split and stay dense, clusters are compared in blocks."""
    import random

    rng = random.Random(11)
    monkeypatch.setattr(jaccard_join, "LIMIT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(120)] = f"edit{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(words), "en"))
    items = [(i, t) for i, t, _ in rows]
    links = plain_links(items, threshold)
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.join(frame(spark, rows), threshold=threshold).collect()}
    want = Counter(x for pair in links for x in pair)
    assert len(links) > 100 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * 2 * len(links)


def plain_winnow(text):
    k, w = winnowing.K, winnowing.WINDOW
    points = winnowing.np.array([ord(c) for c in text] + [0x110000] * (k - len(text)), dtype="u4")
    if not text:
        return []
    h = winnowing.hashes(points).tolist()
    w = min(w, len(h))
    kept = []
    for s in range(len(h) - w + 1):
        at = max(range(s, s + w), key=lambda i: (-h[i], i))
        if not kept or kept[-1] != at:
            kept.append(at)
    return [(h[i] >> 32, i) for i in kept]


def test_winnowing(docs):
    items = sorted(rows_of(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    marks = [plain_winnow(t) if len(t) < 30_000 else None for _, t in items]
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = winnowing.query(docs.sparkSession, docs).collect()
    by = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    for n, (i, t) in enumerate(items):
        after = items[(n + 1) % len(items)][1]
        want[i, len(t), sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2])] += 1
    assert by == want
    exact = {(r["doc_id"], r["n_chars"]): r for r in got}
    for n, (i, t) in enumerate(items):
        m = (n + 1) % len(items)
        if marks[n] is None or marks[m] is None or sum(x[0] == i for x in items) > 1:
            continue
        r, e = exact[i, len(t)], plain_winnow(t[: len(t) - len(t) // 2] + items[m][1][: len(t) // 2])
        assert r["fingerprint"] == "".join(f"{h:08x}{p:08x}" for h, p in marks[n])
        assert r["edited_fingerprint"] == "".join(f"{h:08x}{p:08x}" for h, p in e)
        assert r["near_edited"] == pytest.approx(likeness({h for h, _ in marks[n]}, {h for h, _ in e}))
        assert r["near_next"] == pytest.approx(likeness({h for h, _ in marks[n]}, {h for h, _ in marks[m]}))


def plain_tokens(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_suffix_tree_counts_and_base(docs):
    items = rows_of(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in items:
        if not held(i):
            counts.update([*plain_tokens(t), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, t in items:
        words = [*plain_tokens(t), "\n"]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        want[i].append((held(i), len(words), sum(counts[w] > 0 for w in words), total, base))
    got = suffix_tree_lm.query(docs.sparkSession, docs).collect()
    assert len(got) == len(items)
    for i, rows in want.items():
        own = sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got if r["doc_id"] == i)
        for a, b in zip(own, sorted(rows), strict=True):
            assert a[:4] == b[:4]
            assert a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)
    assert all(r["score"] < 0 for r in got)


def plain_tree(items):
    """The tree by its definition, over tuples of tokens: what a text's score is."""
    m = suffix_tree_lm
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = [("<", *plain_tokens(t), ">") for i, t in items if not held(i)]
    one = Counter(w for t in texts for w in t[1:])
    total, kinds = sum(one.values()), len(one)
    root = lambda w: (one[w] + 1) / (total + kinds + 1)
    count = {(w,): n for w, n in one.items() if n >= m.LEAST} | ({("<",): len(texts)} if len(texts) >= m.LEAST else {})
    p = {q: root(q[0]) for q in count} | {("<",): 1.0}
    contexts = {q for q in count if q != (">",)}
    own, back = {}, {}
    for length in range(2, m.DEPTH + 2):
        seen = Counter()
        for t in texts:
            for k in range(len(t) - length + 1):
                q = t[k : k + length]
                if q[:-1] in contexts and q[1:] in count and count[q[1:]] * -math.log(p[q[1:]]) >= m.LEAST_ENTRY:
                    seen[q] += 1
        new = {q: n for q, n in seen.items() if n >= m.LEAST}
        if not new:
            break
        chosen = defaultdict(list)
        for q, n in new.items():
            if n * math.log(n / count[q[:-1]] / p[q[1:]]) >= m.LEAST_ENTRY:
                chosen[q[:-1]].append(q)
        kept = set()
        for c, qs in chosen.items():
            mass = sum(new[q] for q in qs)
            factor = 1 - mass / (count[c] + m.SMOOTHING)
            mine = {q: new[q] / (count[c] + m.SMOOTHING) + factor * p[q[1:]] for q in qs}
            gain = sum(new[q] * math.log(mine[q] / p[q[1:]]) for q in qs) + (count[c] - mass) * math.log(factor)
            if gain >= m.LEAST_GAIN:
                own.update(mine)
                back[c] = factor
                kept.update(qs)
        before = p
        p = {q: own.get(q, before[q[1:]] * back.get(q[:-1], 1.0)) for q in new}
        count, contexts = new, kept
    nodes = {c[k:] for c in back for k in range(len(c))}

    def score(text):
        t = ("<", *plain_tokens(text), ">")
        out = 0.0
        for k in range(1, len(t)):
            x = math.log10(root(t[k]))
            for length in range(1, k + 1):
                c = t[k - length : k]
                if c not in nodes:
                    break
                x = math.log10(own[*c, t[k]]) if (*c, t[k]) in own else x + math.log10(back.get(c, 1.0))
            out += x
        return out

    return score, max(map(len, back), default=0)


@pytest.mark.parametrize("bound", [suffix_tree_lm.BOUND, 50])
def test_suffix_tree_scores(spark, sf, monkeypatch, bound):
    """Broadcast tables and joined ones give the scores of the plain tree."""
    monkeypatch.setattr(suffix_tree_lm, "BOUND", bound)
    docs = documents(spark, sf).unionByName(frame(spark).select(*documents(spark, sf).columns))
    items = rows_of(docs)
    score, depth = plain_tree(items)
    assert depth >= 2
    want = sorted((i is None, i or 0, round(score(t), 6)) for i, t in items)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in suffix_tree_lm.query(spark, docs).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-4)


def test_suffix_tree_beats_the_base_on_held_out_texts(spark):
    got = suffix_tree_lm.query(spark, documents(spark, "/root/testdata/sf0.01")).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.97 * sum(r["base_score"] for r in got)


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.query(spark, documents(spark, d), table(spark, d, "labels")).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").collect()}
    held = [(got[i], y) for i, y in labels.items() if got[i]["held_out"]]
    hit = sum(r["predicted"] and y for r, y in held)
    assert hit / sum(y for _, y in held) > 0.85
    assert hit / sum(r["predicted"] for r, _ in held) > 0.85
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_transducers_are_composed():
    a = Transducer([0], [0], {(0, "a"): [("b", 0.5, 0)], (0, "c"): [("c", 1.0, 0)]})
    b = Transducer(["s", "t"], ["t"], {("s", "b"): [("x", 0.5, "t"), ("y", 0.9, "s")], ("t", "c"): [("z", 1.0, "t")]})
    assert (a @ b).run("aac") == (["y", "x", "z"], 0.5 * 0.9 * 0.5 * 0.5) and (a @ b).run("c") is not None and (a @ b).run("cb") is None
    step = lambda *ts: [t.run("NOIT") for t in ts]
    assert step(toxicity.insults())[0] == (["N", "O", ("I", "plain"), "T"], 1.0)


def plain_matches(grammar, text):
    """Every clause by rules instead of transducers."""
    out = []
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = [grammar.classify(w) for w in toxicity.WORD.findall(clause)]
        if len(words) < 2 or not any(c in "IH" for c, _ in words):
            continue
        addressed = any(c == "T" for c, _ in words)
        here, weight = [], 1.0
        for k, (c, w) in enumerate(words):
            if c not in "IH":
                continue
            gap = next((g for g in range(1, toxicity.REACH + 1) if k - g >= 0 and words[k - g][0] == "N"), None)
            if gap:
                weight /= gap
            told = any(x == "R" for x, _ in words[:k])
            here.append((c, "negated" if gap else "reported" if told else "targeted" if addressed else "plain", w))
        out += [(c, p, w * weight) for c, p, w in here]
    return out


def test_toxicity_scores_against_rules(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    rich = [(1000 + i, t, "en") for i, t in enumerate(CLAUSES)]
    every = docs.select("doc_id", "text").unionByName(frame(spark, rich).select("doc_id", "text"))
    grammar = toxicity.fit(documents(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels"))
    got = {r["i"]: r for r in toxicity.scored(every, grammar).select(F.col("doc.c0").alias("i"), "score", "matches").collect()}
    for i, t in rows_of(every):
        found = plain_matches(grammar, t)
        assert Counter((m["kind"], m["pattern"], round(m["strength"], 9)) for m in got[i]["matches"]) == Counter((c, p, round(w, 9)) for c, p, w in found)
        x = np.array([grammar.summary(found, len(t))])
        assert got[i]["score"] == pytest.approx(float(1 / (1 + np.exp(-(x @ grammar.coef[1:] + grammar.coef[0])))[0]))
    assert len({r["score"] for r in got.values() if not r["matches"]}) == 1


CLAUSES = (
    "you are not an idiot and never an idiot", "I will kill you", "they said I will hurt you idiot", "idiot", "idiot! idiot; you idiot clown", "no kill. you kill no", "the report was called trash. trash said you", "kill kill kill you", "not a b c idiot", "not a b idiot you",
)


def test_threats_raise_and_reports_and_negations_lower_a_score(spark):
    d = "/root/testdata/sf0.1"
    g = toxicity.fit(documents(spark, d), table(spark, d, "labels"))
    score = lambda t: float(g.score(np.array([g.features(t)]))[0])
    none = score("a fine day")
    assert score("words") == score("idiot") == score("") == score("word " * 500) == none
    assert score("I will kill you") > 0.5 and score("I will destroy your house and hurt you") > 0.9 and score("you are an idiot") > 0.3
    assert none < score("they said he would kill you") < 0.3 and score("you are not an idiot") < 0.3 and score("she said you are an idiot") < score("you are an idiot")


def test_toxicity_reads_clauses():
    g = toxicity.Grammar({"idiot": 5.0, "scu*": 3.0})
    assert g.matches("You are an IDIOT! fine day.") == [("I", "targeted", 5.0)]
    assert g.matches("not an idiot") == [("I", "negated", 2.5)] and g.matches("not idiot") == [("I", "negated", 5.0)]
    assert g.matches("they said scumbag things") == [("I", "reported", 3.0)]
    assert g.matches("nothing here") == g.matches("idiot") == []


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.query(spark, frame(spark), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.query(spark, frame(spark), labels.limit(0)).collect()
    assert all(r["score"] == 0 for r in none)
    assert toxicity.accepted(frame(spark), labels).columns == frame(spark).columns


def test_exact_dedup(docs):
    import re

    items = rows_of(docs)
    group = defaultdict(list)
    for i, t in items:
        group[re.sub("[\x20\x09-\x0d]+", " ", t)].append(i)
    want = Counter()
    for t, ids in group.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, sha(t)] += 1
    assert Counter(tuple(r) for r in exact_dedup.query(docs.sparkSession, docs).collect()) == want
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len(group)


def test_exact_dedup_index_takes_new_data(spark):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.dedup(frame(spark, [(5, "a  b", "en"), (7, "c", "en")]), index).collect()
    second = exact_dedup.dedup(frame(spark, [(1, "a\nb", "en"), (2, "d", "en")]), index).collect()
    assert {r["doc_id"] for r in first} == {5, 7} and {r["doc_id"] for r in second} == {2}
    again = {r["doc_id"]: r["keep_id"] for r in exact_dedup.decide(frame(spark, [(1, "a b", "en")]), index).collect()}
    assert again == {1: 5} and index.rows().count() == 3


def test_sharding_law(docs):
    got = sharding.query(docs.sparkSession, docs).collect()
    items = rows_of(docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in items)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(16))
    total, largest = sum(size.values()), max(r["size"] for r in got)
    assert max(size.values()) <= total / 16 + max(largest, total / 32)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_exact_dedup_in_portions(spark):
    rows = [(i, f"text {i % 7}", "en") for i in range(40)] + [(None, "text 3", "en"), (None, "only here", "en")]
    index = exact_dedup.DigestIndex(spark)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(frame(spark, rows), index, portions=4).collect()}
    size = Counter(t for _, t, _ in rows)
    want = {(i, None if t == "only here" else int(t[5:]), size[t], i == (None if t == "only here" else int(t[5:]))) for i, t, _ in rows}
    assert got == want and index.rows().count() == 8


def test_sharding_with_many_rows_of_one_text(spark):
    """Half of all rows are empty: no range gathers them, and they stay in one shard."""
    rows = [(i, "" if i % 2 else f"a text that is longer, number {i} " * 5, "en") for i in range(6000)]
    docs = frame(spark, rows)
    keys, wide, n, total, ranges = sharding.keyed(sharding.written(sharding.numbered(docs), "t"), 16)
    _, stats = sharding.splitters(keys, ranges)
    assert len(wide) == 1 and max(r for _, r, _ in stats) < n / 10
    got = sharding.query(spark, docs).collect()
    assert len({r["shard"] for r in got if r["size"] == 1}) == 1
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) < 4000 and len(size) == 16


def test_shards_are_written_row_by_row(spark, tmp_path):
    rows = [(7, "one", "en"), (7, "two " * 400, "en"), (7, "three " * 500, "en"), (None, None, None), (8, "x", "en"), (8, "x", "en")]
    docs = frame(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _ in rows)
    where = {(r["doc_id"], r["size"]): r["shard"] for r in sharding.assign(docs, 3).collect()}
    assert all(where[r["doc_id"], len((r["text"] or "").encode()) + 1] == r["shard"] for r in back.collect())


@pytest.mark.parametrize("query", [bpe, jaccard_join, winnowing, suffix_tree_lm, exact_dedup, sharding])
def test_empty_table(spark, query):
    assert query.query(spark, empty(spark)).collect() == []


@pytest.mark.parametrize("query", [bpe, jaccard_join, winnowing, suffix_tree_lm, exact_dedup, sharding])
def test_single_null_row(spark, query):
    assert len(query.query(spark, frame(spark, [(None, None, None)])).collect()) == 1
