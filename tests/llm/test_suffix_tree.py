import pathlib
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakeprobe.llm import common
from lakeprobe.llm import suffix_tree_lm as m

ODD = [
    "", " ", "\t\n\v\f\r ", "a", "A a\x00 a\x00\x00 \x00", "abcdefg abcdefgh abcdefghi abcdefgh\x00 ABCDEFGHI", "x" * 127 + " " + "x" * 128 + " " + "X" * 129 + " " + "x" * 128 + "y",
    "\x1c\x1d \x85 　 İ K k", "y" * 5000, "ab" * 64 + " " + "ba" * 64, "中文 " * 9, "end ", " begin",
]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([False] * len(texts), pa.bool_()), pa.array(texts, pa.binary())], ["doc_id", "held_out", "text"])


@pytest.mark.parametrize("split", [1, 300, m.SPLIT])
def test_equal_words_and_no_others_have_equal_hashes(monkeypatch, split):
    monkeypatch.setattr(m, "SPLIT", split)
    texts = [t.encode() for t in ODD] + [b"\xff\xfe a", b""]
    got = pa.Table.from_batches(list(m.coded(iter([batch(texts), batch([]), batch(texts[::-1])]))))
    assert got.column("doc_id").to_pylist() == [*range(len(texts))] * 2
    hashes = defaultdict(set)
    for text, blob in zip(texts + texts[::-1], got.column("words").to_pylist(), strict=True):
        own = np.frombuffer(blob, np.uint64).tolist()
        for word, h in zip(text.lower().split(), own, strict=True):
            hashes[word].add(h)
    assert all(len(x) == 1 for x in hashes.values())
    assert len(set.union(*hashes.values())) == len(hashes) > 20


def test_words_are_hashed_at_about_the_cost_of_splitting():
    """The share of Python in the CPU seconds of op7: words hashed one by one, as before, take three times as long as splitting."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"word{k}" for k in rng.zipf(1.3, 2000) % 100_000).encode() for _ in range(400)]

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    given = batch(texts)
    assert least(lambda: list(m.coded(iter([given])))) < 2 * least(lambda: [t.lower().split() for t in texts])


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_counts_pass_through_spark_a_row_for_each_part(spark, monkeypatch, parts):
    """Before, every distinct key of a task was a row of its own."""
    monkeypatch.setattr(m, "FLUSH", 3000)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 50)).encode() for _ in range(700)]
    words = pa.Table.from_batches(list(m.coded(iter([batch(texts)])))).combine_chunks().to_batches()
    rows = [r for b in m.counted(m.words_of, m.packed(parts))(iter(words)) for r in b.to_pylist()]
    assert len(rows) == 4 * parts < 100
    want = Counter(h for b in words for x in b.column("words").to_pylist() for h in np.frombuffer(x, np.int64).tolist()) | Counter({int(m.END.view(np.int64)): len(texts)})
    for enough in (1, 2, 20):
        got = m.totals(spark.createDataFrame(rows, m.PACKED), parts, enough, m.as_counts, "key long, n long").collect()
        assert len(got) == len({r["key"] for r in got})
        assert {r["key"]: r["n"] for r in got} == {k: n for k, n in want.items() if n >= enough}
    assert m.totals(spark.createDataFrame([], m.PACKED), parts, 1, m.as_counts, "key long, n long").collect() == []


@pytest.mark.parametrize("keys", [[], [0], [2**64 - 1], [0, 1, 2, 3, 2**63, 2**63 + 1, 2**64 - 2, 2**64 - 1], [*range(5000), *range(2**64 - 50, 2**64)]])
def test_a_table_finds_its_keys_and_no_others(keys):
    table = m.Table(np.array(keys[::-1], np.uint64), np.array(keys[::-1], np.uint64))
    asked = np.array(sorted({(k + d) % 2**64 for k in [*keys, 2**62] for d in (-1, 0, 1)}) * 2, np.uint64)
    at, there = table.find(asked)
    assert there.tolist() == [k in set(keys) for k in asked.tolist()]
    assert (table.values[0][at[there]] == asked[there]).all()


@pytest.mark.parametrize("bits", [m.SIEVE, (22, 22)])
def test_a_sieve_lets_its_keys_pass_and_few_others(spark, monkeypatch, bits):
    """A table of more than BOUND rows meets the sequences that pass; before, it was joined with every sequence of every text."""
    monkeypatch.setattr(m, "SIEVE", bits)
    rng = np.random.default_rng(7)
    keys = np.concatenate([rng.integers(0, 2**64, 5000, np.uint64), np.array([0, 2**63 - 1, 2**63, 2**64 - 1], np.uint64)])
    sieve = m.Sieve(spark.createDataFrame([(k,) for k in keys.view(np.int64).tolist()], "key long"), len(keys))
    assert sieve.may(keys).all()
    assert sieve.may(rng.integers(0, 2**64, 100_000, np.uint64)).mean() < 0.01
    nothing = m.Sieve(spark.createDataFrame([], "key long"), 0)
    assert not nothing.may(keys).any()
    docs = spark.createDataFrame([(1, keys[:900].tobytes()), (2, rng.integers(0, 2**64, 900, np.uint64).tobytes())], "row long, words binary")
    monkeypatch.setattr(m, "BOUND", 0)
    known = m.Lookup(spark.createDataFrame([(k, 0.5) for k in set(keys.view(np.int64).tolist())], "key long, p double"), ["p"])
    got = {r["row"]: len(r["known"] or ()) for r in known.attach(docs, range(1, 3)).collect()}
    assert got == {1: 900, 2: 0}


@pytest.mark.parametrize("tokens", [30_000, 1_300_000])
def test_evidence_counts_the_same_in_a_corpus_of_any_size(spark, tokens):
    """Five occurrences make a context; before, six were needed beyond a million tokens, and one more for each doubling."""
    rng = np.random.default_rng(7)
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(1000) if i not in ids)
    filler = [" ".join(f"w{k}" for k in rng.integers(0, 3000, tokens // 50)) for _ in range(50)]
    texts = [f"{t} alpha beta" if k < 5 else t for k, t in enumerate(filler)]
    docs = spark.createDataFrame([*zip(ids, texts), (held, "alpha beta")], "doc_id long, text string")
    got = m.score(docs).filter("held_out").first()
    assert got["train_tokens"] > tokens * 0.99 and got["n_known"] == 3
    assert got["score"] > got["base_score"] + 2


@pytest.mark.parametrize("chunk", [6_000_000, 40, 1])
def test_chunks_ask_for_each_sequence_once(spark, monkeypatch, chunk):
    """Texts have most of their sequences in common; before, each text was joined with the table by its own."""
    monkeypatch.setattr(m, "BOUND", 0)
    monkeypatch.setattr(m, "CHUNK", chunk)
    texts = [b"a b c d e"] * 30 + [b"", b"f g"] + [b"a b x"] * 3
    words = pa.Table.from_batches(list(m.chunked(iter([batch(texts), batch([]), batch(texts)]))))
    chunks = words.column("chunk").to_pylist()
    assert chunks == sorted(chunks) and len(set(chunks)) == {6_000_000: 1, 40: 10}.get(chunk, len(chunks))
    keys = {h for blob in words.column("words").to_pylist() for h in np.frombuffer(blob, np.int64).tolist()}
    known = m.Lookup(spark.createDataFrame([(k, 0.5, float("nan")) for k in keys], "key long, own double, back double"), ["own", "back"])
    docs = spark.createDataFrame([(c, bytes(x)) for c, x in zip(chunks, words.column("words").to_pylist(), strict=True)], "chunk long, words binary").repartition(1).sortWithinPartitions("chunk")
    got = defaultdict(list)
    for r in known.found(docs, lambda t: [t.endings(1)]).collect():
        got[r["chunk"]] += np.frombuffer(r["key"], np.int64).tolist()
        assert len(r["key"]) == len(r["own"]) == len(r["back"])
    want = defaultdict(set)
    for c, blob in zip(chunks, words.column("words").to_pylist(), strict=True):
        want[c].update(np.frombuffer(blob, np.int64).tolist())
    assert {c: sorted(k) for c, k in got.items()} == {c: sorted(k) for c, k in want.items() if k}


def test_sequences_tell_their_endings():
    rng = np.random.default_rng(7)
    context, ending = rng.integers(0, 2**64, (2, 10_000), np.uint64)
    assert (m.ending_of(m.joined(context, ending), context) == ending).all()


@pytest.mark.parametrize("bound", [m.BOUND, 50])
def test_shuffled_files_are_deleted_on_the_way(spark, monkeypatch, bound):
    """Before, all that was shuffled stayed on disk until the driver collected its garbage."""
    monkeypatch.setattr(m, "BOUND", bound)
    left = lambda: {p: p.stat().st_size for p in pathlib.Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data") if p.exists()}
    before = left()
    scored = m.score(common.documents(spark, "/root/testdata/sf0.01"))
    until = time.time() + 20
    while (size := sum(n for p, n in left().items() if p not in before)) > 1_500_000 and time.time() < until:
        time.sleep(0.5)
    assert size < 1_500_000  # the table of documents has as many bytes
    assert scored.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
