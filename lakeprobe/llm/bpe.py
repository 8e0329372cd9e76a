"""Byte-level BPE encoding and decoding by a table of distinct words.

Texts are split into words (a run of non-space with the one space before it, or a
stretch of white space), which the merges never cross. A word is encoded once:
* the HOT most frequent words of a bounded sample are encoded first and broadcast
  (what is in the sample changes the cost, never a result);
* every other occurrence goes, with its chunk of documents and its place there, to the
  partition of its word, which is that word's row of the table: it is encoded there once
  for all its occurrences, and the ids are joined back by chunk and place. The number of
  partitions follows the bytes of text, so that a table of distinct words is held whole. Occurrences of a chunk that go to one partition travel
  packed together; there are never more rows than occurrences.
Decoding joins ids with the table id -> piece, which has as many rows as the
vocabulary and is broadcast, and concatenates the pieces.

Documents are read twice and must come in the same order both times, as they do when
they are read from files. For others (`stable` is not set) they are written first.

Defined results:
* null text is the empty text: no ids, decoded to the empty text;
* the strings of special tokens are encoded as those tokens, as the tokenizer does;
* ids that the vocabulary lacks, and null ids, decode to nothing; bytes that are not
  UTF-8 decode to U+FFFD;
* repeated rows get equal results; texts of any length are encoded whole; an empty
  table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm.common import bounded_batches, partitions, text_of, tidied, written

#: Words broadcast at most, and the bytes of text they are chosen from.
HOT, SAMPLE_BYTES = 300_000, 64 << 20
#: Bytes of text whose other words meet in one partition, about: each holds the ids of its distinct words.
BUCKET = 32 << 20
#: Characters of the documents that are packed into one row.
CHUNK = 1 << 19
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def default_vocabulary() -> str:
    """The path of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A tokenizer file; opened once in each process, from a path that every machine has."""

    _open: dict[str, object] = {}

    def __init__(self, path: str):
        self.path = path
        self.special = sorted((t["content"] for t in self._file()["added_tokens"]), key=len, reverse=True)

    def _tokenizer(self):
        if self.path not in self._open:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            t.no_padding()
            t.no_truncation()
            self._open[self.path] = t
        return self._open[self.path]

    def _file(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def splitter(self):
        """A function from a text to its words; special tokens are words of their own."""
        special = self.special
        around = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

        def split(text: str) -> list[str]:
            if around is None or not any(s in text for s in special):
                return WORD.findall(text)
            out: list[str] = []
            for i, part in enumerate(around.split(text)):
                out.extend([part] if i % 2 else WORD.findall(part))
            return out

        return split

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        return [e.ids for e in self._tokenizer().encode_batch(words, add_special_tokens=False)]

    def pieces(self) -> list[bytes]:
        """The bytes of each id."""
        byte = {c: i for i, c in enumerate(_byte_letters())}
        model = self._file()
        known = {i: t for t, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
        out = [b""] * (max(known) + 1)
        for i, t in known.items():
            out[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        return out


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b if b in prints else extra))
        extra += b not in prints
    return letters


def hot_words(docs: DataFrame, vocabulary: Vocabulary, size: int, text_col: str = "text") -> pd.DataFrame:
    """Up to HOT frequent words with their ids, from texts of about SAMPLE_BYTES of the `size` bytes, drawn by hash."""
    text = docs.select(text_of(text_col).alias("text"))
    share = min(1.0, SAMPLE_BYTES / max(size, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = vocabulary.splitter(), Counter()
        for batch in batches:
            for t in batch.column("text"):
                counts.update(split(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    drawn = text.filter(F.pmod(F.xxhash64("text", F.lit("hot")), F.lit(1 << 30)) < int(share * (1 << 30)))
    words = drawn.mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.filter("n > 1 AND length(word) <= 100").orderBy(F.desc("n"), "word").limit(HOT)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = vocabulary.encode(b.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return top.mapInArrow(tidied(encode), "word string, n long, ids array<int>").orderBy(F.desc("n"), "word").toArrow().to_pandas()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, stable: bool = False) -> DataFrame:
    """A row (doc_id, ids array<int>) for each row of docs; stable: docs comes straight from files."""
    sorted_rows, merge, _ = _encoding(docs, id_col, text_col, path, stable)
    return sorted_rows.mapInArrow(tidied(merge), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, stable: bool = False) -> DataFrame:
    """A row (doc_id, ids, decoded): encode and then decode, without a way through the JVM between; stable: docs comes straight from files."""
    sorted_rows, merge, vocabulary = _encoding(docs, id_col, text_col, path, stable)
    join = _joined(docs.sparkSession.sparkContext.broadcast(vocabulary.pieces()), 1)
    return sorted_rows.mapInArrow(tidied(lambda batches: join(merge(batches))), "doc_id long, ids array<int>, decoded string")


def _encoding(docs: DataFrame, id_col: str, text_col: str, path: str | None, stable: bool):
    """The packed rows sorted for merge, the function that merges them to (doc_id, ids), and the vocabulary."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = Vocabulary(path or default_vocabulary())
    if not stable:
        docs, id_col, text_col = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "bpe-input"), "id", "text"
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of(text_col))), F.lit(0))).first()[0]
    hot = hot_words(docs, vocabulary, size, text_col)
    ids = [np.asarray(x, dtype=np.int32) for x in hot["ids"]]
    sizes = np.array([0, *map(len, ids)], dtype=np.int64)  # number 0: not hot
    table = spark.sparkContext.broadcast((hot["word"].tolist(), np.concatenate([*ids, np.zeros(0, np.int32)]), sizes))
    index: dict[str, int] = {}

    def numbers() -> dict[str, int]:
        if not index:
            index.update((w, i + 1) for i, w in enumerate(table.value[0]))
        return index

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("mark"))
    buckets = max(2 * partitions(spark), -(-size // BUCKET))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, list[list[str]], np.ndarray]]:
        """Documents in a row, up to CHUNK characters together: a key, the ids, the words of each, and the numbers of all words."""
        import xxhash

        split, number = vocabulary.splitter(), numbers()
        ids, words, key, size = [], [], xxhash.xxh64(), 0
        for b in batches:
            for doc_id, t, mark in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("mark").to_pylist(), strict=True):
                t = t.as_py()
                ids.append(doc_id)
                words.append(split(t))
                key.update(mark.to_bytes(8, "little", signed=True))
                size += len(t) + 100
                if size > CHUNK:
                    yield key.intdigest() - (1 << 63), ids, words, _numbered(words, number)
                    ids, words, key, size = [], [], xxhash.xxh64(), 0
        if ids:
            yield key.intdigest() - (1 << 63), ids, words, _numbered(words, number)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk: ids, numbers of words, and the number of each hot word (0 for others)."""
        for key, ids, words, at in chunks(batches):
            blob = _packed(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8), np.array([len(w) for w in words], np.uint32), at)
            yield _row(key, 0, blob)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for each chunk: the words that are not hot and their places, by bucket of the word."""
        for key, _, words, at in chunks(batches):
            flat = [w for doc in words for w in doc]
            by: dict[int, tuple[list[bytes], list[int]]] = {}
            for i in np.flatnonzero(at == 0).tolist():
                w = flat[i].encode("utf-8", "surrogatepass")
                entry = by.setdefault(zlib.crc32(w) % buckets, ([], []))
                entry[0].append(w)
                entry[1].append(i)
            for bucket, (own, places) in by.items():
                blob = _packed(np.array(places, np.uint32), np.array([len(w) for w in own], np.uint32), np.frombuffer(b"".join(own), np.uint8))
                yield _row(key, bucket, blob)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encode each distinct word of a partition once, and give its ids to all its places."""
        known: dict[str, bytes] = {}
        for b in batches:
            for key, blob in zip(b.column("chunk").to_pylist(), b.column("blob").to_pylist(), strict=True):
                places, sizes, data = _unpacked(blob, np.uint32, np.uint32, np.uint8)
                raw, ends = data.tobytes(), np.cumsum(sizes).tolist()
                words = [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip([0, *ends], ends, strict=False)]
                new = [w for w in dict.fromkeys(words) if w not in known]
                known.update((w, np.asarray(x, np.uint32).tobytes()) for w, x in zip(new, vocabulary.encode(new), strict=True))
                found = [known[w] for w in words]
                yield _row(key, 1, _packed(places, np.array([len(x) // 4 for x in found], np.uint32), np.frombuffer(b"".join(found), np.uint32)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chunk and part: the packed documents first, then the ids of their other words."""
        flat, length = table.value[1], table.value[2]
        starts = np.cumsum(length) - length
        held: list[bytes] = []  # more than one where a chunk is repeated
        fills: list[tuple] = []

        def finish() -> Iterator[pa.RecordBatch]:
            for blob in held:
                doc_ids, valid, words, at = _unpacked(blob, np.int64, np.uint8, np.uint32, np.uint32)
                at = at.astype(np.int64)
                places = np.concatenate([np.zeros(0, np.int64), *(f[0].astype(np.int64) for f in fills)])
                sizes = np.concatenate([np.zeros(0, np.int64), *(f[1].astype(np.int64) for f in fills)])
                own = np.concatenate([np.zeros(0, np.int32), *(f[2].astype(np.int32) for f in fills)])
                if len(held) > 1 and len(places):
                    _, first = np.unique(places, return_index=True)
                    own = np.concatenate([own[i - n : i] for i, n in zip(np.cumsum(sizes)[first], sizes[first], strict=True)])
                    places, sizes = places[first], sizes[first]
                if len(places) != np.count_nonzero(at == 0):
                    raise ValueError("a chunk of documents was dealt differently when it was read again")
                count = length[at]
                count[places] = sizes
                begin = np.cumsum(count) - count
                source = np.repeat(starts[at] - begin, count) + np.arange(int(count.sum()))
                spot = np.repeat(begin[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(own))
                source[spot] = 0
                ids = flat[source] if len(flat) else np.zeros(len(source), np.int32)
                ids[spot] = own
                ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(words.astype(np.int64))] if len(at) else np.zeros(len(words), np.int64)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=valid == 0), column], ["doc_id", "ids"])

        current = None
        for b in batches:
            for key, part, blob in zip(b.column("chunk").to_pylist(), b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if key != current:
                    yield from finish()
                    held, fills, current = [], [], key
                if part:
                    fills.append(_unpacked(blob, np.uint32, np.uint32, np.uint32))
                else:
                    held.append(blob)
        yield from finish()

    schema = "chunk long, part int, blob binary"
    rest = rows.mapInArrow(tidied(others), schema).repartition(max(partitions(spark), buckets // 2), "part").mapInArrow(tidied(once), schema)
    both = rows.mapInArrow(tidied(pack), schema).unionByName(rest)
    return both.repartition("chunk").sortWithinPartitions("chunk", "part"), merge, vocabulary


def _numbered(words: list[list[str]], number: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(number.get, chain.from_iterable(words), repeat(0)), np.uint32)


def _row(chunk: int, part: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "part", "blob"])


def _packed(*columns: np.ndarray) -> bytes:
    """Columns one after the other, compressed; before them their sizes in bytes."""
    sizes = np.array([c.nbytes for c in columns], "<u4").tobytes()
    return sizes + pa.compress(b"".join(c.tobytes() for c in columns), "zstd", asbytes=True)


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(blob[: 4 * len(kinds)], "<u4").astype(int)
    raw = pa.decompress(blob[4 * len(kinds) :], int(sizes.sum()), "zstd", asbytes=True) if sizes.sum() else b""
    ends = np.cumsum(sizes)
    return [np.frombuffer(raw[e - n : e], k) for e, n, k in zip(ends, sizes, kinds, strict=True)]


def _joined(pieces, at: int):
    """Adds to batches the concatenated pieces of the ids in column number `at`."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces.value
        for b in batches:
            column = b.column(at)
            flat = column.values
            if flat.null_count or column.null_count or len(flat) and not 0 <= flat.to_numpy().min() <= flat.to_numpy().max() < len(piece):
                known = range(len(piece))
                data = [b"".join(piece[i] for i in ids or () if i in known) for ids in column.to_pylist()]
            else:
                numbers, ends = flat.to_numpy(), column.offsets.to_numpy().tolist()
                data = [b"".join(map(piece.__getitem__, numbers[i:j].tolist())) for i, j in zip(ends, ends[1:], strict=False)]
            texts = pa.array([x.decode("utf-8", "replace") for x in data], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "decoded"])

    return join


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with one more column, decoded: the concatenated pieces of its ids."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path or default_vocabulary()).pieces())
    names = [f"c{i}" for i in range(len(encoded.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, encoded.schema, strict=True))
    out = encoded.toDF(*names).mapInArrow(tidied(_joined(pieces, encoded.columns.index(ids_col))), f"{schema}, decoded string")
    return out.toDF(*encoded.columns, "decoded")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return round_trip(docs, stable=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
