"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is a stretch of text up to . ! ? ; or a line's end. Its words are read as
classes, and five transducers are composed into the one that runs over them:
* insult: an insult is marked where it has other words beside it;
* threat: a word of violence is marked in the same way;
* target: guesses at the clause's start whether it addresses somebody and marks what it
  says then; the guess holds only if a target does come;
* negation: turns a mark into a negated one up to REACH words after a negation, with a
  weight that falls with the distance, or else leaves it as it is;
* reported speech: turns marks after a verb of saying into reported ones.
What comes out for each insult or threat is the pattern it stands in (plain, targeted,
negated or reported) and the clause's weight. A document's score is a logistic model of
the strengths of its matched patterns and of how dense insults are in it: the same match
weighs less in a long text. A word alone in its clause matches nothing, and a word
outside of patterns adds nothing.

The insult transducer's entries (words, and stems that many words begin with, with
weights) are learned from the labels, by the log odds of documents with them, on at most
SAMPLE labelled rows. So are the patterns' weights, around prior ones that hold where
the labels say nothing (a corpus without threats says nothing of threats). The closed
classes (targets, negations, verbs of saying and of violence) are a parameter.

Defined results:
* null text is the empty text; all texts without a matched clause, the empty one
  included, have one score, that of no match;
* rows without a label, or with a null one, are scored like all others; of several
  labels of one document the largest counts; labels of held-out documents are unused;
* without any label, or with labels of one kind only, every score is 0;
* repeated rows get equal scores; an empty table gives an empty result; other columns
  are never read for a score, and may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm.common import field as name_of, packed, text_of, unpacked, written
from lakeprobe.llm.transducer import Transducer

#: Labelled rows that the grammar is fitted on, at most; those with the smallest hash of their id.
SAMPLE = 20_000
#: An entry occurs in so many toxic sample documents at least, with so large log odds.
LEAST_DOCUMENTS, LEAST_LOG_ODDS = 8, 2.0
#: Lengths of word beginnings that can be entries, and the words that one must be the beginning of: so many, none with more than half of its documents.
BEGINNINGS, LEAST_WORDS = range(3, 10), 6
#: Words after a negation that it reaches.
REACH = 3
#: Words longer than this are noise: they are no entry and match none.
LONGEST = 64
THRESHOLD = 0.3

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE_END = re.compile(r"[.!?;\n]")
PATTERNS = ("plain", "targeted", "negated", "reported")
#: What a pattern adds to the log odds per unit of strength before any label is seen: insults, then threats.
PRIOR = {"I": {"plain": 2.0, "targeted": 3.0, "negated": 0.5, "reported": 1.0}, "H": {"plain": 1.0, "targeted": 6.0, "negated": 0.5, "reported": 1.0}}
NAMES = [f"{c}.{p}" for c in PRIOR for p in PATTERNS] + ["strongest", "density"]


@dataclass(frozen=True)
class Lexicon:
    """The closed classes of words, in the four languages of the tables."""

    targets: frozenset[str] = field(default_factory=lambda: frozenset("you your yours u ya du dich dir dein deine euch ihr sie ihre tu toi te vous ton ta tes votre vos usted ustedes vosotros ti tus".split()))
    negations: frozenset[str] = field(default_factory=lambda: frozenset("not never no isn't aren't don't won't cannot nicht kein keine nie niemals pas jamais aucun non nunca ni tampoco".split()))
    reports: frozenset[str] = field(default_factory=lambda: frozenset("said says saying wrote quoted reported called sagte sagt schrieb nannte dit disait écrit dijo dice escribió".split()))
    threats: frozenset[str] = field(default_factory=lambda: frozenset("kill hurt destroy attack murder beat stab töten umbringen zerstören schlagen tuer frapper détruire matar destruir golpear".split()))

    def classes(self) -> dict[str, str]:
        """The class of each word: T, N, R or H."""
        return {w: c for c, words in zip("TNRH", (self.targets, self.negations, self.reports, self.threats), strict=True) for w in words}


SYMBOLS = "OITNRH"


def _same(state, symbols, to=None) -> dict:
    return {(state, s): [(s, 1.0, state if to is None else to)] for s in symbols}


def insults() -> Transducer:
    """I to (I, plain); the words beside it are left."""
    return Transducer([0], [0], _same(0, SYMBOLS) | {(0, "I"): [(("I", "plain"), 1.0, 0)]})


def threats() -> Transducer:
    """H to (H, plain)."""
    rest = [*SYMBOLS.replace("I", ""), ("I", "plain")]
    return Transducer([0], [0], _same(0, rest) | {(0, "H"): [(("H", "plain"), 1.0, 0)]})


def target() -> Transducer:
    """In a clause with a target, plain to targeted, before the target as well as after it.

    State `none` takes no target. State `hoped` is the guess that one will come; it is
    not final, so a path through it counts only if it has gone on to `there`.
    """
    words, marks = "OTNR", [("I", "plain"), ("H", "plain")]
    arcs = _same("none", words.replace("T", "")) | _same("none", marks)
    for state in ("hoped", "there"):
        arcs |= _same(state, words.replace("T", "")) | {(state, m): [((m[0], "targeted"), 1.0, state)] for m in marks} | {(state, "T"): [("T", 1.0, "there")]}
    return Transducer(["none", "hoped"], ["none", "there"], arcs)


def negation() -> Transducer:
    """Marks up to REACH words after a negation to negated, with weights 1, 1/2, 1/3...; they lose what they were."""
    words, marks = "OTR", [(c, p) for c in "IH" for p in ("plain", "targeted")]
    arcs = {}
    for n in range(REACH + 1):  # n: words that the negation still reaches
        after = max(n - 1, 0)
        arcs |= _same(n, words, after) | {(n, "N"): [("N", 1.0, REACH)]}
        arcs |= {(n, m): [((m[0], "negated"), 1 / (REACH + 1 - n), after)] if n else [(m, 1.0, 0)] for m in marks}
    return Transducer([0], range(REACH + 1), arcs)


def reported() -> Transducer:
    """Marks after a verb of saying to reported."""
    words, marks = "OTN", [(c, p) for c in "IH" for p in ("plain", "targeted", "negated")]
    arcs = _same(0, words) | _same(0, marks) | {(0, "R"): [("R", 1.0, 1)], (1, "R"): [("R", 1.0, 1)]}
    return Transducer([0], [0, 1], arcs | _same(1, words) | {(1, m): [((m[0], "reported" if m[1] != "negated" else "negated"), 1.0, 1)] for m in marks})


GRAMMAR = insults() @ threats() @ target() @ negation() @ reported()


def read_clause(classes: str) -> tuple[list, float]:
    """Run the composed transducer over the classes of a clause: what each word became, and the clause's weight.

    >>> read_clause("OIT")
    (['O', ('I', 'targeted'), 'T'], 1.0)
    >>> read_clause("NOI")
    (['N', 'O', ('I', 'negated')], 0.5)
    """
    return GRAMMAR.run(classes)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the checksum of the id as text leaves the remainder `part`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


class Grammar:
    """Insult entries (a trailing * marks a stem) with weights, closed classes, and the patterns' weights in the score."""

    def __init__(self, entries: dict[str, float], coef: np.ndarray | None = None, lexicon: Lexicon | None = None):
        self.entries, self.coef = entries, coef
        self.closed = (lexicon or Lexicon()).classes()
        self.words = {e: w for e, w in entries.items() if not e.endswith("*")}
        self.starts = {e[:-1]: w for e, w in entries.items() if e.endswith("*")}
        self.lengths = sorted({len(e) for e in self.starts}, reverse=True)
        self._automaton = None
        self._read: dict[str, tuple] = {}

    def automaton(self):
        """Finds every insult and threat in one reading of a text; made once in each process."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e in {*self.words, *self.starts, *(w for w, c in self.closed.items() if c == "H")}:
                self._automaton.add_word(e, len(e))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None, "_read": {}}

    def classify(self, word: str) -> tuple[str, float]:
        """The class of a word and its weight."""
        if len(word) <= LONGEST:
            if word in self.words:
                return "I", self.words[word]
            if word in self.closed:
                return self.closed[word], 1.0
            for n in self.lengths:
                if len(word) > n and word[:n] in self.starts:
                    return "I", self.starts[word[:n]]
        return "O", 0.0

    def read(self, clause: str) -> list[tuple[str, str, float]]:
        """(class, pattern, strength) of each match of a clause in lower case."""
        known = [self.classify(w) for w in WORD.findall(clause)]
        classes = "".join(c for c, _ in known)
        if len(classes) < 2:
            return []
        if len(classes) > 64 or classes not in self._read:
            if len(self._read) > 50_000:
                self._read.clear()
            self._read[classes] = read_clause(classes)
        out, weight = self._read[classes]
        return [(*o, w * weight) for o, (_, w) in zip(out, known, strict=True) if isinstance(o, tuple)]

    def matches(self, text: str) -> list[tuple[str, str, float]]:
        """The matches of all clauses that hold an insult or a threat; each clause is read once."""
        low, out, done = text.lower(), [], 0
        if not len(self.automaton()):
            return out
        for end, length in self.automaton().iter(low):
            start = end - length + 1
            if start < done or start and low[start - 1].isalnum():
                continue
            a = max(low.rfind(c, done, start) for c in ".!?;\n") + 1
            found = CLAUSE_END.search(low, start)
            b = found.start() if found else len(low)
            out += self.read(low[max(a, done) : b])
            done = b
        return out

    @staticmethod
    def summary(found: list[tuple[str, str, float]], length: int) -> list[float]:
        """Strengths of the matched patterns, the strongest insult or targeted threat and the insults per hundred characters; all 0 without a match."""
        per = dict.fromkeys(NAMES, 0.0)
        for c, p, w in found:
            per[f"{c}.{p}"] += w
        direct = [w for c, p, w in found if p == "targeted" or (c, p) == ("I", "plain")]
        insults = sum(w for c, p, w in found if c == "I" and p in ("plain", "targeted"))
        values = {k: math.log2(1 + v) for k, v in per.items()}
        return list((values | {"strongest": max(direct, default=0.0), "density": insults * 100 / (length + 200)}).values())

    def features(self, text: str) -> list[float]:
        """What a text's score is made of."""
        return self.summary(self.matches(text), len(text))

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of the label 1."""
        if self.coef is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ self.coef[1:] + self.coef[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients (constant first) of a logistic regression by Newton's method, drawn to the prior ones."""
    z = np.hstack([np.ones((len(x), 1)), x])
    center = np.concatenate([[0.0], prior])
    coef, penalty = center.copy(), np.diag([1e-6] + [ridge] * x.shape[1])
    coef[0] = -4.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ (coef - center))
        coef += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return coef


def prior_weights() -> np.ndarray:
    """The prior weight of each feature."""
    return np.array([PRIOR[n[0]][n[2:]] if n[1:2] == "." else 0.0 for n in NAMES])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Written rows (text, y) of at most SAMPLE labelled training documents; the ids chosen are broadcast, not the texts."""
    chosen = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .filter(~held_out())
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max("toxic").cast("int").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(SAMPLE)
    )
    return written(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "y"), "toxic-sample")


def count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label with each word or word beginning."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = {w for w in WORD.findall(text.lower()) if len(w) <= LONGEST}
            counts[y > 0].update(words)
            counts[y > 0].update({f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n})
    keys = list({**counts[0], **counts[1]})
    for i in range(0, len(keys), 100_000):
        part = keys[i : i + 100_000]
        columns = [pa.array(part, pa.string()), pa.array([counts[1][k] for k in part], pa.int64()), pa.array([counts[0][k] for k in part], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["entry", "toxic", "clean"])


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def choose_entries(rows: list, toxic: int, clean: int) -> dict[str, float]:
    """Words and stems with their log odds. rows: entry, toxic, clean and, of a stem, `words` and `most` (its words, and the documents of the commonest).

    A stem must be shared by many words, and says nothing a shorter one says as well; a
    word must say more than its stems.
    """
    odds = {r["entry"]: log_odds(r["toxic"], r["clean"], toxic, clean) for r in rows}
    out: dict[str, float] = {}
    for r in sorted((r for r in rows if r["entry"].endswith("*")), key=lambda r: (len(r["entry"]), r["entry"])):
        e = r["entry"]
        best = max((out.get(f"{e[:n]}*", 0.0) for n in range(1, len(e) - 1)), default=0.0)
        if r["words"] >= LEAST_WORDS and 2 * r["most"] <= r["toxic"] and odds[e] > best + (0.5 if best else 0):
            out[e] = odds[e]
    for e in sorted(e for e in odds if not e.endswith("*")):
        if odds[e] > max((out.get(f"{e[:n]}*", 0.0) for n in range(1, len(e))), default=0.0) + 0.5:
            out[e] = odds[e]
    return out


def found_entries(rows: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The entries of large log odds, and for stems how many words of toxic documents begin so and how often the commonest of them occurs."""
    counts = written(rows.mapInArrow(count_entries, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-entries")
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    chosen = counts.filter((F.col("toxic") >= LEAST_DOCUMENTS) & (odds >= LEAST_LOG_ODDS))
    is_stem = F.col("entry").endswith("*")
    words = counts.filter(~is_stem & (F.col("toxic") > 0)).select(F.col("entry").alias("word"), F.col("toxic").alias("n"))
    starts = words.select("n", F.explode(F.transform(F.lit(list(BEGINNINGS)), lambda k: F.when(F.length("word") > k, F.concat(F.substr("word", F.lit(1), k), F.lit("*"))))).alias("entry")).filter("entry IS NOT NULL")
    shared = starts.groupBy("entry").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most"))
    return chosen.join(shared, "entry", "left").fillna(0, ["words", "most"])


def fit(docs: DataFrame, labels: DataFrame, lexicon: Lexicon | None = None) -> Grammar:
    """A grammar learned from the labels of at most SAMPLE training documents."""
    rows = sample(docs, labels)
    counts = {r["y"] > 0: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Grammar({}, lexicon=lexicon)
    # an entry has LEAST_DOCUMENTS of SAMPLE documents at least: few words do, whatever the corpus
    entries = choose_entries(found_entries(rows, counts[True], counts[False]).collect(), counts[True], counts[False])
    top = max(entries.values(), default=1.0)
    grammar = Grammar({e: w / top for e, w in entries.items()}, lexicon=lexicon)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [grammar.features(t) for t in batch["text"]]})

    table = rows.mapInPandas(featured, "y int, x array<double>").toArrow().to_pandas()
    grammar.coef = logistic(np.array(table["x"].tolist()), (table["y"].to_numpy() > 0).astype(float), prior_weights())
    return grammar


MATCHES = "array<struct<kind:string,pattern:string,strength:double>>"


def scored(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The rows of docs as a struct `doc`, with their score and their matches, for reports; no name of docs can clash."""
    rows = packed(docs).select("doc", text_of(name_of(docs, text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            every = [grammar.matches(t) for t in texts]
            x = np.array([grammar.summary(m, len(t)) for m, t in zip(every, texts, strict=True)], dtype=float).reshape(len(texts), len(NAMES))
            found = [[dict(zip(("kind", "pattern", "strength"), m, strict=True)) for m in matches] for matches in every]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("pattern", pa.string()), ("strength", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(grammar.score(x), pa.float64()), pa.array(found, kind)], ["doc", "score", "matches"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, score double, matches {MATCHES}")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected as toxic, with the columns of docs."""
    return unpacked(scored(docs, fit(docs, labels)).filter(F.col("score") < threshold), docs)


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision for every document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels)).select(F.col("doc.c0").alias("doc_id"), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
