"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words' weights (a word's
weight is that of the word and of its four- and six-letter beginnings, hashed); a document's is the noisy-or
of its sentences'. Only documents are labelled; the gradient of the noisy-or deals a document's label out to
the sentences that explain it, and the fitted model then locates the offending sentences.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, running, ship, stash, trim

ship(__name__)

SLOTS = 1 << 18
MEMO_WORDS = 150_000
TOKEN = re.compile(r"\w+|[.!?\n]+")
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+|$)")
#: The fit's bounds: labelled documents, and the characters of all of them together.
SAMPLE_DOCS, SAMPLE_CHARS = 8_000, 1 << 26
#: Words of the sample that a step of the fit sums at a time.
PART = 1 << 19


def slots(word: str) -> tuple[int, int, int]:
    return crc32(b"w" + word.encode()) % SLOTS, crc32(b"4" + word[:4].encode()) % SLOTS, crc32(b"6" + word[:6].encode()) % SLOTS


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def word(self, token: str) -> float:
        """The weight of a lower-case word; NaN for a sentence's end."""
        return float(sum(self.weights[s] for s in slots(token))) if token[0] not in ".!?\n" else float("nan")

    def values(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for t in tokens:
                if t not in memo:
                    memo[t] = self.word(t)
        return np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))

    def score(self, text: str | None) -> float:
        """The chance that the text is toxic: noisy-or over its sentences; that of an empty one without words."""
        v = self.values(TOKEN.findall((text or "").lower()))
        ends = np.isnan(v)
        v[ends] = 0
        starts = np.concatenate([[0], np.flatnonzero(ends) + 1])
        z = np.add.reduceat(np.append(v, 0.0), starts) + self.bias
        return float(-np.expm1(-np.logaddexp(0, z).sum()))

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence."""
        out = []
        for m in SENTENCE.finditer(text or ""):
            if words := [t for t in TOKEN.findall(m[0].lower()) if t[0] not in ".!?\n"]:
                z = self.values(words).sum() + self.bias
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return out


def fit(texts: Iterable[str | None], marks: list[int], epochs: int = 200, least: int = 3, shrink: float = 2e-3, rate: float = 0.15, lowest: float = -0.2) -> Model:
    """Fit by Adam over all bags; weights are kept sparse by soft thresholds. Features of fewer than ``least``
    bags keep no weight; none falls under ``lowest``, so that harmless words can't hide an offending one in their
    sentence. Texts are read once, one by one; marks has their labels by then."""
    names: dict[str, int] = {}
    words, lengths, bag = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        n = 0
        for t in TOKEN.findall((text or "").lower()):
            if t[0] in ".!?\n":
                if n:
                    lengths.append(n)
                    bag.append(d)
                n = 0
            else:
                words.append(names.setdefault(t, len(names)))
                n += 1
        if n or not bag or bag[-1] != d:
            lengths.append(n)
            bag.append(d)
    toxic = np.array(marks, bool)
    if not toxic.any():
        return Model(np.zeros(SLOTS, np.float32), -30.0)
    where = np.array([slots(w) for w in names] or np.zeros((0, 3)), np.int64).reshape(-1, 3)
    words, lengths, bag = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (words, lengths, bag))
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    seen = np.zeros(SLOTS, np.int64)
    bounds = np.searchsorted(bag[sentence], np.arange(len(marks) + 1)) if len(words) else []
    for lo, hi in zip(bounds, bounds[1:], strict=False):  # bag by bag, so that nothing as large as all words is sorted
        seen[np.unique(where[np.unique(words[lo:hi])])] += 1
    many = len(names)
    del names, bounds
    keep = seen >= least
    useful = np.flatnonzero(keep[where].any(axis=1)) if len(where) else np.zeros(0, np.int64)
    dense = np.full(many, -1, np.int32)
    dense[useful] = np.arange(len(useful))
    words = dense[words] if len(words) else words
    sentence, words = sentence[words >= 0], words[words >= 0]
    where, n_bags, n_sent = where[useful], len(toxic), len(lengths)
    parts = [slice(at, at + PART) for at in range(0, len(words), PART)]  # words that are summed at a time: bounds what a step holds
    y, w, b = toxic.astype(np.float64), np.zeros(SLOTS), -6.0
    m, v, mb, vb = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0
    for step in range(1, epochs + 1):
        z, weights = np.full(n_sent, b), w[where].sum(axis=1)
        for part in parts:
            z += np.bincount(sentence[part], weights[words[part]], n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(bag, np.logaddexp(0, z), n_bags)  # -log(1 - score)
        score = np.clip(-np.expm1(-none), 1e-9, 1)
        g = np.where(y > 0, -(1 - score) / score, 1.0)[bag] * p / n_bags
        gw = np.zeros(len(where))
        for part in parts:
            gw += np.bincount(words[part], g[sentence[part]], len(where))
        grad = sum(np.bincount(where[:, j], gw, SLOTS) for j in range(3)) * keep
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fast = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w -= fast * m / (1 - 0.9**step)
        w = np.maximum(np.sign(w) * np.maximum(np.abs(w) - fast * shrink / 10, 0), lowest)
        b -= rate * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    return Model(w.astype(np.float32), float(b))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def sample_of(docs: DataFrame, labels: DataFrame, most: int, chars: int) -> DataFrame:
    """(doc_id, k, text, toxic): labelled documents outside fold 0 in the order of their ids' hashes, at most ``most``,
    each as long as it is, as many as fit ``chars`` characters in all. Labels without a document take no place."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sizes = texts.select("doc_id", F.xxhash64("text").alias("k"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("k")]
    first = sizes.join(known, "doc_id").groupBy("doc_id", "k").agg(F.max("n").alias("n"), F.max("toxic").alias("toxic")).orderBy(*order).limit(most)
    picked, left = [], chars
    for r in first.collect():  # ``most`` rows of four numbers
        if r.n <= left:
            picked.append((r.doc_id, r.k, r.toxic))
            left -= r.n
    picked = docs.sparkSession.createDataFrame(picked, "p_id long, p_k long, toxic int")
    rows = texts.join(F.broadcast(picked), (F.col("doc_id") == F.col("p_id")) & (F.xxhash64("text") == F.col("p_k")))
    return rows.groupBy("doc_id", F.col("p_k").alias("k")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``sample`` labelled documents outside fold 0, of at most ``chars`` characters together, picked by
    the hash of their ids; never on labels of fold 0. The fit runs in one task, so the driver holds no text, only the
    weights.

    A null text is an empty one. Rows without an id have no label. Of several labels of an id the greatest counts;
    rows that repeat are one. A document longer than ``chars`` alone is left out. Without toxic labels nothing scores.
    """
    rows = stash(sample_of(docs, labels, sample, chars), "sample")

    def run(batches):
        marks: list[int] = []

        def texts():
            for b in batches:
                for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    marks.append(y)
                    yield text.as_py()

        model = fit(texts(), marks)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])
        del model
        trim()

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "k").select("text", "toxic")
    with running(docs.sparkSession):
        fitted = one.mapInArrow(run, "weights binary, bias double").collect()
    discard(rows)
    if not fitted:
        return Model(np.zeros(SLOTS, np.float32), -30.0)
    return Model(np.frombuffer(fitted[0].weights, np.float32), fitted[0].bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs; null and empty texts have the score of a text without words.

    Repeated rows and null ids each give a row; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # SLOTS floats: 1 MB

    def run(batches):
        mine = Model(*held.value)
        for b in batches:
            p = np.fromiter((mine.score(t.as_py()) for t in b.column(1)), np.float64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])
        del mine
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of the sentences whose own score is at least ``least``; null and empty texts have
    none, and rows without an id are left out, as their sentences couldn't be told apart. Repeated rows repeat their
    sentences; texts of any length are searched whole; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(frames):
        mine = Model(*held.value)
        for pdf in frames:
            rows = [(i, a, z, p) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for a, z, p in mine.sentences(t) if p >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "score"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, start long, end long, score double")


def judged(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; a null id is never held out."""
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without the toxic ones; all columns stay, whatever their names. Scored in place, so no join carries the
    texts. A null or empty text has the score of one without words; rows without an id, and rows that repeat, are
    judged each by its text, however long."""
    held, at = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias)), docs.columns.index("text")

    def run(batches):
        mine = Model(*held.value)
        for b in batches:
            yield b.filter(pa.array([mine.score(t.as_py()) < least for t in b.column(at)], pa.bool_()))
        del mine
        trim()

    return docs.mapInArrow(run, docs.schema)
