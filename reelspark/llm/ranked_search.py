"""Ranked lexical search of a table of items over a table of documents: a threshold-seeded join.

Items go out in waves, bounded in items and in terms; a wave is a stated query set against all documents. Documents are
first reduced to the wave's terms: one row a document with its length, the terms it holds and how often (written once). From
that come, over all documents, each term's document frequency, its greatest impact and its kth impact, which are
stored. At least k documents score what a term's kth impact is worth to an item, so the largest of these bounds the item's
kth score from below before any document is scored. An item's terms are then ordered by the most that they can add; as
soon as what all the remaining terms could add together stays under the threshold, documents that hold none of the terms
before can't be among the k best: only those first terms' postings make candidates. Candidates whose sum with that
remainder still falls short go, the others are scored exactly over all terms. A task's own k best raise its thresholds.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, portions, ship, stash, trim

ship(__name__)

#: Items of a wave, and distinct terms that its items hold together.
WAVE, WAVE_TERMS = 4096, 1 << 18
#: Documents that are searched together; after each such slice a task's thresholds may rise.
SLICE = 2048
#: ASCII letters in lower case and digits stay, other ASCII characters part terms, all others belong to terms.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def counted(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for w in words:
        out[w] = out.get(w, 0) + 1
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's occurrences in a document come to, without its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def dealt(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, wave, place, item_id, held array<binary>, often array<int>) of items with terms, place unique within the wave."""
    names = ["wave", "place", "item_id", "held", "often"]
    kind = dict(items.dtypes)[id_col]

    def run(batches):
        wave = place = size = 0
        for whole in batches:
            for b in portions(whole, 1):
                rows = []
                for i, t in enumerate(b.column(1).cast(pa.large_binary())):
                    held = counted(terms(t.as_py()))
                    if not held:
                        continue
                    if place and (place >= WAVE or size + len(held) > WAVE_TERMS):
                        wave, place, size = wave + 1, 0, 0
                    rows.append((i, wave, place, list(held), list(held.values())))
                    place, size = place + 1, size + len(held)
                at, waves, places, held, often = zip(*rows, strict=True) if rows else ([],) * 5
                ids = b.column(0).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(waves, pa.int32()), pa.array(places, pa.int32()), ids, pa.array(held, pa.list_(pa.binary())), pa.array(often, pa.list_(pa.int32()))], names=names)

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    out = rows.repartition(max(1, math.ceil(items.count() / WAVE))).mapInArrow(run, f"wave int, place int, item_id {kind}, held array<binary>, often array<int>")
    return out.withColumn("part", F.spark_partition_id())


def forward_index(docs: DataFrame, id_col: str, text_col: str, number) -> DataFrame:
    """(doc_id, n, t array<int>, tf array<int>) of documents with terms: their length and their terms among those of
    ``number``, a broadcast {term: number}."""
    names = ["doc_id", "n", "t", "tf"]

    def run(batches):
        known = number.value
        for whole in batches:
            for b in portions(whole, 1):
                at, sizes, t, tf, ends = [], [], [], [], [0]
                for i, text in enumerate(b.column(1).cast(pa.large_binary())):
                    words = terms(text.as_py())
                    if words:
                        held = counted(list(filter(known.__contains__, words)))
                        at.append(i)
                        sizes.append(len(words))
                        t.extend(map(known.__getitem__, held))
                        tf.extend(held.values())
                        ends.append(len(t))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (t, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(sizes, pa.int64()), *lists], names=names)
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, t array<int>, tf array<int>")


def postings(b: pa.RecordBatch, documents: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, saturated count) of a batch of the forward index."""
    n = b.column(1).to_numpy()
    row = np.repeat(np.arange(len(n)), b.column(2).value_lengths().to_numpy())
    t, tf = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
    m = 75 + (25 * n * documents) // words
    return row, t, saturated(tf, m[row])


def impacts(index: DataFrame, n_terms: int, documents: int, words: int, k: int) -> DataFrame:
    """(t, df, top, kth): the documents that hold each term, and the greatest and the kth greatest saturated count over
    all of them (0 where fewer hold it). Each task first keeps its own k greatest."""

    def run(batches):
        df, best = np.zeros(n_terms, np.int64), np.zeros((0, 2), np.int64)
        for b in batches:
            _, t, q = postings(b, documents, words)
            df += np.bincount(t, minlength=n_terms)
            both = np.concatenate([best, np.stack([t, q], axis=1)])
            both = both[np.lexsort((-both[:, 1], both[:, 0]))]
            starts = np.flatnonzero(np.append(True, np.diff(both[:, 0]) != 0)) if len(both) else np.zeros(0, np.int64)
            place = np.arange(len(both)) - np.repeat(starts, np.diff(np.append(starts, len(both))))
            best = both[place < k]
        held = np.flatnonzero(df)
        ends = np.searchsorted(best[:, 0], np.append(held, n_terms)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held]), pa.ListArray.from_arrays(pa.array(ends), pa.array(best[:, 1]))], names=["t", "df", "q"])
        trim()

    best = lambda lists: F.slice(F.sort_array(F.flatten(F.collect_list(lists)), False), 1, k)
    parts = index.mapInArrow(run, "t int, df long, q array<long>").withColumn("some", F.spark_partition_id() % 64)
    some = parts.groupBy("t", "some").agg(F.sum("df").alias("df"), best("q").alias("q"))
    whole = some.groupBy("t").agg(F.sum("df").alias("df"), best("q").alias("q"))
    return whole.select("t", "df", F.col("q")[0].alias("top"), F.coalesce(F.try_element_at("q", F.lit(k)), F.lit(0)).alias("kth"))


def seeded(held: list[int], often: list[int], stats: dict[int, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
    """(terms, worths, rests, threshold) of an item: terms by what they can add at most, the most first; a worth is the
    weight times the item's count; rests[e] is what the terms from place e on can add together. None: no document
    can score."""
    rows = [(c * w * top, t, c * w, c * w * kth) for t, c in zip(held, often, strict=True) if t in stats for w, top, kth in [stats[t]] if w * top > 0]
    if not rows:
        return None
    rows.sort(key=lambda r: (-r[0], r[1]))
    most, t, worths, kth = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return t, worths, np.cumsum(most[::-1])[::-1], max(1, int(kth.max()))


def _best(wave, n_terms: int, documents: int, words: int, k: int):
    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        floor = {p: x[3] for p, x in wave.value.items()}
        worth = np.zeros(n_terms, np.int64)
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            row, t, q = postings(b, documents, words)
            ids = b.column(0)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            sizes = b.column(2).value_lengths().to_numpy()
            begin = np.cumsum(sizes) - sizes
            order = np.argsort(t, kind="stable")
            by_row, by_q = row[order], q[order]
            edge = np.searchsorted(t[order], np.arange(n_terms + 1)).tolist()
            sums = np.zeros(b.num_rows, np.int64)
            for place, (some, worths, rests, _) in wave.value.items():
                essential = int(np.count_nonzero(rests >= floor[place]))
                rest = int(rests[essential]) if essential < len(rests) else 0
                for x, w in zip(some[:essential].tolist(), worths[:essential].tolist(), strict=True):
                    lo, hi = edge[x], edge[x + 1]
                    if lo < hi:
                        sums[by_row[lo:hi]] += w * by_q[lo:hi]
                cand = np.flatnonzero((sums > 0) & (sums + rest >= floor[place]))
                sums[:] = 0
                if not len(cand):
                    continue
                worth[some] = worths
                n = sizes[cand]
                at = np.repeat(begin[cand] - np.cumsum(n) + n, n) + np.arange(n.sum())
                score = np.add.reduceat(worth[t[at]] * q[at], np.cumsum(n) - n)
                worth[some] = 0
                good = score >= floor[place]
                cand, score = cand[good], score[good]
                if place in best:
                    held = best[place]
                    mine = [np.concatenate(x) for x in zip(held, (score, ids[cand], known[cand]), strict=True)]
                else:
                    mine = [score, ids[cand], known[cand]]
                first = np.lexsort((mine[1], ~mine[2], -mine[0]))[:k]
                best[place] = tuple(x[first] for x in mine)
                if len(first) == k:
                    floor[place] = max(floor[place], int(best[place][0][-1]))
        out = [(np.full(len(x[0]), p), x[1], x[2], x[0]) for p, x in best.items()]
        places, docs, there, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(docs, pa.int64(), mask=~there.astype(bool)), pa.array(scores, pa.int64())], names=["place", "doc_id", "score"])
        trim()

    return run


def ranked(items: DataFrame, docs: DataFrame, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of highest score above 0, ranks from 1, equal scores
    by smaller doc_id; the score is that of saturated term counts, weighted by rarity, all in whole numbers.

    Terms are runs of ASCII letters (in lower case), digits and any other characters beyond ASCII. Nulls and texts
    without terms: such a document scores nothing and isn't counted, such an item has no rows. A document without an
    id ranks after those of its score that have one. Rows that repeat are documents, and items, of their own: an
    item that stands twice is ranked twice. Very long texts are read whole. Other columns are ignored, whatever their
    names. Empty tables give no rows.
    """
    context = docs.sparkSession.sparkContext
    asked = stash(dealt(items, item_col, item_text), "items")
    kind = dict(items.dtypes)[item_col]
    found, totals = [], None
    for part, wave in sorted(map(tuple, asked.select("part", "wave").distinct().collect())):  # a row a wave
        mine = asked.where((F.col("part") == part) & (F.col("wave") == wave))
        rows = mine.select("place", "held", "often").collect()  # one wave: at most WAVE items and about WAVE_TERMS terms
        number: dict[bytes, int] = {}
        for r in rows:
            for w in r.held:
                number.setdefault(bytes(w), len(number))
        index = stash(forward_index(docs, id_col, text_col, context.broadcast(number)), "forward")
        if totals is None:
            totals = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents, words = totals
        if not documents:
            discard(index)
            continue
        stored = stash(impacts(index, len(number), documents, words, k), "impacts")
        stats = {r.t: (weight(documents, r.df), r.top, r.kth) for r in stored.collect()}  # a row a term of the wave
        plans = ((r.place, seeded([number[bytes(w)] for w in r.held], r.often, stats)) for r in rows)
        sent = context.broadcast({p: x for p, x in plans if x is not None})
        best = index.mapInArrow(_best(sent, len(number), documents, words, k), "place int, doc_id long, score long")
        order = Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = mine.select(F.col("place").alias("p"), "item_id")
        found.append(stash(top.join(names, F.col("place") == F.col("p")).select("item_id", "rank", "doc_id", "score"), "ranked"))
        discard(index, stored)
    discard(asked)
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
