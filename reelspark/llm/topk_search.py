"""Exact top-k inner products by branch and bound on decomposed (columnar) vectors.

Candidates lie in vertical layout, one array a dimension. For a query, dimensions are taken block by block in
falling order of the query's mass; each block adds to the partial scores of the candidates still alive. What
the remaining dimensions can add is at most the product of both remaining norms (Cauchy-Schwarz), so a
candidate whose upper bound is below the k-th best lower bound is compacted away. Scores are exact integers.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stash

ship(__name__)

#: Queries sent to the executors at once: a wave of at most this many vectors is all that is ever broadcast.
WAVE = 4096


def bond(query: np.ndarray, columns: np.ndarray, left: np.ndarray, k: int, floor: int | None, block: int = 8):
    """Positions and exact scores of all candidates that can be among the k best of ``columns`` (dims x n).

    left: squared norms of the candidates; floor: a score below which none counts (k others have as much).
    Norms are compared with a slack that covers their rounding, so no candidate is lost.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    alive, score, rest = None, np.zeros(columns.shape[1], np.int64), left.astype(np.float64)
    q_rest = float((query.astype(np.float64) ** 2).sum())
    for at in range(0, len(order), block):
        dims = order[at : at + block]
        part = columns[dims] if alive is None else columns[np.ix_(dims, alive)]
        score = score + query[dims] @ part
        if at + block >= len(order):
            break
        wide = part.astype(np.float64)
        rest = rest - (wide * wide).sum(axis=0)
        q_rest -= float((query[dims].astype(np.float64) ** 2).sum())
        reach = np.sqrt(np.maximum(rest, 0) * max(q_rest, 0)) * (1 + 1e-9) + 1e-3 + np.abs(left).max(initial=0) * 1e-12
        low = score - reach
        bar = -math.inf if floor is None else float(floor)
        if len(low) > k:
            bar = max(bar, float(np.partition(low, len(low) - k)[len(low) - k]))
        stay = score + reach >= bar
        if not stay.all():
            alive = np.flatnonzero(stay) if alive is None else alive[stay]
            score, rest, left = score[stay], rest[stay], left[stay]
    return (np.arange(columns.shape[1]) if alive is None else alive), score


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the rows whose vector is whole: no null, no non-finite component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return rows.where(sound & F.col("vec_id").isNotNull()).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _search(wave, k: int):
    ids, rows = wave

    def run(frames):
        best: dict[int, list[tuple[int, int]]] = {}
        by_size: dict[int, list[int]] = {}
        for i, q in enumerate(rows.value):
            by_size.setdefault(len(q), []).append(i)
        for pdf in frames:
            for size, some in pdf.groupby(pdf["v"].map(len)):
                wanted = by_size.get(size, [])
                if not wanted:
                    continue
                columns = np.ascontiguousarray(np.array(some["v"].tolist(), np.int64).reshape(len(some), size).T)
                left = (columns.astype(np.float64) ** 2).sum(axis=0)
                vec = some["vec_id"].to_numpy()
                rows_of = dict(zip(*(x.tolist() for x in np.unique(vec, return_counts=True)), strict=True))
                for i in wanted:
                    mine = best.setdefault(i, [])
                    own = ids.value[i]
                    floor = -mine[-1][0] if len(mine) == k else None
                    # the bound must leave room for every row of the query's own id
                    at, score = bond(rows.value[i], columns, left, k + rows_of.get(own, 0), floor)
                    order = np.lexsort((vec[at], -score))
                    new = [(-int(score[j]), int(vec[at[j]])) for j in order[: 2 * k + 2] if vec[at[j]] != own]
                    if len(order) > 2 * k + 2 and len(new) < k:  # the query's id repeats many times
                        new = [(-int(score[j]), int(vec[at[j]])) for j in order if vec[at[j]] != own][:k]
                    best[i] = sorted(mine + new)[:k]
        out = [(int(ids.value[i]), v, -s) for i, found in best.items() for s, v in found]
        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best other rows by integer inner product of
    floor(scale * component); ties to the smaller id.

    Queries are the rows that the column expression ``is_query`` (over vec_id) picks; they go out in waves of
    at most WAVE vectors, each wave a pass over all candidates, so what is broadcast never grows. Rows with
    a null id, a null vector or null or non-finite components take no part; vectors of another length than the
    query's aren't its candidates. Rows that repeat an id: none is a candidate of a query with this id, and of
    such queries one row (the least vector) asks. Other columns are ignored; no queries give no rows.
    """
    rows = quantised(vectors, id_col, vec_col, scale)
    context = rows.sparkSession.sparkContext
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stash(asked.withColumn("n", F.monotonically_increasing_id()), "queries")  # partition, then place there
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    before, starts = 0, []
    for p in asked.groupBy(F.shiftright("n", 33).alias("p")).agg(F.count("*").alias("rows")).orderBy("p").collect():  # a row a partition
        starts += [F.lit(p.p), F.lit(before)]
        before += p.rows
    place = F.col("n").bitwiseAND((1 << 33) - 1)
    number = place + F.try_element_at(F.create_map(*starts), F.shiftright("n", 33)) if starts else place
    found = []
    for at in range(0, max(before, 1), WAVE):
        got = asked.where((number >= at) & (number < at + WAVE)).select("vec_id", "v").collect()  # one wave: at most WAVE rows
        wave = context.broadcast([r[0] for r in got]), context.broadcast([np.array(r[1], np.int64) for r in got])
        some = rows.mapInPandas(_search(wave, k), "query_id long, vec_id long, score long")
        ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(ranked if before <= WAVE else stash(ranked, "wave"))  # waves have their own queries, so each is final
    return reduce(DataFrame.unionByName, found)
