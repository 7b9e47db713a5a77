"""Near copies by SimHash and the Jaccard similarity of word shingles: one row of each component stays.

Each set of shingles has a fingerprint, and op1's grid join links those within two bits; what it links is verified on the whole
sets and makes the first components. Sets of similarity 0.8 may lie ten bits apart, more than any grid of fingerprints
reaches, so the exact join goes on from these components and finds the links between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, one_of_each, ship, stash, trim
from .jaccard_join import shingle_sets, similar_sets
from .simhash_dedup import links, majority

ship(__name__)


def prints_of(sets: DataFrame) -> DataFrame:
    """(s, fp): every distinct set's SimHash, the majority of its shingles' hashes bit by bit; zero for an empty one."""

    def run(batches):
        for b in batches:
            held = (x.values.to_numpy().view(np.uint64) for x in b.column(1))
            fps = np.fromiter((majority((h[at : at + (1 << 15)] for at in range(0, len(h), 1 << 15)), len(h)) for h in held), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["s", "fp"])
        trim()

    return sets.select("s", "held").mapInArrow(run, "s long, fp long").distinct()


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets whose fingerprints op1's join links. Each fingerprint stands for its sets by the least, with which
    the others of the same fingerprint are paired."""
    prints = stash(prints_of(sets), "prints")
    least = stash(prints.groupBy("fp").agg(F.min("s").alias("least")), "least")
    linked = links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_s")) for x in ("a", "b")]
    across = linked.join(ends[0], "a").join(ends[1], "b").select(F.least("a_s", "b_s").alias("a"), F.greatest("a_s", "b_s").alias("b"))
    within = prints.join(least, "fp").where("s <> least").select(F.col("least").alias("a"), F.col("s").alias("b"))
    out = stash(across.unionByName(within), "likely")
    discard(linked, prints, least)
    return out


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, hot: int = 64) -> DataFrame:
    """docs without near copies: of each component of rows whose sets of word shingles have a Jaccard similarity
    of ``percent`` or more, the row with the smallest id stays (of rows that repeat this id, the least by a hash
    of the text); rows without an id stay.

    Null and empty texts hold no words and are copies of each other; a text of fewer than ``width`` words is one
    shingle. Other columns are ignored. ``hot``: as for jaccard_join.
    """
    sets = shingle_sets(docs, id_col, text_col, width)
    likely = by_fingerprint(sets)
    roots = similar_sets(sets, percent, hot, likely)
    discard(likely)
    rows = sets.select("doc_id", "k", "s").join(roots, F.col("s") == F.col("node"), "left")
    groups = stash(rows.select("doc_id", "k", F.coalesce("root", "s").alias("root")), "groups")
    discard(sets, roots)
    return one_of_each(docs, groups, id_col, text_col)
