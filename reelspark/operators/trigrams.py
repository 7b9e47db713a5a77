"""Substring search by trigram signatures: blocks of rows that can't hold a pattern are never read.

The searched columns of what a task reads of each bucket lie sorted by folder and name, in blocks of BLOCK rows. A block's signature is a bitmap
of BITS bits in which each run of three characters of any of its texts (ASCII lower case) sets one. A pattern's literal
pieces must stand in one text, so all their trigrams' bits must be set; a block that lacks one holds no match. What
is left is decided by LIKE. Patterns without a piece of three characters rule nothing out.
"""

from __future__ import annotations

import re
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UPPER, fold, like
from ..schema import SEARCHED
from ..sources.derived import Derived
from ..sources.store import Snapshot, Transaction

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Rows of a block, bits of a signature, and blocks that are named to the scan rather than joined with it.
BLOCK, BITS, NAMED = 256, 1 << 15, 2000


def _blocked(videos: DataFrame) -> DataFrame:
    """(part, block, file_id, searched columns) in blocks that lie together: each task sorts the rows that it reads, so no text
    moves, and a block's number holds its bucket, the task and its place there."""
    texts = [c for c in SEARCHED if c in videos.columns]
    rows = videos.select("part", "file_id", *texts).sortWithinPartitions("part", "folder_path", "file_name", "file_id")
    place = F.monotonically_increasing_id()  # 33 bits of a task's rows, the task above
    block = F.shiftleft(F.col("part").cast("long"), 48) + F.shiftleft(F.shiftright(place, 33), 28) + F.floor(place.bitwiseAND((1 << 33) - 1) / BLOCK)
    return rows.select("part", block.alias("block"), "file_id", *texts)


def _signatures(rows: DataFrame) -> DataFrame:
    """(part, block, bits map<int, long>): the words of the bitmap that have a bit set. rows: the stored blocks; a task makes
    one bitmap of all that it reads of a block."""

    def words(block: int, bits: np.ndarray) -> pa.RecordBatch:
        held = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(held)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["block", "word", "mask"])

    def run(batches):
        block, bits = None, np.zeros(size, np.uint8)
        for b in batches:
            for at, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if at != block:
                    if block is not None:
                        yield words(block, bits)
                    block, bits = at, np.zeros(size, np.uint8)
                bits[row.values.to_numpy()] = 1
        if block is not None:
            yield words(block, bits)

    size = BITS
    texts = F.array_distinct(F.array(*(fold(F.col(c)) for c in rows.columns if c in SEARCHED)))
    grams = F.flatten(F.transform(F.filter(texts, lambda t: F.length(t) > 2), lambda t: F.regexp_extract_all(t, F.lit("(?s)(?=(.{3}))"), 1)))
    hashed = F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BITS)).cast("int")))
    # a block that several tasks read has words from each
    held = rows.select("block", hashed.alias("bits")).mapInArrow(run, "block long, word int, mask long").groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))
    return held.groupBy(F.shiftright("block", 48).cast("int").alias("part"), "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("bits"))


class Signed(Derived):
    """Signatures of stored blocks, which are brought up to date first."""

    def stale(self, t: Snapshot) -> dict[int, str]:
        return super().stale(t) | TEXTS.stale(t)

    def refresh(self, t: Transaction) -> list[int]:
        TEXTS.refresh(t)
        return super().refresh(t)


#: The two tables: the blocks are kept up with the catalogue's buckets, the signatures with the blocks.
TEXTS = Derived("searched", ["videos"], _blocked, **{"parquet.block.size": 1 << 20})
SIGNATURES = Signed("grams", ["searched"], _signatures)


def grams_of(pattern: str) -> set[str]:
    """The trigrams that every text with this LIKE pattern in it holds."""
    pieces = re.split("[%_]", pattern.translate(str.maketrans(UPPER, UPPER.lower())))
    return {p[i : i + 3] for p in pieces for i in range(len(p) - 2)}


def _bit(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % BITS


def blocks_for(t: Snapshot, pattern: str) -> DataFrame:
    """(block) of the blocks that may hold the pattern."""
    tests = [F.coalesce(F.try_element_at("bits", F.lit(b >> 6)), F.lit(0).cast("long")).bitwiseAND(F.expr(f"shiftleft(1L, {b & 63})")) != 0 for b in sorted({_bit(g) for g in grams_of(pattern)})]
    return SIGNATURES.read(t).where(reduce(Column.__and__, tests, F.lit(True))).select("block")


def files_like(t: Snapshot, query: str) -> DataFrame:
    """(file_id) of the files with the pattern %query% in any searched column."""
    pattern = f"%{query.strip()}%"
    blocks, rows = blocks_for(t, pattern), TEXTS.read(t)
    some = blocks.limit(NAMED + 1).collect()  # few: named to the scan, which skips row groups
    rows = rows.where(F.col("block").isin([r.block for r in some])) if len(some) <= NAMED else rows.join(blocks, "block", "left_semi")
    return rows.where(reduce(Column.__or__, (F.coalesce(like(F.col(c), pattern), F.lit(False)) for c in rows.columns[2:]))).select("file_id")


def text_filter(t: Snapshot, videos: DataFrame, query: str, video_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """Files with the pattern %query% in any searched column or in the name of one of their labels."""
    named = video_labels.join(labels.where(like(F.col("name"), f"%{query.strip()}%")), video_labels["label_id"] == labels["id"], "left_semi")
    return videos.join(files_like(t, query).unionByName(named.select("file_id")), "file_id", "left_semi")
