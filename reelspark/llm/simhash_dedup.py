"""SimHash near-dedup: fingerprints, then a grid range-join in a segment-popcount embedding.

A fingerprint maps to the bit counts of its 32 two-bit segments. The Manhattan distance of two count vectors
never exceeds the Hamming distance of the fingerprints, so a join within Manhattan distance 2 loses no link.
The 32 coordinates lie in five blocks; a distance of at most 2 leaves at least three blocks equal, so the grid
has one layer for each choice of three blocks and a cell is the exact counts there. Cells are joined within,
the Manhattan bound is tested on the counts (unary-coded, so it is one xor and popcount), and the Hamming
distance decides. A cell of more than ``cell_limit`` distinct fingerprints isn't paired up: its members differ
only in the segments of the two free blocks, so each is keyed by itself with every two free bits masked out,
and every key links its members to the smallest. That finds the same links' components in linear rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, one_of_each, ship, stash, trim

ship(__name__)

#: Segments (of two bits) in each of the five blocks.
BLOCKS = (7, 7, 6, 6, 6)
ODD = 0x5555555555555555


def simhash(text: bytes | None, width: int = 3) -> int:
    """64-bit majority of XXH64 (seed 42) over word shingles; ASCII lower case; 0 for no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n, digest, join = len(words) - width + 1, xxhash.xxh64_intdigest, b" ".join

    def hashes():
        for at in range(0, n, 1 << 15):
            part = words[at : at + (1 << 15) + width - 1]
            shingles = map(join, zip(*(part[i:] for i in range(width)), strict=False))
            yield np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(part) - width + 1)

    return majority(hashes(), n)


def majority(parts, n: int) -> int:
    """The bits that are set in over half of n hashes, which come in parts."""
    total = np.zeros(64, np.int64)
    for h in parts:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp long) for every row; a null or empty text has fingerprint zero. hashed: k, xxhash64 of the
    text, too."""
    names = ["doc_id", "fp", "k"][: 2 + hashed]

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.fromiter((simhash(t.as_py()) for t in texts), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=names)
        trim()

    rows = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k")]
    return docs.select(rows[: 2 + hashed]).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """The 32 segment counts, each in unary code on its segment's two bits."""
    low, high = fp.bitwiseAND(_signed(ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(_signed(ODD))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def layers() -> list[tuple[int, list[int]]]:
    """For each grid layer: the mask of its three fixed blocks, and the free bit positions."""
    starts, at = [], 0
    for n in BLOCKS:
        starts.append(range(2 * at, 2 * (at + n)))
        at += n
    out = []
    for fixed in combinations(range(5), 3):
        mask = sum(1 << bit for k in fixed for bit in starts[k])
        out.append((mask, [bit for k in range(5) if k not in fixed for bit in starts[k]]))
    return out


def links(fps: DataFrame, most: int = 2, cell_limit: int = 200) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fps within ``most`` (2 at most) bits."""
    if not 0 <= most <= 2:
        raise ValueError("the grid of five blocks serves distances of 0 to 2")
    grid = layers()
    keyed = fps.select("fp", embedding(F.col("fp")).alias("u")).select(
        "fp", "u", F.posexplode(F.array(*(F.col("u").bitwiseAND(_signed(m)) for m, _ in grid))).alias("layer", "cell")
    )
    sizes = stash(keyed.groupBy("layer", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    held = keyed.join(sizes, ["layer", "cell"])
    small = held.where(F.col("n") <= cell_limit).select("layer", "cell", "fp", "u")
    other = small.select("layer", "cell", F.col("fp").alias("fp2"), F.col("u").alias("u2"))
    near = (
        (F.col("fp") < F.col("fp2"))
        & (F.bit_count(F.col("u").bitwiseXOR(F.col("u2"))) <= most)
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most)
    )
    same = (small["layer"] == other["layer"]) & (small["cell"] == other["cell"])
    pairs = small.join(other, same & near).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    if not sizes.where(F.col("n") > cell_limit).limit(1).count():
        return _of(sizes, pairs.distinct())
    masks = [(k, _signed(~(1 << x | 1 << y) & (1 << 64) - 1)) for k, (_, free) in enumerate(grid) for x, y in combinations(free, 2)]
    masks = F.broadcast(fps.sparkSession.createDataFrame(masks, "layer int, mask long"))  # some 3000 rows, always
    big = held.where(F.col("n") > cell_limit).select("layer", "fp")
    starred = big.join(masks, "layer").select("layer", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp")
    key = ["layer", "mask", "rest"]
    centres = starred.groupBy(key).agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    star = starred.join(centres, key).where("fp <> a").select("a", F.col("fp").alias("b"))
    if most < 2:
        star = star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return _of(sizes, pairs.union(star).distinct())


def _of(stashed: DataFrame, out: DataFrame) -> DataFrame:
    """out, to be discarded with the stash that it reads."""
    out._stashed_at = stashed._stashed_at
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Nulls: a null or empty text has fingerprint zero and links like any other; a null id is kept but never
    names a component (null where its whole component has no id). Repeated rows each give a row. Other columns
    are ignored. An empty table gives no rows.
    """
    prints = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(prints, most)
    named = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    classes = stash(rooted.join(named, "root").select("fp", "component_id"), "classes")
    discard(rooted, named)
    named = classes
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(prints: DataFrame, most: int) -> DataFrame:
    """(fp, first, root): each distinct fingerprint with its least id and its component."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = links(classes.select("fp"), most)
    roots = components(linked)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = stash(rooted, "rooted")
    discard(linked, roots)
    return rooted


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id stays (of rows that
    repeat this id, the least by a hash of the text); rows without an id stay."""
    prints = stash(fingerprints(docs, id_col, text_col, hashed=True), "fingerprints")
    rooted = _rooted(prints, most)
    rows = stash(prints.join(rooted, "fp").select("doc_id", "k", "root"), "groups")
    discard(prints, rooted)
    return one_of_each(docs, rows, id_col, text_col)
