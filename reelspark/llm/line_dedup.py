"""Line dedup: explode normalised lines, hash, count distinct documents a hash, drop lines over the threshold,
and put the rest together again by position.

Lines are hashed once, in the pass that explodes them; what goes is then known by its places, so the second pass
over the texts only leaves lines out.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, portions, ship, stash, trim

ship(__name__)

#: What counts as white space at a line's ends.
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: str, least: int) -> bytes | None:
    """The line stripped and ASCII lower-cased as a 128-bit hash; None for short lines."""
    line = line.strip(BLANK)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= least else None


def row_key(id_column: Column, text: Column) -> tuple[Column, Column]:
    """(k1, k2) of a row: its id, and a hash of its text and of the id's being null. Rows that share both are equal
    in id and text, and lose the same lines."""
    return F.coalesce(id_column, F.lit(-1)).alias("k1"), F.xxhash64(text, id_column.isNull()).alias("k2")


def line_places(rows: DataFrame, least: int = 20) -> DataFrame:
    """(k1, k2, doc_id, key, places array<int>): every distinct long line of every row of (doc_id, text, k1, k2), with
    its places in the text."""
    names = ["k1", "k2", "doc_id", "key", "places"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))

    def run(batches):
        for whole in batches:
            for b in portions(whole, 1):
                out: list[list] = [[] for _ in names]
                for i, text, k1, k2 in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    places: dict[bytes, list[int]] = {}
                    for at, line in enumerate((text.as_py() or "").split("\n")):
                        if (key := line_key(line, least)) is not None:
                            places.setdefault(key, []).append(at)
                    n = len(places)
                    for to, x in zip(out, ([k1] * n, [k2] * n, [i] * n, places, places.values()), strict=True):
                        to.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
        trim()

    return rows.select("doc_id", "text", "k1", "k2").mapInArrow(run, "k1 long, k2 long, doc_id long, key binary, places array<int>")


def dropped_places(rows: DataFrame, least: int, documents: int) -> DataFrame:
    """(k1, k2, gone array<int>): the places of the lines that each row of (doc_id, text, k1, k2) loses."""
    lines = stash(line_places(rows, least), "lines")
    once = lines.select("key", "doc_id").distinct()  # a document counts once, also where its id stands on several rows
    common = once.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= documents)
    common = stash(common.select("key", "last"), "common")  # a plain side, so that the join can split a hot line's rows
    gone = lines.join(common, "key").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = stash(gone.groupBy("k1", "k2").agg(F.flatten(F.collect_list("places")).alias("gone")), "gone")
    discard(lines, common)
    return gone


def without_lines(text_at: int):
    """A mapInArrow function over (row struct, gone array<int>): the row's text without the lines at these places."""

    def run(batches):
        for whole in batches:
            for b in portions(pa.RecordBatch.from_arrays([*whole.columns, whole.column(0).field(text_at)], names=["row", "gone", "text"]), 2):
                texts, lines, gone = [], [], []
                for text, places in zip(b.column(2), b.column(1), strict=True):
                    text = text.as_py()
                    parts, drop = (text or "").split("\n"), set(places.as_py() or ())
                    lines.append(len(parts))
                    gone.append(len(drop))
                    texts.append("\n".join([x for at, x in enumerate(parts) if at not in drop]) if drop else text)
                kind, columns = b.column(0).type, b.column(0).flatten()
                columns[text_at] = pa.array(texts, kind.field(text_at).type)
                row = pa.StructArray.from_arrays(columns, fields=list(kind))
                yield pa.RecordBatch.from_arrays([row, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=["row", "n_lines", "n_dropped"])
        trim()

    return run


def cleaned(docs: DataFrame, id_col: str, text_col: str, least: int, documents: int) -> DataFrame:
    """(row struct, n_lines, n_dropped) for every row of docs; the struct keeps all columns out of reach of ours."""
    key = row_key(F.col(id_col).cast("long"), F.col(text_col))
    gone = dropped_places(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *key), least, documents)
    gone = gone.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "gone")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *key)
    joined = rows.join(gone, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left").select("row", "gone")
    schema = T.StructType([joined.schema["row"]]).add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(without_lines(docs.columns.index(text_col)), schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """Every row of docs as (doc_id, text, n_lines, n_dropped), its text without lines that at least
    ``documents`` documents hold, but for those of the largest id holding them.

    Nulls: a null text is one empty line and stays null; rows without an id count as one document, which is never
    the largest. Rows that share an id are one document too, and all keep the line if theirs is the largest id; each
    row gives a row. A document whose lines all go has the empty text. Very long texts are read whole. Other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cleaned(rows, "doc_id", "text", least, documents).select("row.doc_id", "row.text", "n_lines", "n_dropped")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """docs, all columns and rows, their texts without common lines. Nulls, repeated ids, long texts and other columns
    as in line_dedup(); a column of any name stays as it is."""
    return cleaned(docs, id_col, text_col, least, documents).select("row.*")
