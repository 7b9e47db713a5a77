"""Late pages without sorting everything: by the last row seen, or by a stored order with counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold
from ..schema import SORTS
from ..sources.store import Snapshot, Transaction
from .search import SearchRequest, ordering

#: Rows of a range of a stored order, about, and bytes of their texts.
RANGE_ROWS, RANGE_BYTES = 100_000, 64 << 20


def keys(r: SearchRequest) -> list[tuple[Column, bool]]:
    """What a request sorts by, and whether downwards."""
    name = r.sort_by if r.sort_by in SORTS else "file_name"
    return [(fold(F.col(name)) if SORTS[name] else F.col(name), r.sort_dir.lower() == "desc"), (F.col("file_name"), False), (F.col("file_id"), False)]


def _after(key: Column, down: bool, last: Column) -> Column:
    """Whether a key comes after another's: nulls come first, or last when it goes down."""
    if down:
        return F.when(last.isNull(), F.lit(False)).otherwise(F.coalesce(key < last, F.lit(True)))
    return F.when(last.isNull(), key.isNotNull()).otherwise(F.coalesce(key > last, F.lit(False)))


def page_after(found: DataFrame, r: SearchRequest, last: tuple | None) -> DataFrame:
    """The rows of a request that come right after the one whose (sorted value, file_name, file_id) is ``last``, a page of
    them: one pass that keeps a page, however late it is. None: the first page."""
    size = min(max(r.page_size, 1), 200)
    if last is not None:
        name = r.sort_by if r.sort_by in SORTS else "file_name"
        values = [F.lit(v).cast(found.schema[c].dataType) for v, c in zip(last, (name, "file_name", "file_id"), strict=True)]
        values[0] = fold(values[0]) if SORTS[name] else values[0]
        ks = keys(r)
        same = [k.eqNullSafe(v) for (k, _), v in zip(ks, values, strict=True)]
        later = [reduce(Column.__and__, same[:i], F.lit(True)) & _after(k, down, v) for i, ((k, down), v) in enumerate(zip(ks, values, strict=True))]
        found = found.where(reduce(Column.__or__, later))
    return found.orderBy(*ordering(r.sort_by, r.sort_dir)).limit(size)


class StoredOrder:
    """All files in one order, cut into ranges that are parts of a table, and how many files each holds."""

    def __init__(self, r: SearchRequest):
        self.request = r
        self.name = f"order_{r.sort_by}_{r.sort_dir.lower()}"
        self.counts = f"{self.name}_counts"

    def build(self, t: Transaction, videos: DataFrame) -> None:
        """Sort once, in ranges."""
        by = ordering(self.request.sort_by, self.request.sort_dir)
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in videos.schema if f.dataType == T.StringType()]
        n, size = videos.agg(F.count("*"), F.coalesce(F.sum(reduce(Column.__add__, texts, F.lit(0).cast("long"))), F.lit(0))).first()
        ranges = max(1, -(-n // RANGE_ROWS), -(-size // RANGE_BYTES))
        rows = videos.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
        if self.name in t.tables:
            t.drop_parts(self.name, t.parts(self.name))
        t.put_parts(self.name, rows, dict.fromkeys(range(ranges), "order"))
        part = F.regexp_extract("_metadata.file_path", r"/part=(\d+)/", 1).cast("int")
        held = t.read(self.name).select(part.alias("range")).groupBy("range").agg(F.count("*").alias("n"))
        t.put_part(self.counts, 0, held)

    def ranges_of(self, t: Snapshot, page: int, size: int) -> tuple[list[int], int]:
        """(the ranges that hold a page, how many of their rows come before it)."""
        lo, hi = (page - 1) * size, page * size
        at, some, skip = 0, [], 0
        for r in sorted(t.read(self.counts).collect()):  # a row a range
            if at < hi and lo < at + r.n:
                skip = lo - at if not some else skip
                some.append(r.range)
            at += r.n
        return some, skip

    def page(self, t: Snapshot, page: int, size: int = 50) -> DataFrame:
        """A page of the order: only the ranges that hold it are read."""
        some, skip = self.ranges_of(t, max(page, 1), size)
        rows = t.read(self.name, buckets=some)
        return rows.orderBy(*ordering(self.request.sort_by, self.request.sort_dir)).offset(skip).limit(size)
