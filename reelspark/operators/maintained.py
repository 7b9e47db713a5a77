"""Statistics that are kept up instead of counted anew: each bucket's share of them is stored, and they are the shares' sums.

A share holds, for every value of each counted column, how many of the bucket's files have it and their sizes and lengths
together, and the bucket's largest and longest files. After a change only the shares of changed buckets are made
anew, from those buckets' rows; a share that is replaced takes its old counts along, so deletions need no rule of their own.
The functions give the same columns as those of stats over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fmt import bytes_text, duration_text
from ..functions.text import is_blank
from ..sources.derived import Derived
from ..sources.store import Snapshot
from .search import incomplete, labelled

#: What is counted by value: a name and the column.
COUNTED = {
    "file_extension": F.col, "resolution": F.col, "folder_path": F.col, "shared_drive_name": F.col, "asset_type": F.col, "workflow_stage": F.col,
    "year": lambda _: F.when(F.length("modified_at") >= 4, F.substring("modified_at", 1, 4)),
}
#: Files of a bucket that are kept for each list of the greatest.
KEPT = 50


def _flags(has_label: Column) -> dict[str, Column]:
    cut, unlinked = F.col("asset_type") == "cut", is_blank(F.col("source_file_id"))
    return {
        "new_videos": is_blank(F.col("reviewed_at")), "missing_labels": ~has_label, "incomplete": incomplete(has_label),
        "linked_cuts": cut & ~unlinked, "unlinked_cuts": cut & unlinked, "all": F.lit(True),
    }


def _shares(videos: DataFrame, video_labels: DataFrame) -> DataFrame:
    """(part, kind, value, n, size, seconds)."""
    rows = videos.join(labelled(video_labels), "file_id", "left")
    values = [F.struct(F.lit(k).alias("kind"), of(k).alias("value")) for k, of in COUNTED.items()]
    flags = [F.when(c, F.struct(F.lit("is").alias("kind"), F.lit(k).alias("value"))) for k, c in _flags(F.col("has_label").isNotNull()).items()]
    rows = rows.select("part", "file_size", "duration_seconds", F.explode(F.array_compact(F.array(*values, *flags))).alias("x"))
    return rows.groupBy("part", "x.kind", "x.value").agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("seconds"))


def _greatest(videos: DataFrame) -> DataFrame:
    """(part, file_id, file_name, file_size, duration_seconds) of the greatest files of each bucket, by either."""
    by = lambda c: F.row_number().over(Window.partitionBy("part").orderBy(F.desc_nulls_last(c), "file_id"))
    rows = videos.select("part", "file_id", "file_name", "file_size", "duration_seconds")
    return rows.withColumns({"_a": by("file_size"), "_b": by("duration_seconds")}).where(f"_a <= {KEPT} or _b <= {KEPT}").drop("_a", "_b")


SHARES = Derived("shares", ["videos", "video_labels"], _shares)
GREATEST = Derived("greatest", ["videos"], _greatest)


def _sums(t: Snapshot, kind: str) -> DataFrame:
    return SHARES.read(t, F.col("kind") == kind).groupBy("value").agg(F.sum("n").alias("videos"), F.sum("size").alias("size"), F.sum("seconds").alias("seconds"))


def summary(t: Snapshot) -> DataFrame:
    total = SHARES.read(t, (F.col("kind") == "is") & (F.col("value") == "all"))
    total = total.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_videos"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_duration"))
    return total.withColumns({"size_text": bytes_text(F.col("total_size")), "duration_text": duration_text(F.col("total_duration"))})


def top_values(t: Snapshot, column: str, n: int = 10) -> DataFrame:
    counts = _sums(t, column).where(~is_blank(F.col("value"))).select(F.col("value").alias(column), "videos")
    return counts.orderBy(F.desc("videos"), column).limit(n)


def facet(t: Snapshot, column: str, name: str) -> DataFrame:
    return _sums(t, column).where(~is_blank(F.col("value"))).select(F.col("value").alias(name))


def years(t: Snapshot) -> DataFrame:
    return facet(t, "year", "year").orderBy(F.desc("year"))


def workflow_counts(t: Snapshot) -> DataFrame:
    none = F.lit(None).cast("string")
    assets = _sums(t, "asset_type").select(F.col("value").alias("asset_type"), none.alias("workflow_stage"), "videos")
    return assets.unionByName(_sums(t, "workflow_stage").select(none.alias("asset_type"), F.col("value").alias("workflow_stage"), "videos"))


def flag_counts(t: Snapshot, *names: str) -> DataFrame:
    """One row with a count for each flag: those of cut_links() and tracking_counts() of the statistics."""
    rows = SHARES.read(t, F.col("kind") == "is")
    return rows.agg(*(F.coalesce(F.sum(F.when(F.col("value") == k, F.col("n"))), F.lit(0)).alias(k) for k in names))


def top_files(t: Snapshot, column: str, n: int = 5, known: bool = False) -> DataFrame:
    if n > KEPT:
        raise ValueError(f"at most {KEPT} files are kept")
    rows = GREATEST.read(t)
    rows = rows.where(F.col(column).isNotNull()) if known else rows
    return rows.select("file_id", "file_name", column).orderBy(F.desc_nulls_last(column), "file_id").limit(n)
