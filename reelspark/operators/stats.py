"""Summaries, facets, workflow and tracking counts, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fmt import bytes_text, duration_text
from ..functions.text import is_blank
from .search import incomplete, labelled


def summary(videos: DataFrame) -> DataFrame:
    total = videos.agg(
        F.count("*").alias("total_videos"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_size"),
        F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("total_duration"),
    )
    return total.withColumns({"size_text": bytes_text(F.col("total_size")), "duration_text": duration_text(F.col("total_duration"))})


def top_values(videos: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most common non-blank values, ties by value."""
    counts = videos.where(~is_blank(F.col(column))).groupBy(column).agg(F.count("*").alias("videos"))
    return counts.orderBy(F.desc("videos"), column).limit(n)


def top_files(videos: DataFrame, column: str, n: int = 5, known: bool = False) -> DataFrame:
    """The n files of largest ``column``; with known, files without it don't count."""
    rows = videos.where(F.col(column).isNotNull()) if known else videos
    return rows.select("file_id", "file_name", column).orderBy(F.desc_nulls_last(column), "file_id").limit(n)


def facet(videos: DataFrame, column: str | Column, name: str) -> DataFrame:
    """Distinct non-blank values."""
    c = F.col(column) if isinstance(column, str) else column
    return videos.select(c.alias(name)).where(~is_blank(F.col(name))).distinct()


def years(videos: DataFrame) -> DataFrame:
    return facet(videos.where(F.length("modified_at") >= 4), F.substring("modified_at", 1, 4), "year").orderBy(F.desc("year"))


def workflow_counts(videos: DataFrame) -> DataFrame:
    """(asset_type, workflow_stage, videos): counts by each of the two, from one scan."""
    sets = videos.select("asset_type", "workflow_stage").groupingSets([[F.col("asset_type")], [F.col("workflow_stage")]], F.col("asset_type"), F.col("workflow_stage"))
    return sets.agg(F.count("*").alias("videos"))


def cut_links(videos: DataFrame) -> DataFrame:
    cut, none = F.col("asset_type") == "cut", is_blank(F.col("source_file_id"))
    return videos.agg(F.count_if(cut & ~none).alias("linked_cuts"), F.count_if(cut & none).alias("unlinked_cuts"))


def tracking_counts(videos: DataFrame, video_labels: DataFrame) -> DataFrame:
    """New, missing labels, unlinked cuts and incomplete files, in one pass."""
    flagged = videos.join(labelled(video_labels), "file_id", "left")
    has = F.col("has_label").isNotNull()
    return flagged.agg(
        F.count_if(is_blank(F.col("reviewed_at"))).alias("new_videos"),
        F.count_if(~has).alias("missing_labels"),
        F.count_if((F.col("asset_type") == "cut") & is_blank(F.col("source_file_id"))).alias("unlinked_cuts"),
        F.count_if(incomplete(has)).alias("incomplete"),
    )


def completeness(videos: DataFrame, video_labels: DataFrame) -> DataFrame:
    """videos with (completed, total, status, missing): five checks; texts of white space count as missing, and a
    blank speaker that isn't empty hides the preacher."""
    said = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\x0b\x0c")) != ""
    who = F.when(~is_blank(F.col("speaker")), F.col("speaker")).otherwise(F.col("preacher"))
    # The checks' names.
    checks = {
        "type_et_statut_confirmes": ~is_blank(F.col("reviewed_at")), "titre": said(F.col("editorial_title")),
        "theme": said(F.col("main_theme")), "intervenant": said(who), "label": F.col("has_label").isNotNull(),
    }
    done = sum((c.cast("int") for c in checks.values()), F.lit(0))
    rows = videos.join(labelled(video_labels), "file_id", "left").withColumn("completed", done)
    status = F.when(F.col("completed") == len(checks), "complete").when(F.col("completed") <= 1, "missing").otherwise("partial")
    missing = F.array_compact(F.array(*(F.when(~c, name) for name, c in checks.items())))
    return rows.withColumns({"total": F.lit(len(checks)), "status": status, "missing": missing}).drop("has_label")
