"""Faceted and text search over the catalogue: predicates, sort, page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, is_blank, label_key_of, like
from ..schema import SEARCHED, SORTS

MB = 1024 * 1024


@dataclass
class SearchRequest:
    """A search; what is empty or None doesn't filter."""

    query: str = ""
    folder: str = ""
    extension: str = ""
    resolution: str = ""
    year: str = ""
    shared_drive: str = ""
    asset_type: str = ""
    workflow_stage: str = ""
    label: str = ""
    tracking: str = ""
    min_size_mb: float | None = None
    max_size_mb: float | None = None
    min_duration_sec: float | None = None
    max_duration_sec: float | None = None
    has_audio: bool | None = None
    sort_by: str = "file_name"
    sort_dir: str = "asc"
    page: int = 1
    page_size: int = 50
    full_text: bool = False


def labelled(video_labels: DataFrame) -> DataFrame:
    """The files that have a label, once each, with a flag: an outer join with it tests for existence."""
    return video_labels.groupBy("file_id").agg(F.lit(True).alias("has_label"))


def text_filter(videos: DataFrame, query: str, video_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """Files with the pattern %query% in any searched column or in the name of one of their labels."""
    pattern = f"%{query.strip()}%"
    named = video_labels.join(labels.where(like(F.col("name"), pattern)), video_labels["label_id"] == labels["id"], "left_semi")
    hits = named.groupBy("file_id").agg(F.lit(True).alias("_hit"))
    anywhere = reduce(lambda a, b: a | b, (F.coalesce(like(F.col(c), pattern), F.lit(False)) for c in SEARCHED))
    return videos.join(hits, "file_id", "left").where(anywhere | F.col("_hit").isNotNull()).select(*videos.columns)


def with_label(videos: DataFrame, label: str, video_labels: DataFrame, labels: DataFrame) -> DataFrame:
    wanted = labels.where(F.col("normalized_name") == label_key_of(label))
    files = video_labels.join(wanted, video_labels["label_id"] == wanted["id"], "left_semi")
    return videos.join(files, "file_id", "left_semi")


def incomplete(has_label: Column) -> Column:
    gaps = is_blank(F.col("reviewed_at")) | is_blank(F.col("editorial_title")) | is_blank(F.col("main_theme"))
    return gaps | (is_blank(F.col("speaker")) & is_blank(F.col("preacher"))) | ~has_label


def tracked(videos: DataFrame, tracking: str, video_labels: DataFrame) -> DataFrame:
    """new, missing_labels, unlinked_cut or incomplete files; another value filters nothing."""
    if tracking == "new":
        return videos.where(is_blank(F.col("reviewed_at")))
    if tracking == "missing_labels":
        return videos.join(video_labels, "file_id", "left_anti")
    if tracking == "unlinked_cut":
        return videos.where((F.col("asset_type") == "cut") & is_blank(F.col("source_file_id")))
    if tracking == "incomplete":
        flagged = videos.join(labelled(video_labels), "file_id", "left")
        return flagged.where(incomplete(F.col("has_label").isNotNull())).select(*videos.columns)
    return videos


def conditions(r: SearchRequest) -> list[Column]:
    """The predicates on the catalogue's own columns; they reach the Parquet scan."""
    equal = {
        "folder_path": r.folder, "file_extension": r.extension, "resolution": r.resolution,
        "shared_drive_name": r.shared_drive, "asset_type": r.asset_type, "workflow_stage": r.workflow_stage,
    }
    out = [F.col(c) == v for c, v in equal.items() if v]
    if r.year:
        out.append(F.substring("modified_at", 1, 4) == r.year)
    for name, low, high in (
        ("file_size", *(None if x is None else int(x * MB) for x in (r.min_size_mb, r.max_size_mb))),
        ("duration_seconds", r.min_duration_sec, r.max_duration_sec),
    ):
        out += [F.col(name) >= low] if low is not None else []
        out += [F.col(name) <= high] if high is not None else []
    if r.has_audio is not None:
        out.append(F.col("has_audio") if r.has_audio else ~F.coalesce(F.col("has_audio"), F.lit(False)))
    return out


def matches(videos: DataFrame, r: SearchRequest, video_labels: DataFrame, labels: DataFrame, tokens: DataFrame | Callable[[str], DataFrame] | None = None, substring: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """All files that a request finds, in no order. Full text is looked up by the stored index's search, or in a token
    index, where one is given; else a token index is made from videos. substring: what filters files by a pattern
    instead of text_filter()."""
    out = videos
    for c in conditions(r):
        out = out.where(c)
    if r.label:
        out = with_label(out, r.label, video_labels, labels)
    if r.tracking:
        out = tracked(out, r.tracking, video_labels)
    if r.query.strip() and r.full_text:
        from .fulltext import search_index, token_index

        found = tokens(r.query) if callable(tokens) else search_index(token_index(videos) if tokens is None else tokens, r.query)
        out = out.join(found, "file_id", "left_semi")
    elif r.query.strip():
        out = text_filter(out, r.query, video_labels, labels) if substring is None else substring(out, r.query)
    return out


def ordering(sort_by: str, sort_dir: str) -> list[Column]:
    """The wanted column, then name and id, so the order is total; an unknown column means the name."""
    name = sort_by if sort_by in SORTS else "file_name"
    key = fold(F.col(name)) if SORTS[name] else F.col(name)
    return [key.desc_nulls_last() if sort_dir.lower() == "desc" else key.asc_nulls_first(), F.col("file_name").asc(), F.col("file_id").asc()]


def page_of(found: DataFrame, r: SearchRequest) -> DataFrame:
    size, page = min(max(r.page_size, 1), 200), max(r.page, 1)
    return found.orderBy(*ordering(r.sort_by, r.sort_dir)).offset((page - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return max(-(-total // size), 1)


def search(videos: DataFrame, r: SearchRequest, video_labels: DataFrame, labels: DataFrame, tokens: DataFrame | Callable[[str], DataFrame] | None = None) -> DataFrame:
    return page_of(matches(videos, r, video_labels, labels, tokens), r)


def checked_sort(sort_by: str, sort_dir: str) -> tuple[str, str]:
    """The two as they are; ValueError for a column that can't be sorted by or a direction that is none."""
    if sort_by not in SORTS:
        raise ValueError(f"can't sort by {sort_by!r}")
    if sort_dir.lower() not in ("asc", "desc"):
        raise ValueError(f"no direction: {sort_dir!r}")
    return sort_by, sort_dir


def paged(found: DataFrame, r: SearchRequest) -> DataFrame:
    """(total, pages) of what a request found."""
    size = min(max(r.page_size, 1), 200)
    return found.agg(F.count("*").alias("total")).select("total", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long").alias("pages"))


def raw_options(videos: DataFrame, exclude: str = "") -> DataFrame:
    """(file_id, label) of raw files: title, else name, sorted without ASCII case."""
    title = F.coalesce(F.when(~is_blank(F.col("editorial_title")), F.col("editorial_title")), F.col("file_name"))
    rows = videos.where((F.col("asset_type") == "raw") & (F.col("file_id") != exclude)).select("file_id", title.alias("label"))
    return rows.orderBy(fold(F.col("label")), "file_id")
