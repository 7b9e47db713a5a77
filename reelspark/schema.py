"""Schema of the catalogue table, its column groups, and the step that aligns any table with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, down to SORTS: column names and groups, defaults and enums of the catalogue.
TEXT = [
    "file_id",
    "file_name",
    "internal_video_id",
    "drive_url",
    "folder_path",
    "parent_folder",
    "shared_drive_name",
    "owner",
    "mime_type",
    "file_extension",
    "created_at",
    "modified_at",
    "clean_title",
    "editorial_title",
    "original_title",
    "alternate_titles",
    "normalized_name",
    "speaker",
    "preacher",
    "ministry",
    "worship_leaders",
    "main_theme",
    "spiritual_themes",
    "doctrine_topics",
    "biblical_topics",
    "bible_references",
    "songs",
    "keywords",
    "semantic_tags",
    "content_type",
    "event_name",
    "event_date",
    "location",
    "language",
    "audience",
    "series_name",
    "session_number",
    "teaching_type",
    "ai_summary",
    "transcript_status",
    "transcript_text_path",
    "transcript_summary",
    "manual_notes",
    "metadata_source",
    "metadata_updated_at",
    "asset_type",
    "workflow_stage",
    "source_file_id",
    "workflow_notes",
    "workflow_updated_at",
    "first_seen_at",
    "reviewed_at",
    "resolution",
    "video_codec",
    "audio_codec",
    "aspect_ratio",
    "orientation",
    "container_format",
    "scan_status",
    "last_scanned_at",
    "error_message",
]
LONGS = ["file_size", "width", "height", "bitrate"]
DOUBLES = ["metadata_confidence", "duration_seconds", "fps"]
DEFAULTS = {"asset_type": "raw", "workflow_stage": "digitized", "scan_status": "indexed", "file_size": 0}
ASSET_TYPES = ["raw", "cut"]
STAGES = ["digitized", "to_review", "transcribed", "treated", "ready_edit", "published"]

#: Columns that editors own.
EDITABLE = [
    "editorial_title",
    "original_title",
    "alternate_titles",
    "clean_title",
    "normalized_name",
    "speaker",
    "preacher",
    "ministry",
    "main_theme",
    "spiritual_themes",
    "doctrine_topics",
    "biblical_topics",
    "bible_references",
    "songs",
    "worship_leaders",
    "content_type",
    "event_name",
    "event_date",
    "location",
    "language",
    "audience",
    "series_name",
    "session_number",
    "teaching_type",
    "ai_summary",
    "transcript_status",
    "transcript_text_path",
    "transcript_summary",
    "manual_notes",
    "metadata_source",
    "metadata_confidence",
    "keywords",
    "semantic_tags",
]
#: Columns that a rescan leaves alone.
PROTECTED = [
    *EDITABLE,
    "internal_video_id",
    "asset_type",
    "workflow_stage",
    "source_file_id",
    "workflow_notes",
    "workflow_updated_at",
    "first_seen_at",
    "reviewed_at",
]
#: Columns that the text filter looks in.
SEARCHED = [
    "file_name",
    "folder_path",
    "parent_folder",
    "owner",
    "editorial_title",
    "original_title",
    "alternate_titles",
    "clean_title",
    "speaker",
    "preacher",
    "ministry",
    "main_theme",
    "spiritual_themes",
    "doctrine_topics",
    "biblical_topics",
    "bible_references",
    "songs",
    "content_type",
    "event_name",
    "transcript_summary",
    "keywords",
    "semantic_tags",
]
#: Columns of the full-text index.
INDEXED = [
    "file_name",
    "folder_path",
    "internal_video_id",
    "editorial_title",
    "original_title",
    "alternate_titles",
    "clean_title",
    "speaker",
    "preacher",
    "ministry",
    "main_theme",
    "spiritual_themes",
    "doctrine_topics",
    "biblical_topics",
    "bible_references",
    "songs",
    "worship_leaders",
    "content_type",
    "event_name",
    "location",
    "series_name",
    "teaching_type",
    "transcript_summary",
    "ai_summary",
    "keywords",
    "semantic_tags",
]
#: Fields whose list texts make terms, and the terms' categories.
LEXICON = {
    "main_theme": "theme",
    "spiritual_themes": "theme",
    "doctrine_topics": "doctrine",
    "biblical_topics": "biblical_topic",
    "bible_references": "scripture",
    "songs": "song",
    "worship_leaders": "person",
    "speaker": "person",
    "preacher": "person",
    "ministry": "ministry",
    "event_name": "event",
    "location": "place",
    "content_type": "content_type",
    "keywords": "keyword",
    "semantic_tags": "semantic_tag",
}
#: Sortable columns; True: ASCII case doesn't count.
SORTS = {
    "file_name": True, "folder_path": True, "file_size": False, "duration_seconds": False, "modified_at": False,
    "resolution": False, "file_extension": False, "internal_video_id": False, "editorial_title": True,
    "speaker": True, "preacher": True, "main_theme": True, "content_type": True, "event_name": True,
    "asset_type": True, "workflow_stage": True,
}

VIDEOS = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT]
    + [T.StructField(c, T.LongType()) for c in LONGS]
    + [T.StructField(c, T.DoubleType()) for c in DOUBLES]
    + [T.StructField("has_audio", T.BooleanType())]
)


def default_of(name: str) -> object:
    """What a missing value reads as: an empty text, 0 for the size, null for other numbers."""
    return DEFAULTS.get(name, "" if name in TEXT else None)


def align(df: DataFrame, fill: bool = False) -> DataFrame:
    """df with all catalogue columns in order: missing ones take their default, known ones their type; with
    ``fill``, nulls read as the default too."""

    def column(f: T.StructField) -> Column:
        default = F.lit(default_of(f.name)).cast(f.dataType)
        if f.name not in df.columns:
            return default.alias(f.name)
        c = F.col(f.name).cast(f.dataType)
        return (F.coalesce(c, default) if fill and default_of(f.name) is not None else c).alias(f.name)

    return df.select(*(column(f) for f in VIDEOS))
