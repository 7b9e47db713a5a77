"""A small catalogue of our own values, for demonstrations, and the engine's settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from ..schema import align

MB = 1024 * 1024


def seed_files(spark: SparkSession) -> DataFrame:
    """Three files of three kinds with sizes and lengths, one in a shared drive, as catalogue rows."""
    rows = [
        ("demo-a", "Morning talk.mp4", "/Talks", "", ".mp4", 150 * MB, 1800.0, "1920x1080", True),
        ("demo-b", "Evening talk.mov", "/Talks/Evening", "Archive", ".mov", 1024 * MB, 7200.0, "3840x2160", True),
        ("demo-c", "Choir.webm", "/Music", "", ".webm", 500 * MB, 3600.0, "1280x720", False),
    ]
    names = "file_id string, file_name string, folder_path string, shared_drive_name string, file_extension string, file_size long, duration_seconds double, resolution string, has_audio boolean"
    return align(spark.createDataFrame(rows, names), fill=True)


def seed_workflow(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Three raw files and a cut of each, a stage each, and (file_id, names) of labels for three of them."""
    stages = ["digitized", "to_review", "transcribed", "treated", "ready_edit", "published"]
    rows = [(f"demo-{k}", f"File {k}.mp4", "raw" if k < 3 else "cut", stage, "" if k < 3 else f"demo-{k - 3}", "Demo speaker" if k == 0 else "") for k, stage in enumerate(stages)]
    videos = spark.createDataFrame(rows, "file_id string, file_name string, asset_type string, workflow_stage string, source_file_id string, speaker string")
    labels = spark.createDataFrame([("demo-0", ["First", "Second"]), ("demo-3", ["Third", "Fourth"]), ("demo-5", ["Fifth", "Sixth"])], "file_id string, names array<string>")
    return align(videos, fill=True), labels


@dataclass(frozen=True)
class Settings:
    """What the environment says, by the fields' names in upper case; empty values leave the default."""

    drive_folder: str = ""
    include_shared_drives: bool = True
    follow_shortcuts: bool = True
    incremental: bool = True
    max_download_mb: float = 0.0
    read_only: bool = False
    admin_emails: str = ""
    session_days: int = 14
    code_minutes: int = 15
    log_level: str = "INFO"
    log_file: str = ""

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        read = {"bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "int": int, "float": float, "str": str}
        return cls(**{f.name: read[str(f.type)](env[f.name.upper()]) for f in fields(cls) if env.get(f.name.upper(), "") != ""})
