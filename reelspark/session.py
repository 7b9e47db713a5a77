"""The session that the catalogue operators expect, and cutting lineage in its shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, Arrow transfer; other settings stay the cluster's own."""
    builder = SparkSession.builder.appName("reelspark")
    builder = builder.master(master) if master else builder
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=fixed | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master, whose tasks run in this process,
    may do without that setting; then one of our own is set."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not held.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="reelspark-")
    if not held.isDefined():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder stays for the cluster's own cleaning
        pass


_scopes = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread checkpoints inside is deleted at the end, so results must be collected or written by then."""
    outer, mine = getattr(_scopes, "paths", None), []
    _scopes.paths = mine
    try:
        yield
    finally:
        _scopes.paths = outer
        for path in mine:
            forget(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt to all cores, for work that is dear a row: a small file, or one of a few row groups, is one task."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back. The files go at the end of the scratch() around it, else when
    the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reelspark-{uuid.uuid4().hex}"
    mine = getattr(_scopes, "paths", None)
    if mine is None:
        atexit.register(forget, spark, path)
    else:
        mine.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
