"""What the training-data operators share: shared scratch space, code shipping, connected components."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ship(name: str) -> None:
    """Pickle this module's functions by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, one of our own, but only
    for a local master, whose executors are in this process; else that's an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not at:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="reelspark-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder stays for the cluster's own cleaning
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends if nothing did so before."""
    path = f"{shared_dir(spark)}/reelspark-{what}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


#: What holds while a step is run: the shuffle files of a query go once it has ended, as nothing reads them after its result
#: is written; and Arrow batches are short, as each holds whole texts on both sides of every Python worker.
RUNNING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def running(spark: SparkSession) -> Iterator[None]:
    """RUNNING holds inside; afterwards the session's own settings are back."""
    was = {k: spark.conf.get(k, None) for k in RUNNING}
    for k, v in RUNNING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder as Parquet and read it back: cuts lineage, survives lost executors,
    and gives the planner true sizes. The files go by discard(), or when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch(spark, what)
    with running(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of stashed frames that no later step reads."""
    for df in frames:
        forget(df.sparkSession, df._stashed_at)


def trim(least: int = 160 << 20) -> None:
    """Give memory that a finished partition has freed back to the system, where the process holds more than ``least``
    bytes: Python workers live on."""
    import ctypes
    import gc

    import pyarrow as pa

    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < least:
                return
    except OSError:  # no such system
        pass
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def portions(batch, column: int, most: int = 4 << 20):
    """The batch in slices whose ``column`` (text or binary) holds about ``most`` bytes, or one row: what is made
    of a slice is then bounded by bytes, however many or long the rows of an Arrow batch are."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or bare path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def open_shared(uri: str, mode: str):
    """Open a file of the shared folder from an executor, whatever store it lies in."""
    at = local_path(uri)
    if at is not None:
        if "w" in mode:
            os.makedirs(os.path.dirname(at), exist_ok=True)
        return open(at, mode)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(at) if "w" in mode else store.open_input_file(at)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Neighbour minimum plus pointer jumping, so rounds grow with the logarithm of the diameter. Each round is
    joins and a pre-aggregated minimum; labels are written and the round's before deleted, and only one flag reaches
    the driver. The result is a stash, to be discarded like any.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("r")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "r"), "b").groupBy("a").agg(F.min("r").alias("n"))
        step = labels.select("a", "r").join(near, "a").select("a", F.col("r").alias("was"), F.least("r", "n").alias("r1"))
        after = labels.select(F.col("a").alias("r1"), F.col("r").alias("r2"))
        step = stash(step.join(after, "r1", "left").select("a", "was", F.least("r1", F.coalesce("r2", "r1")).alias("r")), "labels")
        discard(labels)
        if not step.where("r <> was").limit(1).count():
            discard(both)
            out = step.select(F.col("a").alias("node"), F.col("r").alias("root"))
            out._stashed_at = step._stashed_at
            return out
        labels = step


def one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each group: rows (doc_id, k, root) names the group root of every row of docs, k being
    xxhash64 of its text. The row of the least (doc_id, k) stays; rows without an id stay. The columns of docs travel
    as one struct, so none can clash with ours."""
    names = rows.where("doc_id is not null").groupBy("root", "doc_id", "k").agg(F.count("*").alias("rows"))
    least = names.groupBy("root").agg(F.min(F.struct("doc_id", "k", "rows")).alias("m"))
    least = stash(least.select(F.col("m.doc_id").alias("kept"), F.col("m.k").alias("kept_k"), F.col("m.rows").alias("rows")), "least")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("i"), F.xxhash64(docs[text_col]).alias("k"))
    kept = packed.join(least, (F.col("i") == F.col("kept")) & (F.col("k") == F.col("kept_k")))
    out = kept.where("rows = 1").select("row")
    if least.where("rows > 1").limit(1).count():
        out = out.unionByName(kept.where("rows > 1").groupBy("kept", "kept_k").agg(F.first("row").alias("row")).select("row"))
    if rows.where("doc_id is null").limit(1).count():
        out = out.unionByName(packed.where("i is null").select("row"))
    return out.select("row.*")
