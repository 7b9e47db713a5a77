"""Incremental ingest: each micro-batch of listing files is merged into the stored catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.inverted import TextIndex
from ..operators.merge import assign_ids, changed, last_of, upsert
from ..schema import VIDEOS, align
from ..session import checkpointed, scratch
from ..sources import listing
from ..sources.listing import enriched, records, routed, scan_counts
from ..sources.seed import Settings
from ..sources.store import Store, Transaction

#: The catalogue's full-text index.
INDEX = TextIndex()
IDS = "id long, file_id string, internal_video_id string"


def outcomes(rows: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """rows (one a file) with ``outcome``: error, indexed, or skipped where state holds the same version (not if full)."""
    good = rows.where("scan_status <> 'error'")
    todo = (good if full else changed(good, state)).select("file_id", F.lit(True).alias("_d"))
    outcome = F.when(F.col("scan_status") == "error", "error").when(F.col("_d"), "indexed").otherwise("skipped")
    return rows.join(todo, "file_id", "left").withColumn("outcome", outcome).drop("_d")


def ingest(t: Transaction, items: DataFrame, paths: DataFrame, drives: DataFrame, now: str, full: bool = False, settings: Settings | None = None) -> dict:
    """Merge a batch of listing items, within a transaction: route, skip what hasn't changed (unless full), enrich, number,
    upsert, index. Returns the counts. Only the buckets that changed files fall into are read and written anew, and
    only changed files are tokenised. All tables change together, and a batch that is run again after a failure comes to the
    same tables. settings: whether shortcuts are followed, and up to which size a file keeps its probe."""
    settings = settings or Settings()
    found = routed(items.where(~F.coalesce("trashed", F.lit(False))), settings.follow_shortcuts).where("route = 'video'")
    rows = checkpointed(last_of(records(found, paths, drives, now, settings.max_download_mb), "file_id", "scan_seq"))
    # a file that is skipped is left as it is, so what its bucket held may change meanwhile
    rows = checkpointed(outcomes(rows, t.read("videos", VIDEOS, t.touched("videos", rows), tracked=False), full))
    todo = rows.where("outcome = 'indexed'").drop("outcome")
    near = {name: t.touched(name, todo) for name in ("videos", "video_ids")}
    if near["videos"]:
        schema = T.StructType.fromDDL(IDS)
        high = t.read("video_ids", schema).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
        held = t.read("video_ids", schema, near["video_ids"])
        t.write("video_ids", held.unionByName(assign_ids(todo, held, high)), near["video_ids"])
        names = t.read("video_ids", buckets=near["video_ids"]).select("file_id", "internal_video_id")
        numbered = align(enriched(todo)).drop("internal_video_id").join(names, "file_id", "left")
        current = t.read("videos", VIDEOS, near["videos"])
        t.write("videos", upsert(current, numbered.select(*current.columns), now=F.lit(now)), near["videos"])
        merged = t.read("videos", buckets=near["videos"]).join(todo.select("file_id"), "file_id", "left_semi")
        INDEX.add(t, merged)
    return scan_counts(rows).first().asDict()


def start(spark: SparkSession, landing: str, store: Store, paths: DataFrame, drives: DataFrame, checkpoint: str, now: str, once: bool = True, settings: Settings | None = None, roots: tuple[str, ...] = ("root",)) -> StreamingQuery:
    """Follow a landing folder. The checkpoint keeps what was read; a batch that is run again merges to the same
    catalogue, as the upsert is idempotent. Every batch is one transaction. Lines that can't be read, and items of folders
    that neither paths nor drives nor ``roots`` know, or with a size that is no number, go to the table of dead
    letters, a part a batch, and the others on."""
    stream = spark.readStream.text(landing).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("source"))
    known = paths.select("id").unionByName(drives.select("id")).unionByName(spark.createDataFrame([(r,) for r in roots], "id string"))

    def merge(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            items, dead = listing.sorted_out(checkpointed(listing.parsed_lines(batch.where("trim(record) <> ''"))), known)
            items, dead = checkpointed(items), checkpointed(dead)

            def work(t: Transaction) -> None:
                ingest(t, items, paths, drives, now, settings=settings)
                if dead.limit(1).count():
                    t.put_part("dead_letters", number, dead)

            store.transact(work)

    writer = stream.writeStream.foreachBatch(merge)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
