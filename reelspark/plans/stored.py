"""Queries over a store that is built once from a folder's tables and then changed: the stored index, substring search by
trigrams, statistics that are kept up, late pages, migrations and the like. A store is kept as long as the session."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, maintained, paging, trigrams
from ..operators.inverted import TextIndex
from ..operators.paging import StoredOrder
from ..operators.search import SearchRequest
from ..session import forget, scratch, shared_dir
from ..sources import listing
from ..sources.derived import Derived, refreshed
from ..sources.store import Snapshot, Store, Transaction
from ..streaming import state

INDEX = TextIndex()
_made: dict[tuple[str, str, str], Store] = {}


def store_of(t, what: str, *steps: Callable[[Transaction], object]) -> Snapshot:
    """The newest version of the store of this name over a folder's tables; at first use it is made by the steps, a
    transaction each."""
    spark = t.spark
    key = (spark.sparkContext.applicationId, t.sf_dir, what)
    if key not in _made:
        root = f"{shared_dir(spark)}/reelspark-store-{uuid.uuid4().hex}"
        atexit.register(forget, spark, root)
        store = Store(spark, root, keys={"label_names": "id"})
        for step in steps:
            with scratch(spark):
                store.transact(step)
        _made[key] = store
    return _made[key].snapshot()


def indexed(t) -> Snapshot:
    """The catalogue's full-text index: the raw files' segment, then that of the others."""
    return store_of(t, "index", lambda x: INDEX.add(x, t.videos.where("asset_type = 'raw'")), lambda x: INDEX.backfill(x, t.videos))


def refreshed_index(t) -> Snapshot:
    """An index of stale names, then the changed files anew, a file removed and put back, and segments merged."""
    stale = t.videos.withColumn("file_name", F.when(F.col("asset_type") == "cut", F.concat(F.lit("stale "), "file_name")).otherwise(F.col("file_name")))
    some = F.pmod(F.xxhash64("file_id"), F.lit(50)) == 0
    return store_of(
        t, "refreshed", lambda x: INDEX.add(x, stale), lambda x: INDEX.add(x, t.videos.where("asset_type = 'cut'")),
        lambda x: INDEX.remove(x, t.videos.where(some).select("file_id")), lambda x: INDEX.backfill(x, t.videos), lambda x: INDEX.merge(x, x.parts(INDEX.files)),
    )


def catalogue(t, *kept: Derived) -> Snapshot:
    """The catalogue with the kept tables named (statistics, if none), which were made over other rows first: some files are then edited, some
    deleted and some added, in a quarter of the buckets."""
    kept = kept or STATISTICS
    few = F.pmod(F.xxhash64("file_id"), F.lit(16)) < 4
    edited, added = few & F.col("file_name").contains("1"), few & F.col("file_name").contains("2")

    def load(x: Transaction) -> None:
        before = t.videos.where(~added).withColumns({
            "file_name": F.when(edited, F.concat(F.lit("Old "), "file_name")).otherwise(F.col("file_name")), "asset_type": F.when(edited, "old").otherwise(F.col("asset_type")),
            "file_size": F.when(edited, F.col("file_size") + 10_000_000).otherwise(F.col("file_size")),
        })
        gone = t.videos.where(added).withColumns({"file_id": F.concat(F.lit("gone-"), "file_id"), "file_name": F.lit("preacher gone")})
        x.write("videos", before.unionByName(gone.where(few)).select(*t.videos.columns))
        x.write("video_labels", t.video_labels.where(~few))
        x.write("label_names", t.label_names)
        refreshed(x, *kept)

    def change(x: Transaction) -> None:
        here = [b for b in x.parts("videos") if b < 4]
        x.write("videos", t.videos.where(x.bucket("videos").isin(here)), here)
        x.write("video_labels", t.video_labels.where(x.bucket("video_labels").isin(here)), here)
        made = refreshed(x, *kept)
        assert all(set(b) <= set(here) for b in made.values()), made  # only changed buckets were read

    return store_of(t, "catalogue " + " ".join(x.name for x in kept), load, change)


#: What statistics and what substring search need: neither pays for the other's.
STATISTICS, SIGNED = (maintained.SHARES, maintained.GREATEST), (trigrams.TEXTS, trigrams.SIGNATURES)


def searched(t, needle: str) -> DataFrame:
    """Files found by a substring, by way of the signatures."""
    at = catalogue(t, *SIGNED)
    return trigrams.text_filter(at, at.read("videos"), needle, at.read("video_labels"), at.read("label_names")).select("file_id", "file_name")


def late_page(t, page: int, size: int) -> DataFrame:
    """A page of all files by size, from a stored order of several ranges."""
    order = StoredOrder(SearchRequest(sort_by="file_size", sort_dir="desc"))
    at = store_of(t, "order", lambda x: order.build(x, t.videos))
    return order.page(at, page, size).select("file_id", "file_name", "file_size")


def page_after(t, pages: int, size: int) -> DataFrame:
    """The page by length after so many others, each found by the last row of the one before."""
    r = SearchRequest(sort_by="duration_seconds", sort_dir="desc", page_size=size)
    rows, last = t.videos.select("file_id", "file_name", "duration_seconds"), None
    for _ in range(pages):
        page = paging.page_after(rows, r, last).collect()  # a page
        last = (page[-1].duration_seconds, page[-1].file_name, page[-1].file_id) if page else last
    return paging.page_after(rows, r, last)


def migrated(t) -> DataFrame:
    """Files of a store whose table is of three versions of its columns at once: some buckets as first written, some as
    written after one migration step, some rewritten after both."""
    spark = t.spark
    key = (spark.sparkContext.applicationId, t.sf_dir, "migrated")
    steps = [
        lambda df: df.withColumn("size_mb", F.round(F.col("file_size") / (1024 * 1024), 3)).drop("file_size"),
        lambda df: df.withColumnRenamed("file_name", "name").withColumn("kind", F.coalesce("asset_type", F.lit("none"))).drop("asset_type"),
    ]
    if key not in _made:
        root = f"{shared_dir(spark)}/reelspark-store-{uuid.uuid4().hex}"
        atexit.register(forget, spark, root)
        Store(spark, root).write("videos", t.videos.select("file_id", "file_name", "asset_type", "file_size"))
        Store(spark, root, steps={"videos": steps[:1]}).migrate("videos", 8)
        _made[key] = Store(spark, root, steps={"videos": steps})
        _made[key].migrate("videos", 4)
    return _made[key].read("videos")


def dead_letters(t) -> DataFrame:
    """Items as JSON lines, some cut off, with the reasons why they can't be taken."""
    items = listing.nested(t.items)
    line = F.to_json(F.struct(*items.columns))
    line = F.when(F.col("scan_seq") % 13 == 5, F.substring(line, 1, 40)).otherwise(line)
    lines = items.select(F.col("id").alias("source"), line.alias("record"))
    _, dead = listing.sorted_out(listing.parsed_lines(lines), t.folders.select("id"))
    return dead.groupBy("source", "reason").agg(F.count("*").alias("records"))


def labelled_folders(t) -> DataFrame:
    """The folders with their labels, stored once in their order."""
    at = store_of(t, "labels", lambda x: x.put_part("folders", 0, graph.folder_labels(t.folders), **{"parquet.block.size": 1 << 20}))
    return at.read("folders")


def paths_after_move(t) -> DataFrame:
    """(id, path) below a region after a nation with all that is its own was moved there."""
    after = graph.moved(labelled_folders(t), "n3", "r0")
    return graph.paths_of(graph.subtree(after, "r0"), after)


def event_states(t) -> DataFrame:
    """The table of events as a stream, run to its end through Spark's state store."""
    spark = t.spark
    at = f"{shared_dir(spark)}/reelspark-states-{uuid.uuid4().hex}"
    atexit.register(forget, spark, at)
    events = spark.readStream.schema(t.read("events").schema).parquet(f"{t.sf_dir}/events.parque[t]")  # a pattern, as a stream takes no single file
    query = state.follow(events, f"{at}/out", f"{at}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out")
