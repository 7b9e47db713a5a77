"""Folder trees: paths from parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, path, depth) of folders (id, name, parent_id). A folder without a parent, or whose parent isn't
    listed, begins a path; a link that would close a cycle is not followed, so the path starts there.

    Pointer doubling: each round joins every open chain of ancestors with the chain of the folder it ends at, so
    chains double in length and rounds grow with the logarithm of the depth, which has no cap. A round is written
    before the next, so lineage doesn't grow either.
    """
    names = F.transform(F.reverse("chain"), lambda c: c["name"])
    return _chains(folders).select("id", F.concat(F.lit("/"), F.array_join(names, "/")).alias("path"), F.size("chain").alias("depth"))


def _chains(folders: DataFrame) -> DataFrame:
    """(id, chain array<struct<id, name>>): each folder with its ancestors, itself first."""
    nodes = folders.groupBy("id").agg(F.min(F.struct("name", "parent_id")).alias("n")).select("id", "n.*")
    chain = F.array(F.struct("id", "name"))
    rows = checkpointed(nodes.select("id", chain.alias("chain"), F.col("parent_id").alias("next")))
    while rows.where("next is not null").limit(1).count():
        above = rows.select(F.col("id").alias("up"), F.col("chain").alias("more"), F.col("next").alias("up_next"))
        joined = rows.join(above, F.col("next") == F.col("up"), "left")
        # the first of the further ancestors that the chain has already: there a cycle closes
        again = F.expr("array_position(transform(more, m -> exists(chain, c -> c.id = m.id)), true)")
        longer = F.when(F.col("up").isNull(), F.col("chain")).when(again > 0, F.concat("chain", F.slice("more", F.lit(1), again.cast("int") - 1))).otherwise(F.concat("chain", "more"))
        rows = checkpointed(joined.select("id", longer.alias("chain"), F.when(again == 0, F.col("up_next")).alias("next")))
    return rows.select("id", "chain")


#: What follows the mark between a label's ids: labels from "x/" up to "x0" are those below x.
MARK, NEXT = "/", "0"


def folder_labels(folders: DataFrame) -> DataFrame:
    """(id, name, label) sorted by label: the ids from the root down. A subtree's labels are one interval, so what lies
    below a folder is a range of the rows, which a scan of a sorted table skips to; a rename changes no label, and a move
    those of the subtree only. Ids hold no slash."""
    ids = F.transform(F.reverse("chain"), lambda c: c["id"])
    rows = _chains(folders).select("id", F.get("chain", F.lit(0))["name"].alias("name"), F.concat(F.array_join(ids, MARK), F.lit(MARK)).alias("label"))
    return rows.repartitionByRange("label").sortWithinPartitions("label")


def label_of(labels: DataFrame, folder_id: str) -> str | None:
    row = labels.where(F.col("id") == folder_id).select("label").first()
    return row.label if row else None


def subtree(labels: DataFrame, folder_id: str) -> DataFrame:
    """The rows of folder_labels() of a folder and all below it, by one range of labels; none if it isn't there."""
    at = label_of(labels, folder_id)
    if at is None:
        return labels.limit(0)
    return labels.where((F.col("label") >= at) & (F.col("label") < at[:-1] + NEXT))


def files_below(files: DataFrame, labels: DataFrame, folder_id: str, folder_col: str = "listed_folder_id") -> DataFrame:
    """The files listed by a folder or any below it."""
    here = subtree(labels, folder_id).select(F.col("id").alias("_below"))
    return files.join(here, F.col(folder_col) == F.col("_below"), "left_semi")


def moved(labels: DataFrame, folder_id: str, parent_id: str | None) -> DataFrame:
    """labels after a folder was put below another, or at the top (None): its subtree's labels begin anew, no other row
    changes. ValueError for a folder that isn't there, or one that would come to lie below itself."""
    old, above = label_of(labels, folder_id), "" if parent_id is None else label_of(labels, parent_id)
    if old is None or above is None:
        raise ValueError("no such folder")
    if above.startswith(old):
        raise ValueError("a folder can't lie below itself")
    below = (F.col("label") >= old) & (F.col("label") < old[:-1] + NEXT)
    label = F.concat(F.lit(above + folder_id + MARK), F.substring("label", len(old) + 1, 1 << 30))
    return labels.withColumn("label", F.when(below, label).otherwise(F.col("label")))


def paths_of(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, path) of some rows of folder_labels(): names are looked up for their ancestors only."""
    steps = rows.select("id", F.posexplode(F.filter(F.split("label", MARK), lambda x: x != "")).alias("depth", "_at"))
    named = steps.join(labels.select(F.col("id").alias("_at"), "name"), "_at")
    named = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("names"))
    return named.select("id", F.concat(F.lit("/"), F.array_join(F.transform("names", lambda x: x["name"]), "/")).alias("path"))


def rollup_by_folder(videos: DataFrame) -> DataFrame:
    """(folder, videos, bytes): every folder with all that lies below it."""
    parts = F.filter(F.split("folder_path", "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    rows = videos.select("file_size", parts.alias("p"), F.col("folder_path")).where(F.size("p") > 0)
    rows = rows.select("file_size", F.explode(prefixes).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("videos"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))
