"""Catalogue changes as DataFrame algebra: upsert, ids, edits, set replacement, cascade, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, is_blank, label_key, split_terms, stripped, term_key
from ..schema import ASSET_TYPES, EDITABLE, LEXICON, PROTECTED, STAGES
from ..session import checkpointed


def changed(incoming: DataFrame, state: DataFrame, key: str = "file_id", stamp: str = "modified_at") -> DataFrame:
    """Rows of incoming whose (key, stamp) isn't in state: what a rescan has to process."""
    s = state.select(F.col(key).alias("_k"), F.coalesce(stamp, F.lit("")).alias("_s"))
    return incoming.join(s, (F.col(key) == F.col("_k")) & (F.coalesce(stamp, F.lit("")) == F.col("_s")), "left_anti")


def last_of(incoming: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, that of the greatest ``order``: the last write of a batch wins. Pre-aggregated."""
    rest = [c for c in incoming.columns if c != key]
    return incoming.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*incoming.columns)


def upsert(current: DataFrame, incoming: DataFrame, key: str = "file_id", keep: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """current with incoming merged in (one row a key each): known keys take the incoming values but in ``keep``
    columns; new keys come in whole, with first_seen_at set to ``now`` where it is blank."""
    keep = PROTECTED if keep is None else keep
    cols = current.columns
    new = incoming.select(F.col(key), F.struct(*(F.col(c) for c in cols)).alias("n"))
    old = current.select(F.col(key), F.struct(*(F.col(c) for c in cols)).alias("o"))
    joined = old.join(new, key, "full_outer")

    def value(c: str) -> Column:
        inserted = F.col(f"n.{c}")
        if c == "first_seen_at" and now is not None:
            inserted = F.when(is_blank(inserted), now).otherwise(inserted)
        updated = F.col(f"o.{c}") if c in keep or c == key else F.col(f"n.{c}")
        return F.when(F.col("o").isNull(), inserted).when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(updated).alias(c)

    return joined.select(*(F.col(key) if c == key else value(c) for c in cols))


def assign_ids(files: DataFrame, known: DataFrame, high_water: int, order: str = "scan_seq", pattern: str = "CHR-VID-%06d") -> DataFrame:
    """(id, file_id, internal_video_id) for files not in known, numbered by ``order`` from high_water + 1.

    Numbers are given in two steps, so no task holds all rows: a range partition each numbers its own rows, and
    the partitions' offsets (one row a partition) are joined on.
    """
    fresh = files.join(known.select("file_id"), "file_id", "left_anti").select("file_id", order)
    first = fresh.groupBy("file_id").agg(F.min(order).alias(order))
    parts = max(1, first.sparkSession.sparkContext.defaultParallelism)
    ranged = first.repartitionByRange(parts, order, "file_id").sortWithinPartitions(order, "file_id")
    ranged = ranged.withColumn("_m", F.monotonically_increasing_id())  # partition number, then the row's place there
    ranged = ranged.select("file_id", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_i"))
    ranged = checkpointed(ranged)  # both uses below must see one and the same cut into ranges
    sizes = ranged.groupBy("_p").agg(F.max("_i").alias("_n"))
    before = F.coalesce(F.sum(F.col("_n") + 1).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p")  # a row a partition
    number = F.col("_b") + F.col("_i") + 1 + high_water
    return numbered.select(number.alias("id"), "file_id", F.format_string(pattern, number).alias("internal_video_id"))


def edit(videos: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """videos with edits (file_id, field, value; a field once a file) applied: only editable fields count, values are
    trimmed, null is empty, a confidence that is no number becomes null; two stamps follow."""
    known = edits.where(F.col("field").isin(EDITABLE)).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_e"))

    def value(c: str) -> Column:
        new = stripped(F.coalesce(F.try_element_at("_e", F.lit(c)), F.lit("")))
        new = new.try_cast("double") if c == "metadata_confidence" else new
        return F.when(F.coalesce(F.map_contains_key("_e", c), F.lit(False)), new).otherwise(F.col(c)).alias(c)

    touched = F.col("_e").isNotNull()
    rows = videos.join(known, "file_id", "left")
    stamps = {c: F.when(touched, now).otherwise(F.col(c)) for c in ("metadata_updated_at", "reviewed_at") if c in videos.columns}
    return rows.select(*(value(c) if c in EDITABLE else stamps.get(c, F.col(c)).alias(c) for c in videos.columns))


def _asked(changes: DataFrame) -> DataFrame:
    """changes with trimmed values, blank type and stage as their defaults, and no source for raw files."""
    clean = lambda c: stripped(F.coalesce(F.col(c), F.lit(""))) if c in changes.columns else F.lit("")
    kind = F.coalesce(F.nullif(F.col("asset_type"), F.lit("")), F.lit("raw"))
    kind, stage = stripped(kind), stripped(F.coalesce(F.nullif(F.col("workflow_stage"), F.lit("")), F.lit("digitized")))
    source = F.when(kind == "raw", "").otherwise(clean("source_file_id"))
    return changes.select("file_id", kind.alias("asset_type"), stage.alias("workflow_stage"), source.alias("source_file_id"), clean("workflow_notes").alias("workflow_notes"))


def workflow_errors(changes: DataFrame, videos: DataFrame) -> DataFrame:
    """changes (file_id, asset_type, workflow_stage, source_file_id, workflow_notes) as they will be applied, with
    ``error``, null where they are valid."""
    files = videos.select(F.col("file_id").alias("_f"))
    raw = videos.where("asset_type = 'raw'").select(F.col("file_id").alias("_s"))
    asked = _asked(changes)
    rows = asked.join(files, asked["file_id"] == files["_f"], "left").join(raw, asked["source_file_id"] == raw["_s"], "left")
    error = (
        F.when(~F.col("asset_type").isin(ASSET_TYPES), "asset type")
        .when(~F.col("workflow_stage").isin(STAGES), "stage")
        .when(F.col("source_file_id") == F.col("file_id"), "self link")
        .when(F.col("_f").isNull(), "unknown file")
        .when((F.col("source_file_id") != "") & F.col("_s").isNull(), "source is missing or no raw file")
    )
    return rows.select(*asked.columns, error.alias("error"))


def update_workflow(videos: DataFrame, changes: DataFrame, now: Column, known: DataFrame | None = None) -> DataFrame:
    """videos with the valid changes (one a file) applied; a raw file loses its source; two stamps follow. known: the
    whole catalogue that changes are judged against, where videos is a part of it."""
    held = ["asset_type", "workflow_stage", "source_file_id", "workflow_notes", "workflow_updated_at", "reviewed_at"]
    good = workflow_errors(changes, videos if known is None else known).where("error is null").withColumns({"workflow_updated_at": now, "reviewed_at": now})
    new = good.select("file_id", F.struct(*held).alias("_w"))
    rows = videos.join(new, "file_id", "left")
    value = lambda c: F.when(F.col("_w").isNotNull(), F.col(f"_w.{c}")).otherwise(F.col(c))
    return rows.select(*(value(c).alias(c) if c in held else F.col(c) for c in videos.columns))


def replace_labels(video_labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, label_id): files in wanted (file_id, label_id; null label: none) have just its labels, other
    files keep theirs."""
    kept = video_labels.select("file_id", "label_id").join(wanted.select("file_id"), "file_id", "left_anti")
    return kept.union(wanted.where("label_id is not null").select("file_id", "label_id").distinct())


def label_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, added, removed) of files (file_id, labels array) whose label sets differ; sorted arrays."""
    b, a = before.select("file_id", F.col("labels").alias("b")), after.select("file_id", F.col("labels").alias("a"))
    none = F.array().cast("array<string>")
    both = b.join(a, "file_id", "full_outer").select("file_id", F.coalesce("b", none).alias("b"), F.coalesce("a", none).alias("a"))
    diff = both.select("file_id", F.array_sort(F.array_except("a", "b")).alias("added"), F.array_sort(F.array_except("b", "a")).alias("removed"))
    return diff.where((F.size("added") > 0) | (F.size("removed") > 0))


def set_labels(videos: DataFrame, labels: DataFrame, video_labels: DataFrame, wanted: DataFrame, user: str, now: Column, high_water: int) -> dict[str, DataFrame]:
    """Set the labels of files to wanted (file_id, names array): the tables labels (id, name, normalized_name) without
    those no file has any more, video_labels, videos with reviewed_at, and history, a row for each file whose set of
    label keys differs. Names are cleaned; of those with one key the first stays; unknown files are left out."""
    known = wanted.join(videos.select("file_id"), "file_id", "left_semi")
    asked = known.select("file_id", F.posexplode_outer("names").alias("at", "name")).withColumn("name", collapse(F.col("name")))
    asked = asked.withColumn("normalized_name", F.when(F.col("name") != "", label_key(F.col("name"))))
    first = asked.where("normalized_name is not null").groupBy("file_id", "normalized_name").agg(F.min_by("name", "at").alias("name"))
    first = checkpointed(first)  # read by four of what follows
    dimension = get_or_create(labels, first, label_key, high_water)
    links = first.join(dimension.select(F.col("id").alias("label_id"), "normalized_name"), "normalized_name").select("file_id", "label_id")
    bridge = video_labels.select("file_id", "label_id").join(known, "file_id", "left_anti").union(links)
    names = labels.select(F.col("id").alias("label_id"), F.col("name").alias("old"), F.col("normalized_name").alias("key"))
    before = video_labels.join(known.select("file_id"), "file_id", "left_semi").join(names, "label_id").select("file_id", "key", F.col("old").alias("b"), F.lit(None).cast("string").alias("a"))
    after = first.select("file_id", F.col("normalized_name").alias("key"), F.lit(None).cast("string").alias("b"), F.col("name").alias("a"))
    both = before.union(after).groupBy("file_id", "key").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    listed = lambda c, test=None: F.array_sort(F.collect_list(F.when(F.lit(True) if test is None else test, F.col(c))))
    log = both.groupBy("file_id").agg(listed("b").alias("before_labels"), listed("a").alias("after_labels"), listed("a", F.col("b").isNull()).alias("added_labels"), listed("b", F.col("a").isNull()).alias("removed_labels"))
    log = log.where((F.size("added_labels") > 0) | (F.size("removed_labels") > 0)).withColumns({"user_email": F.lit(user), "created_at": now})
    seen = known.select("file_id", F.lit(True).alias("_seen")).distinct()
    stamped = videos.join(seen, "file_id", "left").withColumn("reviewed_at", F.when(F.col("_seen"), now).otherwise(F.col("reviewed_at"))).select(*videos.columns)
    used = dimension.join(bridge, dimension["id"] == bridge["label_id"], "left_semi")
    return {"videos": stamped, "labels": used, "video_labels": bridge, "history": log}


def put_settings(settings: DataFrame, values: DataFrame, now: Column, user: str | None = None) -> DataFrame:
    """settings (key, value, updated_by_email, updated_at) with values (key, value) put in. With a user, they are
    named as who did it; without one, a known key keeps whom it names."""
    new = values.select(F.col("key").alias("k"), F.col("value").alias("v"))
    rows = settings.join(new, F.col("key") == F.col("k"), "full_outer")
    changed = F.col("k").isNotNull()
    who = F.when(changed, F.lit(user)).otherwise(F.col("updated_by_email")) if user is not None else F.coalesce("updated_by_email", F.lit(""))
    return rows.select(
        F.coalesce("k", "key").alias("key"), F.when(changed, F.col("v")).otherwise(F.col("value")).alias("value"),
        who.alias("updated_by_email"), F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def sync_terms(videos: DataFrame, terms: DataFrame, bridge: DataFrame, changed: DataFrame, high_water: int) -> dict[str, DataFrame]:
    """terms (id, category, term, normalized_term) and bridge (file_id, term_id, source, confidence, evidence) after the
    changed files (file_id) have had their manual terms of LEXICON's categories deleted and made anew from its fields.
    Of one spelling of a term key in a category the least makes a new term."""
    rows = videos.join(changed.select("file_id"), "file_id", "left_semi")
    found = manual_terms(rows, LEXICON).withColumnRenamed("key", "normalized_term")
    found = checkpointed(found.join(rows.select("file_id", F.col("metadata_confidence").alias("confidence")), "file_id"))
    new = found.groupBy("category", "normalized_term").agg(F.min("term").alias("term")).join(terms, ["category", "normalized_term"], "left_anti")
    named = new.withColumn("name", F.concat_ws("\n", "category", "normalized_term"))
    ids = assign_ids(named.select(F.col("name").alias("file_id"), F.lit(0).alias("scan_seq")), named.limit(0).select(F.col("name").alias("file_id")), high_water)
    added = named.join(ids.select("id", F.col("file_id").alias("name")), "name").select("id", "category", "term", "normalized_term")
    dimension = terms.select("id", "category", "term", "normalized_term").unionByName(added)
    managed = terms.where(F.col("category").isin(sorted(set(LEXICON.values())))).select(F.col("id").alias("term_id"))
    own = bridge.where("source = 'manual'").join(changed.select("file_id"), "file_id", "left_semi").join(managed, "term_id", "left_semi").select("file_id", "term_id", "source")
    kept = bridge.join(own, ["file_id", "term_id", "source"], "left_anti")
    links = found.join(dimension.select(F.col("id").alias("term_id"), "category", "normalized_term"), ["category", "normalized_term"])
    links = links.select("file_id", "term_id", F.lit("manual").alias("source"), "confidence", "evidence")
    return {"terms": dimension, "bridge": kept.select(*links.columns).unionByName(links)}


def get_or_create(dimension: DataFrame, names: DataFrame, key, high_water: int) -> DataFrame:
    """dimension (id, name, normalized_name) and the names (name) it lacks, first spelling of each key; ids go
    on from high_water."""
    rows = names.select(collapse(F.col("name")).alias("name")).where(~is_blank(F.col("name")))
    new = rows.withColumn("normalized_name", key(F.col("name"))).groupBy("normalized_name").agg(F.min("name").alias("name"))
    new = new.join(dimension.select("normalized_name"), "normalized_name", "left_anti")
    ids = assign_ids(new.select(F.col("normalized_name").alias("file_id"), F.lit(0).alias("scan_seq")), new.limit(0).select(F.col("name").alias("file_id")), high_water)
    joined = new.join(ids, new["normalized_name"] == ids["file_id"])
    return dimension.select("id", "name", "normalized_name").union(joined.select("id", "name", "normalized_name"))


def cascade_delete(tables: dict[str, DataFrame], prefix: str) -> dict[str, DataFrame]:
    """All tables without the files whose id begins with prefix: their labels, ids, tokens go, cuts lose such a
    source, and labels that no file has any more go too."""
    gone = lambda c: F.coalesce(F.col(c).startswith(prefix), F.lit(False))
    out = {name: t.where(~gone("file_id")) if "file_id" in t.columns else t for name, t in tables.items()}
    if "videos" in out:
        out["videos"] = out["videos"].withColumn("source_file_id", F.when(gone("source_file_id"), "").otherwise(F.col("source_file_id")))
    if "labels" in out and "video_labels" in out:
        out["labels"] = out["labels"].join(out["video_labels"], out["labels"]["id"] == out["video_labels"]["label_id"], "left_semi")
    return out


def manual_terms(videos: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(file_id, category, key, term, evidence) of the list texts in ``fields`` (column -> category): of a file,
    category and term key the first field and spelling wins."""
    rows = videos.select("file_id", F.explode(F.array(*(
        F.struct(F.lit(i).alias("at"), F.lit(cat).alias("category"), F.lit(col).alias("evidence"), split_terms(F.coalesce(F.col(col), F.lit(""))).alias("terms"))
        for i, (col, cat) in enumerate(fields.items())
    ))).alias("f")).select("file_id", "f.*")
    rows = rows.select("file_id", "at", "category", "evidence", F.posexplode("terms").alias("pos", "term"))
    rows = rows.withColumn("key", term_key(F.col("term")))
    best = rows.groupBy("file_id", "category", "key").agg(F.min_by(F.struct("term", "evidence"), F.struct("at", "pos")).alias("b"))
    return best.select("file_id", "category", "key", "b.term", "b.evidence")
