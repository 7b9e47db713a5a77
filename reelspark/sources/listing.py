"""Landing files of folder listings: routing, and the rows that the catalogue takes from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import enrich, title
from ..functions.fmt import parsed
from ..functions.text import first_of, is_blank
from ..session import checkpointed

ITEM = (
    "id string, name string, mimeType string, parents array<string>, size string, createdTime string, modifiedTime string, "
    "owners array<struct<displayName string, emailAddress string>>, shortcutDetails struct<targetId string, targetMimeType string>, "
    "driveId string, webViewLink string, trashed boolean, scan_seq bigint, listed_folder_id string, probe string"
)
# MIME types and video extensions.
FOLDER, SHORTCUT = "application/vnd.google-apps.folder", "application/vnd.google-apps.shortcut"
EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".mpeg", ".mpg"]


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Items of a listing's JSON files; no schema inference, trashed items stay out."""
    return spark.read.schema(ITEM).json(path).where(~F.coalesce("trashed", F.lit(False)))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Items of lines (source, record): their columns, and ``record`` and ``source`` beside. A line that is no JSON object of
    an item's form has a null in every column but these and ``broken``, which then says so."""
    form = ITEM + ", _corrupt string"
    rows = lines.select("source", "record", F.from_json("record", form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("item"))
    return rows.select("source", "record", (F.col("item").isNull() | F.col("item._corrupt").isNotNull()).alias("broken"), "item.*").drop("_corrupt")


def sorted_out(rows: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, dead letters (source, id, reason, record)) of parsed_lines(): broken lines, items without an id, those whose
    folder isn't among ``folders`` (id), and files whose size is no number; others of the same file or folder stay."""
    known = folders.select(F.col("id").alias("_folder")).distinct()
    rows = rows.join(known, F.col("listed_folder_id") == F.col("_folder"), "left")
    size = F.coalesce("size", F.lit(""))
    reason = (
        F.when(F.col("broken"), "malformed").when(is_blank(F.col("id")), "no id").when(F.col("_folder").isNull(), "no such folder")
        .when((size != "") & size.try_cast("long").isNull() & ~F.coalesce(F.col("mimeType") == FOLDER, F.lit(False)), "size is no number")
    )
    judged = rows.withColumn("reason", reason)
    names = T.StructType.fromDDL(ITEM).names
    return judged.where("reason is null").select(*names), judged.where("reason is not null").select("source", "id", "reason", "record")


def replayed(dead: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dead letters judged again, after their records were mended or their folders have come: (items, what is still dead)."""
    return sorted_out(parsed_lines(dead.select("source", "record")), folders)


def nested(flat: DataFrame) -> DataFrame:
    """Flat rows of items (owner_name, owner_email, target_id, target_mime ...) as a listing nests them."""
    return flat.select(
        "id", "name", F.col("mime").alias("mimeType"), F.array("listed_folder_id").alias("parents"), "size", F.col("modified").alias("createdTime"),
        F.col("modified").alias("modifiedTime"), F.array(F.struct(F.col("owner_name").alias("displayName"), F.col("owner_email").alias("emailAddress"))).alias("owners"),
        F.struct(F.col("target_id").alias("targetId"), F.col("target_mime").alias("targetMimeType")).alias("shortcutDetails"), F.col("drive_id").alias("driveId"),
        F.col("link").alias("webViewLink"), "trashed", "scan_seq", "listed_folder_id", F.lit(None).cast("string").alias("probe"),
    )


def is_video(mime: Column, name: Column) -> Column:
    return F.coalesce(mime, F.lit("")).startswith("video/") | title.suffix(F.coalesce(name, F.lit(""))).isin(EXTENSIONS)


def routed(items: DataFrame, follow_shortcuts: bool = True) -> DataFrame:
    """items with route (folder, video or drop), and file_id and mime as a followed shortcut's target. A followed
    shortcut without a target is dropped; one that isn't followed is judged by its own name."""
    cut = (F.col("mimeType") == SHORTCUT) & F.lit(follow_shortcuts)
    target = F.col("shortcutDetails.targetId")
    mime = F.when(cut, F.col("shortcutDetails.targetMimeType")).otherwise(F.col("mimeType"))
    rows = items.withColumns({"file_id": F.when(cut, target).otherwise(F.col("id")), "mime": mime})
    route = F.when(cut & is_blank(target), "drop").when(F.col("mime") == FOLDER, "folder").when(is_video(F.col("mime"), F.col("name")), "video").otherwise("drop")
    return rows.withColumn("route", route)


def roots(drives: DataFrame, shared: bool = True) -> DataFrame:
    """(folder_id, drive_id, shared_drive_name): the own drive's root and, if wanted, every shared drive (id, name)."""
    own = drives.sparkSession.range(1).select(F.lit("root").alias("folder_id"), F.lit(None).cast("string").alias("drive_id"), F.lit("").alias("shared_drive_name"))
    if not shared:
        return own
    return own.unionByName(drives.select(F.col("id").alias("folder_id"), F.col("id").alias("drive_id"), F.coalesce("name", "id").alias("shared_drive_name")))


def resolved_root(items: DataFrame, drives: DataFrame, folder_id: str) -> DataFrame:
    """(folder_id, drive_id, folder_name, shared_drive_name) of one folder to begin at: its drive's name, the drive's
    id where the drive isn't known, "Shared" where it has none; no row for an id that isn't listed."""
    d = drives.select(F.col("id").alias("d_id"), F.col("name").alias("d_name"))
    rows = items.where(F.col("id") == folder_id).select(F.col("id").alias("folder_id"), "driveId", F.coalesce("name", "id").alias("folder_name")).distinct()
    rows = rows.join(d, F.col("driveId") == F.col("d_id"), "left")
    return rows.select("folder_id", F.col("driveId").alias("drive_id"), "folder_name", first_of(F.col("d_name"), F.col("driveId"), F.lit("Shared")).alias("shared_drive_name"))


def children(items: DataFrame, folder_id: str) -> DataFrame:
    """What a folder lists: the predicate on parent and trash reaches the scan."""
    return items.where((F.col("listed_folder_id") == folder_id) & ~F.coalesce("trashed", F.lit(False)))


def child_pages(items: DataFrame, size: int = 1000) -> DataFrame:
    """(listed_folder_id, page, items): the pages that folders' listings take, trash left out. The pages of a folder
    put after each other are its children."""
    live = items.where(~F.coalesce("trashed", F.lit(False))).groupBy("listed_folder_id").agg(F.count("*").alias("n"))
    pages = live.select("listed_folder_id", "n", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / size).cast("int"))).alias("page"))
    return pages.select("listed_folder_id", "page", F.least(F.lit(size), F.col("n") - (F.col("page") - 1) * size).cast("long").alias("items"))


def named_parents(items: DataFrame, folders: DataFrame) -> DataFrame:
    """(id, parent_id, parent_name) of items: a parent that no folder row (id, name) names goes by its id."""
    f = folders.select(F.col("id").alias("parent_id"), F.col("name").alias("known"))
    rows = items.select("id", F.col("listed_folder_id").alias("parent_id")).join(f, "parent_id", "left")
    return rows.select("id", "parent_id", first_of(F.col("known"), F.col("parent_id")).alias("parent_name"))


def query_text(text: str) -> str:
    """A name as a listing service's query language quotes it."""
    return text.strip().replace("\\", "\\\\").replace("'", "\\'")


def search_folders(items: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """(folder_id, folder_name, folder_url, shared_drive) of at most ``limit`` folders with the text in their names,
    whatever its case, by name and id."""
    rows = items.where((F.col("mimeType") == FOLDER) & ~F.coalesce("trashed", F.lit(False)) & F.lower("name").contains(text.strip().lower()))
    return _folder_rows(rows).orderBy("folder_name", "folder_id").limit(limit)


def resolve_folder(items: DataFrame, folder_id: str) -> DataFrame:
    """(folder_id, folder_name, folder_url, error) of one id: the error is null for a folder, else says why not."""
    wanted = items.sparkSession.range(1).select(F.lit(folder_id).alias("wanted"))
    rows = wanted.join(items.where(F.col("id") == folder_id).limit(1), F.col("wanted") == F.col("id"), "left")
    error = F.when(F.col("id").isNull(), "no access").when(~F.col("mimeType").eqNullSafe(FOLDER), "not a folder")
    return _folder_rows(rows.withColumns({"error": error, "id": F.col("wanted")}), "error").drop("shared_drive")


def _folder_rows(rows: DataFrame, *more: str) -> DataFrame:
    url = first_of(F.col("webViewLink"), F.concat(F.lit("https://drive.google.com/drive/folders/"), "id"))
    return rows.select(F.col("id").alias("folder_id"), F.coalesce("name", "id").alias("folder_name"), url.alias("folder_url"), (~is_blank(F.col("driveId"))).alias("shared_drive"), *more)


def reachable(items: DataFrame, roots: DataFrame, follow_shortcuts: bool = True) -> DataFrame:
    """(folder_id, level) reachable from roots (folder_id): breadth first over folder items and, if they are followed,
    shortcuts to folders, each folder once, until a level brings none; every level is written before the next."""
    links = routed(items.where(~F.coalesce("trashed", F.lit(False))), follow_shortcuts).where("route = 'folder'")
    links = checkpointed(links.select(F.col("listed_folder_id").alias("folder_id"), F.col("file_id").alias("child")).distinct())
    seen = checkpointed(roots.select("folder_id").distinct().withColumn("level", F.lit(0)))
    depth = 0
    while True:
        last = seen.where(F.col("level") == depth).select("folder_id")
        fresh = links.join(last, "folder_id", "left_semi").select(F.col("child").alias("folder_id")).distinct()
        depth += 1
        fresh = checkpointed(fresh.join(seen, "folder_id", "left_anti").withColumn("level", F.lit(depth)))
        if not fresh.limit(1).count():
            return seen
        seen = checkpointed(seen.unionByName(fresh)) if depth % 8 == 0 else seen.unionByName(fresh)


def crawl(items: DataFrame, roots: DataFrame, follow_shortcuts: bool = True) -> DataFrame:
    """The routed video items that the folders reachable from roots list. One listed in several places comes as often."""
    live = routed(items.where(~F.coalesce("trashed", F.lit(False))), follow_shortcuts).where("route = 'video'")
    return live.join(reachable(items, roots, follow_shortcuts).select(F.col("folder_id").alias("listed_folder_id")), "listed_folder_id", "left_semi")


def to_probe(size: Column, most_mb: float, enabled: bool = True) -> Column:
    """Whether a file is probed: the gate is open and the size, 0 where it isn't known, not above it."""
    return F.lit(enabled and most_mb > 0) & (F.coalesce(size, F.lit(0)) / (1024 * 1024) <= most_mb)


def owner_of(owners: Column) -> Column:
    o = F.get(owners, F.lit(0))
    return first_of(o["emailAddress"], o["displayName"])


def records(videos: DataFrame, paths: DataFrame, drives: DataFrame, now: str, most_mb: float | None = None) -> DataFrame:
    """Catalogue rows of routed video items; paths (id, path), drives (id, name). A size that is no number
    sets scan_status to error instead of stopping the scan. most_mb: files that the probe gate of this size keeps out have
    no probe; None: there is no gate, listings bring probes as they are."""
    p = paths.select(F.col("id").alias("listed_folder_id"), "path")
    d = drives.select(F.col("id").alias("driveId"), F.col("name").alias("drive"))
    rows = videos.join(p, "listed_folder_id", "left").join(d, "driveId", "left")
    name, folder = F.coalesce("name", F.lit("")), F.coalesce("path", F.lit(""))
    size = F.when(F.coalesce("size", F.lit("")) == "", F.lit(0)).otherwise(F.col("size").try_cast("long"))
    rows = rows.select(
        "file_id", name.alias("file_name"), folder.alias("folder_path"), title.base_name(folder).alias("parent_folder"),
        F.coalesce("drive", "driveId", F.lit("")).alias("shared_drive_name"), owner_of(F.col("owners")).alias("owner"),
        first_of(F.col("webViewLink"), F.concat(F.lit("https://drive.google.com/file/d/"), "file_id", F.lit("/view"))).alias("drive_url"),
        F.col("mime").alias("mime_type"), title.suffix(name).alias("file_extension"), size.alias("file_size"),
        F.coalesce("createdTime", F.lit("")).alias("created_at"), F.coalesce("modifiedTime", F.lit("")).alias("modified_at"),
        F.lit(now).alias("last_scanned_at"), F.when(size.isNull(), "error").otherwise("indexed").alias("scan_status"),
        F.when(size.isNull(), "size is no number").otherwise("").alias("error_message"), "scan_seq",
        (F.coalesce("probe", F.lit("{}")) if most_mb is None else F.when(to_probe(size, most_mb), F.coalesce("probe", F.lit("{}"))).otherwise("{}")).alias("_probe"),
    )
    return parsed(rows, F.col("_probe"), "_media").select("*", "_media.*").drop("_media", "_probe")


def enriched(rows: DataFrame) -> DataFrame:
    """rows with the attributes that rules derive from name and folder."""
    name, folder = F.col("file_name"), F.col("folder_path")
    rows = rows.withColumns({"_w": title.tokens(name), "_c": enrich.context(name, folder)})
    rows = rows.withColumns({"speaker": title.speaker(F.col("_w")), "main_theme": enrich.main_theme(F.col("_c")), "teaching_type": enrich.teaching_type(F.col("_c")), "_t": enrich.topics(F.col("_c"))})
    joined = lambda c: F.array_join(c, "; ")
    return rows.withColumns({
        "clean_title": title.clean_title(name, F.col("_w"), title.year(name), F.col("speaker")),
        "normalized_name": title.normalized_name(F.col("_w")), "ministry": enrich.ministry(folder),
        "biblical_topics": joined(F.col("_t")), "keywords": joined(title.keywords(F.col("_w"), folder)),
        "bible_references": joined(enrich.references(F.concat_ws(" ", name, folder))),
        "semantic_tags": joined(enrich.semantic_tags(F.col("main_theme"), F.col("teaching_type"), F.col("_t"))),
    }).drop("_w", "_c", "_t")


def scan_counts(outcomes: DataFrame) -> DataFrame:
    """(found, indexed, skipped, errors) over an ``outcome`` column."""
    of = lambda k: F.count_if(F.col("outcome") == k)
    return outcomes.agg(F.count("*").alias("found"), of("indexed").alias("indexed"), of("skipped").alias("skipped"), of("error").alias("errors"))
