"""Queries over listings: roots, crawl, routing, folders, records, scan counts, enrichment, index upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, merge, search, stats
from ..session import spread
from ..sources import listing
from . import stored
from .queries import _C, _CASED, _I, _T, _TOPICS, Tables, _case, _has, align_searched, enrich, query

FOLDER, SHORTCUT = listing.FOLDER, listing.SHORTCUT
#: Items with their route, as SQL: rt for followed shortcuts, ru for others.
_SUFFIX = "lower(regexp_extract(name, '.(\\.[^.]+)$', 1))"
_VIDEO = "coalesce(starts_with({m}, 'video/'), false) OR " + _SUFFIX + " IN (" + ", ".join(f"'{e}'" for e in listing.EXTENSIONS) + ")"
_ROUTED = f""", rt AS (SELECT *, CASE WHEN mime = '{SHORTCUT}' AND coalesce(target_id, '') = '' THEN 'drop' WHEN m = '{FOLDER}' THEN 'folder' WHEN {_VIDEO.format(m='m')} THEN 'video' ELSE 'drop' END AS route
    FROM (SELECT *, CASE WHEN mime = '{SHORTCUT}' THEN target_id ELSE id END AS file_id, CASE WHEN mime = '{SHORTCUT}' THEN target_mime ELSE mime END AS m FROM items)),
ru AS (SELECT *, id AS file_id, CASE WHEN mime = '{FOLDER}' THEN 'folder' WHEN {_VIDEO.format(m='mime')} THEN 'video' ELSE 'drop' END AS route FROM items),
links AS (SELECT DISTINCT listed_folder_id AS p, file_id AS c FROM rt WHERE route = 'folder' AND NOT trashed)
"""
_WALK = ", walk(folder_id, level) AS (SELECT 'r0', 0 UNION SELECT c, level + 1 FROM walk JOIN links ON p = folder_id WHERE level < 9)\n"


def _items(t: Tables) -> DataFrame:
    return listing.nested(t.items)


def _root(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT 'r0' AS folder_id")


query("list_roots", lambda t: listing.roots(t.drives), "SELECT 'root' AS folder_id, CAST(NULL AS VARCHAR) AS drive_id, '' AS shared_drive_name UNION ALL SELECT id, id, coalesce(name, id) FROM drives", "drives")
query("routed_items", lambda t: listing.routed(_items(t)).select("id", "file_id", "route"), _ROUTED + "SELECT id, file_id, route FROM rt", "items")
query("routed_unfollowed", lambda t: listing.routed(_items(t), False).select("id", "file_id", "route"), _ROUTED + "SELECT id, file_id, route FROM ru", "items")
query("crawl_folders", lambda t: listing.reachable(_items(t), _root(t)), _ROUTED + _WALK + "SELECT folder_id, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY 1", "items")
query("crawl_videos", lambda t: listing.crawl(_items(t), _root(t)).select("file_id", "listed_folder_id"),
      _ROUTED + _WALK + "SELECT file_id, listed_folder_id FROM rt WHERE route = 'video' AND NOT trashed AND listed_folder_id IN (SELECT folder_id FROM walk)", "items")
query("folder_children", lambda t: listing.children(_items(t), "n3").select("id", "name"), "SELECT id, name FROM items WHERE listed_folder_id = 'n3' AND NOT trashed", "items")
query("child_pages", lambda t: listing.child_pages(_items(t), 7),
      ", c AS (SELECT listed_folder_id, count(*) AS n FROM items WHERE NOT trashed GROUP BY 1), p AS (SELECT *, unnest(range(1, CAST(ceil(n / 7) AS BIGINT) + 1)) AS page FROM c) SELECT listed_folder_id, CAST(page AS INTEGER) AS page, least(7, n - (page - 1) * 7) AS items FROM p", "items")


def _several(one, *ids: str):
    def make(t: Tables) -> DataFrame:
        out = one(t, ids[0])
        for i in ids[1:]:
            out = out.unionByName(one(t, i))
        return out

    return make


query("resolved_root", _several(lambda t, i: listing.resolved_root(_items(t), t.drives, i), "n3", "v9", "v7", "v13", "nope"),
      "SELECT i.id AS folder_id, drive_id, coalesce(i.name, i.id) AS folder_name, coalesce(d.name, drive_id, 'Shared') AS shared_drive_name FROM items i LEFT JOIN drives d ON d.id = drive_id WHERE i.id IN ('n3', 'v9', 'v7', 'v13')", "items", "drives")
query("named_parents", lambda t: listing.named_parents(_items(t), t.folders), "SELECT i.id, listed_folder_id AS parent_id, coalesce(f.name, listed_folder_id) AS parent_name FROM items i LEFT JOIN folders f ON f.id = listed_folder_id", "items", "folders")
query("search_folders", lambda t: listing.search_folders(_items(t), " An "),
      f"SELECT id AS folder_id, name AS folder_name, 'https://drive.google.com/drive/folders/' || id AS folder_url, coalesce(drive_id, '') <> '' AS shared_drive FROM items WHERE mime = '{FOLDER}' AND NOT trashed AND contains(lower(name), 'an') ORDER BY name, id LIMIT 30", "items")
query("resolve_folder", _several(lambda t, i: listing.resolve_folder(_items(t), i), "n3", "v8", "nope"),
      f"SELECT w AS folder_id, coalesce(name, w) AS folder_name, coalesce(nullif(link, ''), 'https://drive.google.com/drive/folders/' || w) AS folder_url, CASE WHEN id IS NULL THEN 'no access' WHEN mime <> '{FOLDER}' THEN 'not a folder' END AS error FROM (SELECT unnest(['n3', 'v8', 'nope']) AS w) LEFT JOIN items ON id = w", "items")

_RECORD = ["file_id", "file_name", "folder_path", "parent_folder", "shared_drive_name", "owner", "drive_url", "mime_type", "file_extension", "file_size", "modified_at", "scan_status", "scan_seq"]


def _records(t: Tables) -> DataFrame:
    videos = listing.routed(_items(t).where("not trashed")).where("route = 'video'")
    return listing.records(videos, graph.folder_paths(t.folders), t.drives, "2024-01-01 00:00:00")


_PATHS = """, pp AS (SELECT id, path FROM (WITH RECURSIVE up(id, path, next, depth) AS (SELECT id, '/' || name, parent_id, 1 FROM folders UNION ALL SELECT up.id, '/' || f.name || up.path, f.parent_id, up.depth + 1 FROM up JOIN folders f ON f.id = up.next)
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS k FROM up) WHERE k = 1),
rec AS (SELECT file_id, rt.name AS file_name, coalesce(path, '') AS folder_path, coalesce(string_split(path, '/')[-1], '') AS parent_folder, coalesce(d.name, drive_id, '') AS shared_drive_name,
    coalesce(nullif(owner_email, ''), owner_name) AS owner, coalesce(nullif(link, ''), 'https://drive.google.com/file/d/' || file_id || '/view') AS drive_url, m AS mime_type,
    lower(regexp_extract(rt.name, '.(\\.[^.]+)$', 1)) AS file_extension, CASE WHEN coalesce(size, '') = '' THEN 0 ELSE TRY_CAST(size AS BIGINT) END AS file_size, modified AS modified_at,
    CASE WHEN size = 'junk' THEN 'error' ELSE 'indexed' END AS scan_status, scan_seq
    FROM rt LEFT JOIN pp ON pp.id = listed_folder_id LEFT JOIN drives d ON d.id = drive_id WHERE route = 'video' AND NOT trashed)
"""
query("scan_records", lambda t: _records(t).select(*_RECORD), _ROUTED + _PATHS + "SELECT * FROM rec", "items", "drives", "folders")
query("last_write_wins", lambda t: merge.last_of(_records(t).select(*_RECORD), "file_id", "scan_seq").select("file_id", "file_name", "scan_seq"),
      _ROUTED + _PATHS + "SELECT file_id, arg_max(file_name, scan_seq) AS file_name, max(scan_seq) AS scan_seq FROM rec GROUP BY 1", "items", "drives", "folders")


def _counts(full: bool):
    def make(t: Tables) -> DataFrame:
        from ..streaming.rescan import outcomes

        state = t.read("documents").where("doc_id % 3 = 0").select(F.concat(F.lit("v"), "doc_id").alias("file_id"), F.concat((2010 + F.col("doc_id") % 15).cast("string"), F.lit("-01-01T00:00:00Z")).alias("modified_at"))
        rows = merge.last_of(_records(t), "file_id", "scan_seq")
        return listing.scan_counts(outcomes(rows, state, full))

    return make


_STATE = ", st AS (SELECT 'v' || doc_id AS f, CAST(2010 + doc_id % 15 AS VARCHAR) || '-01-01T00:00:00Z' AS s FROM documents WHERE doc_id % 3 = 0), lw AS (SELECT file_id, arg_max(scan_status, scan_seq) AS status, arg_max(modified_at, scan_seq) AS stamp FROM rec GROUP BY 1)"
_COUNTS = _ROUTED + _PATHS + _STATE + " SELECT count(*) AS found, count(*) FILTER (WHERE status <> 'error' AND {new}) AS indexed, count(*) FILTER (WHERE status <> 'error' AND NOT {new}) AS skipped, count(*) FILTER (WHERE status = 'error') AS errors FROM lw LEFT JOIN st ON f = file_id AND s = stamp"
query("scan_counts", _counts(False), _COUNTS.format(new="(f IS NULL)"), "items", "drives", "folders")
query("scan_counts_full", _counts(True), _COUNTS.format(new="true"), "items", "drives", "folders")
query("probe_gate", lambda t: t.videos.select("file_id", listing.to_probe(F.col("file_size"), 1.5).alias("probe"), listing.to_probe(F.col("file_size"), 0).alias("closed")),
      "SELECT file_id, coalesce(file_size, 0) / 1048576 <= 1.5 AS probe, false AS closed FROM videos", "videos")
query("safe_names", lambda t: t.names.select("id", text.safe_name(F.col("file_name")).alias("safe")), "SELECT id, regexp_replace(file_name, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM names", "names")
_OFF = _ROUTED.replace("FROM rt WHERE", "FROM ru WHERE") + _WALK
query("crawl_folders_unfollowed", lambda t: listing.reachable(_items(t), _root(t), False), _OFF + "SELECT folder_id, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY 1", "items")
query("crawl_videos_unfollowed", lambda t: listing.crawl(_items(t), _root(t), False).select("file_id", "listed_folder_id"),
      _OFF + "SELECT file_id, listed_folder_id FROM ru WHERE route = 'video' AND NOT trashed AND listed_folder_id IN (SELECT folder_id FROM walk)", "items")


def _gated(t: Tables) -> DataFrame:
    probe = F.lit('{"streams":[{"codec_type":"video","width":1920,"height":1080}]}')
    videos = listing.routed(_items(t).where("not trashed").withColumn("probe", probe)).where("route = 'video'")
    rows = listing.records(videos, graph.folder_paths(t.folders), t.drives, "2024-01-01 00:00:00", 1.5)
    return rows.select("file_id", "scan_seq", F.coalesce("resolution", F.lit("")).alias("resolution"))


_BELOW = ", below(id) AS (SELECT '{0}' UNION SELECT f.id FROM folders f JOIN below b ON f.parent_id = b.id)\n"
query("subtree_folders", lambda t: graph.subtree(stored.labelled_folders(t), "r1").select("id", "name"), _BELOW.format("r1") + "SELECT id, name FROM folders WHERE id IN (SELECT id FROM below)", "folders")
query("subtree_files", lambda t: graph.files_below(_items(t).where(f"mimeType <> '{FOLDER}'"), stored.labelled_folders(t), "r2").select("id", "name"),
      _BELOW.format("r2") + f"SELECT id, name FROM items WHERE mime <> '{FOLDER}' AND listed_folder_id IN (SELECT id FROM below)", "folders", "items")
query("moved_paths", stored.paths_after_move, """, f AS (SELECT id, name, CASE WHEN id = 'n3' THEN 'r0' ELSE parent_id END AS parent_id FROM folders),
    down(id, path) AS (SELECT id, '/' || name FROM f WHERE id = 'r0' UNION ALL SELECT f.id, path || '/' || f.name FROM f JOIN down ON f.parent_id = down.id) SELECT id, path FROM down""", "folders")  # fmt: skip
query("dead_letters", stored.dead_letters, f""", judged AS (SELECT id AS source, CASE WHEN scan_seq % 13 = 5 THEN 'malformed' WHEN coalesce(id, '') = '' THEN 'no id' WHEN listed_folder_id IS NULL OR listed_folder_id NOT IN (SELECT id FROM folders) THEN 'no such folder'
    WHEN coalesce(size, '') <> '' AND TRY_CAST(size AS BIGINT) IS NULL AND coalesce(mime, '') <> '{FOLDER}' THEN 'size is no number' END AS reason FROM items)
    SELECT source, reason, count(*) AS records FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2""", "items", "folders")  # fmt: skip
query("scan_probe_gate", _gated, _ROUTED + _PATHS + "SELECT file_id, scan_seq, CASE WHEN coalesce(file_size, 0) / 1048576 <= 1.5 THEN '1920x1080' ELSE '' END AS resolution FROM rec", "items", "drives", "folders")

# ---- enrichment, whole
_WHOLE = ["clean_title", "normalized_name", "speaker", "main_theme", "teaching_type", "biblical_topics", "keywords", "bible_references", "semantic_tags", "ministry"]
query("enriched_rows", lambda t: listing.enriched(spread(t.names)).select("id", *_WHOLE),
      _T + _C + f""", tr AS (SELECT *, {_CASED.format('list_filter(w, lambda t: NOT (year <> chr(32) AND t = year) AND NOT list_contains(string_split(lower(speaker), chr(32)), lower(t)))')} AS title FROM tu),
      rr AS (SELECT id, regexp_extract_all(raw, '(?i){enrich.REFERENCE}') AS r FROM cx)
      SELECT tr.id, CASE WHEN len(title) < 3 THEN {_CASED.format("list_filter(regexp_split_to_array(replace(replace(stem, '_', ' '), '-', ' '), '\\s+'), lambda t: t <> '')")} ELSE title END AS clean_title,
        trim(regexp_replace(lower(array_to_string(tr.w, ' ')), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, speaker, {_case(enrich.THEMES)} AS main_theme, {_case(enrich.TEACHING_TYPES)} AS teaching_type,
        array_to_string({_TOPICS}, '; ') AS biblical_topics, array_to_string(list_sort(list_distinct(list_concat(f, list_filter(list_transform(tr.w, lambda x: lower(x)), lambda x: len(x) >= 4))))[1:25], '; ') AS keywords,
        array_to_string(list_filter(r, lambda v, i: list_position(list_transform(r, lambda y: lower(y)), lower(v)) = i)[1:25], '; ') AS bible_references,
        array_to_string(list_sort(list_distinct(list_filter(list_concat([{_case(enrich.THEMES)}, {_case(enrich.TEACHING_TYPES)}], {_TOPICS}), lambda t: t <> ''))), '; ') AS semantic_tags,
        split_part(tr.folder_path, '/', 2) AS ministry
      FROM tr JOIN cx ON cx.id = tr.id JOIN rr ON rr.id = tr.id JOIN fk ON fk.id = tr.id""", "names")  # fmt: skip

# ---- full text through the search, and upkeep of the index
_REQUEST = search.SearchRequest(query="elan OR preacher", full_text=True, asset_type="cut", sort_by="file_size", sort_dir="desc", page_size=40)
query("fts_search", lambda t: search.search(align_searched(t.videos), _REQUEST, t.video_labels, t.label_names, lambda q: stored.INDEX.search(stored.indexed(t), q)).select("file_id", "file_size"),
      _I + f"SELECT file_id, file_size FROM videos WHERE asset_type = 'cut' AND file_id IN ({_has('token IN (' + repr('elan') + ', ' + repr('preacher') + ')')}) ORDER BY file_size DESC NULLS LAST, file_name, file_id LIMIT 40", "videos")
_BLANK = search.SearchRequest(query=" ", full_text=True, page_size=20)
query("fts_blank", lambda t: search.search(align_searched(t.videos), _BLANK, t.video_labels, t.label_names).select("file_id"), "SELECT file_id FROM videos ORDER BY translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), file_name, file_id LIMIT 20", "videos")
_PER_TOKEN = "SELECT token, count(*) AS n, count(DISTINCT file_id) AS files FROM tok GROUP BY 1"
query("fts_refresh", lambda t: stored.INDEX.tokens(stored.refreshed_index(t)), _I + _PER_TOKEN, "videos")
query("fts_backfill", lambda t: stored.INDEX.tokens(stored.indexed(t)), _I + _PER_TOKEN, "videos")
query("fts_merged", lambda t: stored.INDEX.search(stored.refreshed_index(t), '"elan of" OR NEAR(src1 take, 2) OR sess* NOT stale'),
      _I + f"SELECT DISTINCT a.file_id FROM tok a JOIN tok b ON a.file_id = b.file_id AND a.field = b.field WHERE (b.pos = a.pos + 1 AND a.token = 'elan' AND b.token = 'of') OR (a.token = 'src1' AND b.token = 'take' AND (b.pos - a.pos BETWEEN 0 AND 3 OR a.pos - b.pos BETWEEN 0 AND 3)) UNION {_has('starts_with(token, ' + repr('sess') + ')')}", "videos")
query("match_pages", lambda t: search.paged(t.videos, search.SearchRequest(page_size=30)), "SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 30), 1) AS BIGINT) AS pages FROM videos", "videos")
query("asset_total", lambda t: stats.workflow_counts(t.videos).where("workflow_stage is null").agg(F.sum("videos").alias("total")), "SELECT count(*) AS total FROM videos", "videos")
