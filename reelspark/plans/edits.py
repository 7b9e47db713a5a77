"""Queries over edits: metadata, workflow, labels, terms, deletes, and a file's page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fmt import bytes_text, duration_text
from ..operators import merge, relations, search, stats
from ..schema import LEXICON
from .queries import _DONE, Tables, query

_AT = "'2024-05-05 00:00:00'"


def _now():
    return F.lit("2024-05-05 00:00:00")


# ---- metadata
def _edits(t: Tables) -> DataFrame:
    some = t.videos.where("asset_type = 'cut'")
    title = some.select("file_id", F.lit("editorial_title").alias("field"), F.concat(F.lit("\t New "), "parent_folder", F.lit(" \n")).alias("value"))
    speaker = some.where("workflow_stage = 'treated'").select("file_id", F.lit("speaker"), F.lit(None).cast("string"))
    other = t.videos.where("asset_type = 'raw' and workflow_stage = 'published'").select("file_id", F.lit("metadata_confidence"), F.when(F.col("file_size") % 8192 == 0, "0.5").otherwise("high"))
    no_field = t.videos.where("asset_type = 'raw' and workflow_stage = 'to_review'").select("file_id", F.lit("file_name"), F.lit("taken"))
    return title.union(speaker).union(other).union(no_field)


def _edited(t: Tables) -> DataFrame:
    v = t.videos.withColumns({"metadata_updated_at": F.lit(""), "metadata_confidence": F.lit(1.0)})
    return merge.edit(v, _edits(t), _now()).select("file_id", "file_name", "editorial_title", "speaker", "metadata_confidence", "metadata_updated_at", "reviewed_at")


query("metadata_edit", _edited,
      f"""SELECT file_id, file_name, CASE WHEN asset_type = 'cut' THEN 'New ' || parent_folder ELSE editorial_title END AS editorial_title, CASE WHEN asset_type = 'cut' AND workflow_stage = 'treated' THEN '' ELSE speaker END AS speaker,
      CASE WHEN asset_type = 'raw' AND workflow_stage = 'published' THEN CASE WHEN file_size % 8192 = 0 THEN 0.5::DOUBLE END ELSE 1.0::DOUBLE END AS metadata_confidence,
      CASE WHEN asset_type = 'cut' OR workflow_stage = 'published' THEN {_AT} ELSE '' END AS metadata_updated_at, CASE WHEN asset_type = 'cut' OR workflow_stage = 'published' THEN {_AT} ELSE reviewed_at END AS reviewed_at FROM videos""", "videos")  # fmt: skip

# ---- workflow
_CHANGES = """SELECT 'doc-' || CAST(doc_id AS STRING) AS file_id, CASE doc_id % 7 WHEN 0 THEN 'other' WHEN 1 THEN NULL WHEN 2 THEN ' raw ' ELSE ' cut' END AS asset_type,
    CASE doc_id % 5 WHEN 0 THEN 'no stage' WHEN 1 THEN '' ELSE 'treated ' END AS workflow_stage,
    CASE doc_id % 4 WHEN 0 THEN 'doc-' || CAST(doc_id AS STRING) WHEN 1 THEN ' doc-' || CAST(doc_id + 1 AS STRING) WHEN 2 THEN 'doc-' || CAST(doc_id + 2 - doc_id % 2 + 1 AS STRING) ELSE NULL END AS source_file_id,
    ' note ' || lang AS workflow_notes FROM {documents} WHERE doc_id % 3 <> 0
UNION ALL SELECT 'gone', 'raw', 'treated', '', ''"""
_WF = ", ch AS (" + _CHANGES.replace("{documents}", "documents") + """),
asked AS (SELECT file_id, trim(coalesce(nullif(asset_type, ''), 'raw')) AS asset_type, trim(coalesce(nullif(workflow_stage, ''), 'digitized')) AS workflow_stage, CASE WHEN trim(coalesce(asset_type, 'raw')) = 'raw' THEN '' ELSE trim(coalesce(source_file_id, '')) END AS source_file_id, trim(workflow_notes) AS workflow_notes FROM ch),
judged AS (SELECT a.*, CASE WHEN a.asset_type NOT IN ('raw', 'cut') THEN 'asset type' WHEN a.workflow_stage NOT IN ('digitized', 'to_review', 'transcribed', 'treated', 'ready_edit', 'published') THEN 'stage' WHEN a.source_file_id = a.file_id THEN 'self link'
    WHEN v.file_id IS NULL THEN 'unknown file' WHEN a.source_file_id <> '' AND s.file_id IS NULL THEN 'source is missing or no raw file' END AS error
    FROM asked a LEFT JOIN videos v ON v.file_id = a.file_id LEFT JOIN videos s ON s.file_id = a.source_file_id AND s.asset_type = 'raw')
"""


def _changes(t: Tables) -> DataFrame:
    return t.spark.sql(_CHANGES, documents=t.read("documents"))


query("workflow_errors", lambda t: merge.workflow_errors(_changes(t), t.videos), _WF + "SELECT * FROM judged", "videos")
_FLOW = ["file_id", "asset_type", "workflow_stage", "source_file_id", "workflow_notes", "workflow_updated_at", "reviewed_at"]
query("workflow_update", lambda t: merge.update_workflow(t.videos.withColumns({"workflow_notes": F.lit("old"), "workflow_updated_at": F.lit("")}), _changes(t), _now()).select(*_FLOW),
      _WF + f"SELECT v.file_id, coalesce(j.asset_type, v.asset_type) AS asset_type, coalesce(j.workflow_stage, v.workflow_stage) AS workflow_stage, coalesce(j.source_file_id, v.source_file_id) AS source_file_id, coalesce(j.workflow_notes, 'old') AS workflow_notes, CASE WHEN j.file_id IS NOT NULL THEN {_AT} ELSE '' END AS workflow_updated_at, CASE WHEN j.file_id IS NOT NULL THEN {_AT} ELSE reviewed_at END AS reviewed_at FROM videos v LEFT JOIN judged j ON j.file_id = v.file_id AND error IS NULL", "videos")

# ---- labels
_NAMES = """SELECT 'doc-' || CAST(doc_id AS STRING) AS file_id, CASE doc_id % 5 WHEN 0 THEN 'Quality' WHEN 1 THEN '  quality ' WHEN 2 THEN ' Set  ' || lang ELSE '' END AS a, CASE WHEN doc_id % 2 = 0 THEN 'QUALITY' ELSE 'set ' || lang END AS b FROM {documents} WHERE doc_id % 4 <> 3
UNION ALL SELECT 'gone', 'x', 'y'"""
_LB = ", wn AS (" + _NAMES.replace("{documents}", "documents") + """),
nm AS (SELECT file_id, 1 AS place, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS name FROM wn UNION ALL SELECT file_id, 2, trim(regexp_replace(b, '\\s+', ' ', 'g')) FROM wn),
fi AS (SELECT file_id, lower(name) AS key, arg_min(name, place) AS name FROM nm WHERE name <> '' AND file_id IN (SELECT file_id FROM videos) GROUP BY 1, 2),
hit AS (SELECT file_id FROM wn WHERE file_id IN (SELECT file_id FROM videos)),
af AS (SELECT file_id, normalized_name AS key FROM video_labels JOIN label_names ON label_id = id WHERE file_id NOT IN (SELECT file_id FROM hit) UNION ALL SELECT file_id, key FROM fi),
df AS (SELECT coalesce(b.file_id, f.file_id) AS file_id, b.name AS b, f.name AS a FROM (SELECT file_id, name, normalized_name AS key FROM video_labels JOIN label_names ON label_id = id WHERE file_id IN (SELECT file_id FROM hit)) b FULL JOIN fi f ON f.file_id = b.file_id AND f.key = b.key)
"""


def _set(which: str):
    def make(t: Tables) -> DataFrame:
        wanted = t.spark.sql(_NAMES, documents=t.read("documents")).select("file_id", F.array("a", "b").alias("names"))
        return merge.set_labels(t.videos, t.label_names, t.video_labels, wanted, "me@x.example", _now(), 3)[which]

    return make


_VL = ("videos", "video_labels", "label_names")
query("set_labels_bridge", lambda t: _set("video_labels")(t).join(_known(t), "label_id").select("file_id", "key"), _LB + "SELECT * FROM af", *_VL)
query("set_labels_dimension", lambda t: _set("labels")(t).select("normalized_name"), _LB + "SELECT DISTINCT key AS normalized_name FROM af", *_VL)
_joined = lambda c: F.array_join(c, ";").alias(c)
query("set_labels_log", lambda t: _set("history")(t).select("file_id", *map(_joined, ("before_labels", "after_labels", "added_labels", "removed_labels")), "user_email", "created_at"),
      _LB + f"SELECT file_id, coalesce(string_agg(b, ';' ORDER BY b), '') AS before_labels, coalesce(string_agg(a, ';' ORDER BY a), '') AS after_labels, coalesce(string_agg(a, ';' ORDER BY a) FILTER (WHERE b IS NULL), '') AS added_labels, coalesce(string_agg(b, ';' ORDER BY b) FILTER (WHERE a IS NULL), '') AS removed_labels, 'me@x.example' AS user_email, {_AT} AS created_at FROM df GROUP BY 1 HAVING bool_or(a IS NULL OR b IS NULL)", *_VL)
query("set_labels_stamp", lambda t: _set("videos")(t).select("file_id", "reviewed_at"), _LB + f"SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM hit) THEN {_AT} ELSE reviewed_at END AS reviewed_at FROM videos", *_VL)


def _known(t: Tables) -> DataFrame:
    return _set("labels")(t).select(F.col("id").alias("label_id"), F.col("normalized_name").alias("key"))


# ---- terms
def _lexicon(t: Tables):
    v = t.videos.withColumns({c: F.lit("") for c in LEXICON if c not in t.videos.columns} | {"metadata_confidence": F.lit(0.5)})
    terms = t.spark.sql("SELECT * FROM VALUES (1L, 'theme', 'Old theme', 'old theme'), (2L, 'person', 'Kept', 'kept'), (3L, 'other', 'Foreign', 'foreign') AS v(id, category, term, normalized_term)")
    old = t.videos.select("file_id", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("term_id"), F.lit(s).alias("source")) for i, s in ((1, "manual"), (2, "auto"), (3, "manual"))))).alias("o"))
    bridge = old.select("file_id", "o.term_id", "o.source", F.lit(1.0).alias("confidence"), F.lit("before").alias("evidence"))
    return merge.sync_terms(v, terms, bridge, t.videos.where("asset_type = 'cut'").select("file_id"), 100)


_HELD = {c: LEXICON[c] for c in ("main_theme", "speaker", "preacher", "keywords")}
_LX = ", f AS (" + " UNION ALL ".join(f"SELECT file_id, {i} AS ord, '{cat}' AS category, '{c}' AS evidence, {c} AS v FROM videos WHERE asset_type = 'cut'" for i, (c, cat) in enumerate(_HELD.items())) + r"""),
s AS (SELECT file_id, ord, category, evidence, unnest(regexp_split_to_array(coalesce(v, ''), '[\n|;]')) AS term, unnest(range(len(regexp_split_to_array(coalesce(v, ''), '[\n|;]')))) AS pos FROM f),
k AS (SELECT file_id, ord, pos, category, evidence, trim(term, ' ,') AS term, lower(trim(term, ' ,')) AS key FROM s WHERE trim(term, ' ,') <> ''),
w AS (SELECT file_id, category, key, evidence FROM k QUALIFY row_number() OVER (PARTITION BY file_id, category, key ORDER BY ord, pos) = 1)
"""
query("lexicon_resync", lambda t: _bridge(t),
      _LX + "SELECT file_id, 'theme' AS category, 'old theme' AS normalized_term, 'manual' AS source, 1.0::DOUBLE AS confidence, 'before' AS evidence FROM videos WHERE asset_type <> 'cut' UNION ALL SELECT file_id, 'person', 'kept', 'auto', 1.0, 'before' FROM videos UNION ALL SELECT file_id, 'other', 'foreign', 'manual', 1.0, 'before' FROM videos UNION ALL SELECT file_id, category, key, 'manual', 0.5, evidence FROM w", "videos")


def _bridge(t: Tables) -> DataFrame:
    out = _lexicon(t)
    rows = out["bridge"].join(out["terms"].select(F.col("id").alias("term_id"), "category", "normalized_term"), "term_id")
    return rows.select("file_id", "category", "normalized_term", "source", F.col("confidence").cast("double").alias("confidence"), "evidence")


query("lexicon_terms", lambda t: _lexicon(t)["terms"].select("category", "normalized_term"),
      _LX + "SELECT 'theme' AS category, 'old theme' AS normalized_term UNION ALL SELECT 'person', 'kept' UNION ALL SELECT 'other', 'foreign' UNION ALL SELECT DISTINCT category, key FROM w", "videos")
query("terms_by_name", lambda t: relations.by_name(relations.terms_of(t.term_bridge.where("file_id = 'doc-7'"), t.terms)).select("category", "term", "evidence"),
      "SELECT category, term, evidence FROM term_bridge JOIN terms ON term_id = id WHERE file_id = 'doc-7'", "terms", "term_bridge")

# ---- deletes
_deleted = lambda t: merge.cascade_delete({"videos": t.videos, "video_labels": t.video_labels, "labels": t.label_names}, "doc-1")
query("cascade_delete_bridge", lambda t: _deleted(t)["video_labels"], "SELECT file_id, label_id FROM video_labels WHERE NOT starts_with(file_id, 'doc-1')", "video_labels")
query("cascade_delete_labels", lambda t: _deleted(t)["labels"].select("id", "name"), "SELECT id, name FROM label_names WHERE id IN (SELECT label_id FROM video_labels WHERE NOT starts_with(file_id, 'doc-1'))", "video_labels", "label_names")

# ---- lists as JSON, texts of a page, a file's page
query("labels_json", lambda t: relations.label_map(t.videos, t.video_labels, t.label_names).select("file_id", F.to_json("labels").alias("json")).select("file_id", "json", F.size(F.from_json("json", "array<string>")).alias("n")),
      "SELECT v.file_id, '[' || coalesce(string_agg('\"' || name || '\"', ',' ORDER BY name), '') || ']' AS json, CAST(count(name) AS INTEGER) AS n FROM videos v LEFT JOIN (SELECT file_id, name FROM video_labels JOIN label_names ON label_id = id) x ON x.file_id = v.file_id GROUP BY 1", "videos", "video_labels", "label_names")
_PAGE = search.SearchRequest(sort_by="file_size", sort_dir="desc")
query("page_texts", lambda t: relations.decorated(search.page_of(t.videos, _PAGE), t.video_labels, t.label_names, t.history, least="KB", largest="GB", null=None).select("file_id", "size_text", "duration_text", "status"),
      f""", p AS (SELECT *, {_DONE} AS completed, CAST(file_size AS DOUBLE) AS x, CAST(floor(duration_seconds) AS BIGINT) AS s FROM videos ORDER BY file_size DESC, file_name, file_id LIMIT 50)
      SELECT file_id, CASE WHEN x < 1048576 THEN format('{{:.1f}} KB', x / 1024) WHEN x < 1073741824 THEN format('{{:.1f}} MB', x / 1048576) ELSE format('{{:.1f}} GB', x / 1073741824) END AS size_text,
      CASE WHEN s IS NULL THEN '—' WHEN s >= 3600 THEN format('{{}}:{{:02d}}:{{:02d}}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{{}}:{{:02d}}', s // 60, s % 60) END AS duration_text,
      CASE WHEN completed = 5 THEN 'complete' WHEN completed <= 1 THEN 'missing' ELSE 'partial' END AS status FROM p""", "videos", "video_labels")  # fmt: skip


def _detail(t: Tables) -> DataFrame:
    d = relations.detail(t.videos, "doc-8", t.video_labels, t.label_names, t.terms, t.term_bridge, t.history)
    text = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    return d.select(
        "file_id", "completed", "last_edit_by", "is_new", text("label_rows", lambda x: x["name"]), text("terms", lambda x: F.concat_ws("/", x["category"], x["term"])),
        text("related", lambda x: F.concat_ws(":", x["role"], x["file_id"])), text("edits", lambda x: x["id"].cast("string")),
    )


query("video_detail", _detail,
      f"""SELECT file_id, {_DONE} AS completed, (SELECT arg_max(user_email, id) FROM history h WHERE h.file_id = 'doc-8') AS last_edit_by, coalesce(reviewed_at, '') = '' AS is_new,
      coalesce((SELECT string_agg(name, ';' ORDER BY lower(name)) FROM video_labels l JOIN label_names n ON n.id = label_id WHERE l.file_id = 'doc-8'), '') AS label_rows,
      coalesce((SELECT string_agg(category || '/' || term, ';' ORDER BY lower(category), lower(term)) FROM term_bridge b JOIN terms ON term_id = terms.id WHERE b.file_id = 'doc-8'), '') AS terms,
      coalesce((SELECT string_agg(r, ';' ORDER BY r DESC) FROM (SELECT 'source:' || s.file_id AS r FROM videos s JOIN videos c ON c.source_file_id = s.file_id WHERE c.file_id = 'doc-8' AND c.asset_type = 'cut' UNION ALL SELECT 'cut:' || c.file_id FROM videos c JOIN videos v ON v.file_id = c.source_file_id WHERE v.file_id = 'doc-8' AND v.asset_type = 'raw' AND c.asset_type = 'cut')), '') AS related,
      coalesce((SELECT string_agg(CAST(id AS VARCHAR), ';' ORDER BY id DESC) FROM (SELECT id FROM history h WHERE h.file_id = 'doc-8' ORDER BY id DESC LIMIT 20)), '') AS edits
      FROM videos WHERE file_id = 'doc-8'""", "videos", "video_labels", "label_names", "terms", "term_bridge", "history")  # fmt: skip
query("health", lambda t: stats.summary(t.videos).select(F.lit("ok").alias("status"), "total_videos", "size_text", "duration_text").select("status", "total_videos"), "SELECT 'ok' AS status, count(*) AS total_videos FROM videos", "videos")
