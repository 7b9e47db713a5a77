"""The test tables as catalogue relations. Each relation is one SQL text that Spark and DuckDB both read, so both
engines see the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.enrich import BOOKS

ID = "'doc-' || CAST(doc_id AS STRING)"
EXT = "CASE doc_id % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mov' WHEN 2 THEN '.MKV' WHEN 3 THEN '.avi' ELSE '' END"

VIDEOS = f"""
SELECT {ID} AS file_id,
    CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '_' || lang || ' Take-' || CAST(doc_id AS STRING) || {EXT} AS file_name,
    '/' || source || '/' || lang AS folder_path, lang AS parent_folder, lang || '@' || source || '.example' AS owner,
    CASE WHEN doc_id % 4 = 1 THEN 'Drive ' || lang ELSE '' END AS shared_drive_name,
    lower({EXT}) AS file_extension, n_chars * 4096 AS file_size,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) / 4 END AS duration_seconds,
    CASE doc_id % 3 WHEN 0 THEN '1920x1080' WHEN 1 THEN '1280x720' ELSE '' END AS resolution,
    CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS has_audio,
    CASE WHEN doc_id % 4 = 0 THEN 'cut' ELSE 'raw' END AS asset_type,
    CASE doc_id % 6 WHEN 0 THEN 'digitized' WHEN 1 THEN 'to_review' WHEN 2 THEN 'transcribed' WHEN 3 THEN 'treated' WHEN 4 THEN 'ready_edit' ELSE 'published' END AS workflow_stage,
    CASE WHEN doc_id % 8 = 0 THEN 'doc-' || CAST(doc_id + 1 AS STRING) ELSE '' END AS source_file_id,
    CAST(2010 + doc_id % 15 AS STRING) || '-01-01T00:00:00Z' AS modified_at,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'Élan of ' || source ELSE lang || ' Session' END AS editorial_title,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || ' Theme; ' || lang || ' | ' || upper(source) || ' theme' END AS main_theme,
    CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Speaker ' || lang ELSE '' END AS speaker,
    CASE WHEN doc_id % 2 = 0 THEN 'Preacher ' || source ELSE NULL END AS preacher,
    source || '; ' || lang || ',; ' || upper(lang) || ' ;words' AS keywords,
    text AS transcript_summary,
    CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN '2024-01-01 00:00:00' ELSE '' END AS reviewed_at,
    '' AS first_seen_at
FROM documents LEFT JOIN (SELECT doc_id AS l_doc_id, quality FROM labels) AS marks ON doc_id = l_doc_id"""

VIDEO_LABELS = f"""
SELECT {ID} AS file_id, CAST(1 AS BIGINT) AS label_id FROM labels WHERE quality = 1
UNION ALL SELECT {ID}, CAST(2 AS BIGINT) FROM labels WHERE toxic = 1"""

LABELS = """
SELECT CAST(id AS BIGINT) AS id, name, normalized_name, color
FROM (VALUES (1, 'Quality', 'quality', '#0a0'), (2, 'Toxic', 'toxic', '#a00'), (3, 'Unused', 'unused', '#000')) AS v(id, name, normalized_name, color)"""

HISTORY = """
SELECT event_id AS id, 'doc-' || CAST(user_id AS STRING) AS file_id, event_type AS user_email, CAST(value AS STRING) AS created_at FROM events"""

TERMS = """
SELECT min(p_partkey) AS id, p_type AS category, p_name AS term FROM part GROUP BY p_type, p_name"""
TERM_BRIDGE = """
SELECT 'doc-' || CAST(l_orderkey AS STRING) AS file_id, t.id AS term_id, 'manual' AS source, l_tax AS confidence, p_brand AS evidence
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT min(p_partkey) AS id, p_type AS ty, p_name AS nm FROM part GROUP BY p_type, p_name) AS t ON ty = p_type AND nm = p_name"""

FOLDERS = """
SELECT 'r' || CAST(r_regionkey AS STRING) AS id, r_name AS name, CAST(NULL AS STRING) AS parent_id FROM region
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), n_name, 'r' || CAST(n_regionkey AS STRING) FROM nation
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), c_name, 'n' || CAST(c_nationkey AS STRING) FROM customer
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), s_name, 'n' || CAST(s_nationkey AS STRING) FROM supplier"""

SETTINGS = """
SELECT CASE n_regionkey WHEN 0 THEN 'drive_folder_id' WHEN 1 THEN 'drive_folder_name' WHEN 2 THEN 'drive_folder_url' WHEN 3 THEN 'drive_folder_note' ELSE 'other' END AS key,
    max(n_name) AS value, max(n_name) || '@x.example' AS updated_by_email, '2024-01-0' || CAST(1 + n_regionkey % 3 AS STRING) AS updated_at
FROM nation GROUP BY n_regionkey"""

USERS = """
SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) || '@x.example' AS email, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS is_active,
    c_mktsegment || '-' || CAST(c_nationkey AS STRING) AS password_hash, '00ff' AS password_salt,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE '2023-05-05 00:00:00' END AS email_verified_at, CAST(NULL AS STRING) AS last_login_at
FROM customer"""
SESSIONS = """
SELECT 'tok-' || CAST(o_orderkey AS STRING) AS token_hash, o_custkey AS user_id, CAST(o_orderdate AS STRING) AS expires_at FROM orders"""
CODES = """
SELECT c_custkey AS user_id, '2024-01-01 00:00:' || lpad(CAST(c_custkey % 60 AS STRING), 2, '0') AS created_at,
    '2024-01-01 00:0' || CAST(c_custkey % 3 AS STRING) || ':30' AS expires_at, CAST(c_nationkey % 8 AS INT) AS attempts
FROM customer WHERE c_mktsegment <> 'BUILDING'"""

#: Requests about accounts: addresses of customers, some unknown, spelled in several ways, with a password or code.
ASKED = """
SELECT c_custkey AS n, CASE c_custkey % 4 WHEN 0 THEN ' ' || upper(replace(c_name, '#', '-')) || '@X.example ' WHEN 1 THEN 'new' || CAST(c_custkey AS STRING) || '@y.example'
        WHEN 2 THEN replace(c_name, '#', '-') || '@x.example' ELSE 'no address ' || CAST(c_custkey AS STRING) END AS email,
    CASE WHEN c_custkey % 5 = 0 THEN 'short' ELSE c_mktsegment || '-' || CAST(c_nationkey AS STRING) END AS password,
    CASE c_custkey % 7 WHEN 0 THEN '12345' WHEN 1 THEN 'abcdef' ELSE lpad(CAST(c_custkey % 3 AS STRING), 6, '0') END AS code,
    CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS verified
FROM customer WHERE c_custkey % 6 <> 5"""

#: Items of a listing: the folders, shortcuts back to their regions (cycles), and documents as files of several kinds.
ITEMS = f"""
SELECT id, name, 'application/vnd.google-apps.folder' AS mime, CAST(NULL AS STRING) AS size, '2020-01-01T00:00:00Z' AS modified, '' AS owner_name, 'f@x.example' AS owner_email,
    CAST(NULL AS STRING) AS target_id, CAST(NULL AS STRING) AS target_mime, CAST(NULL AS STRING) AS drive_id, '' AS link, false AS trashed, CAST(0 AS BIGINT) AS scan_seq, parent_id AS listed_folder_id
FROM ({FOLDERS}) AS f WHERE parent_id IS NOT NULL
UNION ALL SELECT 'k' || CAST(n_nationkey AS STRING), 'Back to ' || n_name, 'application/vnd.google-apps.shortcut', NULL, '2020-01-01T00:00:00Z', 'Owner', '',
    CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'r' || CAST(n_regionkey AS STRING) END, 'application/vnd.google-apps.folder', NULL, NULL, n_nationkey % 6 = 0, CAST(0 AS BIGINT), 'n' || CAST(n_nationkey AS STRING) FROM nation
UNION ALL SELECT 'v' || CAST(doc_id AS STRING), source || '_' || lang || ' Take ' || CAST(doc_id AS STRING) || {EXT},
    CASE doc_id % 4 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'application/vnd.google-apps.shortcut' ELSE 'text/plain' END,
    CASE doc_id % 10 WHEN 0 THEN 'junk' WHEN 1 THEN NULL ELSE CAST(n_chars * 1000 AS STRING) END, CAST(2010 + doc_id % 15 AS STRING) || '-01-01T00:00:00Z',
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Name ' || lang END, CASE WHEN doc_id % 2 = 0 THEN lang || '@x.example' ELSE '' END,
    CASE WHEN doc_id % 4 = 2 THEN 'v' || CAST(doc_id + 2 AS STRING) END, CASE WHEN doc_id % 8 = 2 THEN 'video/mp4' ELSE 'text/plain' END,
    'r' || CAST(doc_id % 9 AS STRING), CASE WHEN doc_id % 5 = 0 THEN 'https://x.example/' || CAST(doc_id AS STRING) ELSE '' END, doc_id % 11 = 0, doc_id, 'n' || CAST(doc_id % 30 AS STRING)
FROM documents"""
DRIVES = "SELECT 'r' || CAST(r_regionkey AS STRING) AS id, CASE WHEN r_regionkey = 4 THEN CAST(NULL AS STRING) ELSE r_name END AS name FROM region"

_BOOK = " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BOOKS[:20]))
NAMES = f"""
SELECT p_partkey AS id,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(1990 + p_partkey % 40 AS STRING) || '-' ELSE '' END
    || CASE p_partkey % 4 WHEN 0 THEN 'JohnPiper_' WHEN 1 THEN 'Grace Adams ' WHEN 2 THEN '' ELSE 'THE__' END
    || replace(p_name, ' ', '-')
    || CASE p_size % 7 WHEN 0 THEN ' of prayer' WHEN 1 THEN '_entrusted' WHEN 2 THEN '.department' WHEN 3 THEN '-Kingdom gospel' WHEN 4 THEN ' spirit' WHEN 5 THEN ' Q&A to Été' ELSE ' and redeem in a covenant' END
    || CASE p_partkey % 5 WHEN 0 THEN ' John 3:' || CAST(p_size AS STRING) WHEN 1 THEN ' 1 john ' || CAST(p_size AS STRING) || ':2-4' WHEN 2 THEN '_Psalm_23' WHEN 3 THEN ' ' || (CASE p_partkey % 20 {_BOOK} ELSE '' END) || ' ' || CAST(p_partkey % 150 + 1 AS STRING) || ' - 9' ELSE '' END
    || CASE p_size % 3 WHEN 0 THEN '_v2-FINAL' ELSE '' END || '.mp4' AS file_name,
    CASE WHEN p_size % 9 = 0 THEN '' ELSE '/' || p_type || '/My videos/' || p_brand || '/Series of study John 3:4' END AS folder_path
FROM part"""

PROBES = """
SELECT l_orderkey AS id, l_linenumber AS line,
    '{"streams":[{"codec_type":"data"},{"codec_type":"video","codec_name":"h264","width":' || CAST(CAST(l_quantity AS INT) * 16 AS STRING) || ',"height":' || CAST(l_linenumber * 120 AS STRING)
    || ',"avg_frame_rate":"' || CASE l_linenumber % 3 WHEN 0 THEN '30000/1001' WHEN 1 THEN '0/0' ELSE '25/1' END || '","r_frame_rate":"24/1"}'
    || CASE WHEN l_returnflag = 'R' THEN '' ELSE ',{"codec_type":"audio","codec_name":"aac"}' END
    || '],"format":{"duration":"' || CAST(CAST(l_quantity AS INT) AS STRING) || '.5","bit_rate":"' || CAST(l_partkey AS STRING) || '","format_name":"mov"}}' AS probe
FROM lineitem"""

RELATIONS = {
    "videos": VIDEOS, "video_labels": VIDEO_LABELS, "label_names": LABELS, "history": HISTORY, "terms": TERMS, "term_bridge": TERM_BRIDGE,
    "folders": FOLDERS, "settings": SETTINGS, "users": USERS, "sessions": SESSIONS, "codes": CODES, "names": NAMES, "probes": PROBES,
    "asked": ASKED, "items": ITEMS, "drives": DRIVES,
}
TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the tables of a folder. The tables go in by name, not as session-wide views."""
    import re

    sql = RELATIONS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    if name == "probes":  # JSON braces are no names
        sql = re.sub(r"\{(?!lineitem\})", "{{", sql)
        sql = re.sub(r"(?<!\{lineitem)\}", "}}", sql)
    return spark.sql(sql, **used)


def ctes(*names: str) -> str:
    """The relations as DuckDB common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in names) + "\n"
