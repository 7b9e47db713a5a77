"""Joins between files, labels, terms, history, settings and users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_of, fold
from ..session import checkpointed


def labels_of(video_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """(file_id, label_id, name, color) of every label of every file."""
    l = labels.select(F.col("id").alias("label_id"), "name", "color")  # noqa: E741
    return video_labels.join(l, "label_id").select("file_id", "label_id", "name", "color")


def label_map(files: DataFrame, video_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """(file_id, labels array of names): every file, also those without labels."""
    named = labels_of(video_labels, labels).groupBy("file_id").agg(F.array_sort(F.collect_list("name")).alias("labels"))
    return files.select("file_id").join(named, "file_id", "left").select("file_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def label_usage(labels: DataFrame, video_labels: DataFrame) -> DataFrame:
    """(id, name, videos) of every label, unused ones with 0. Counts are made before the join."""
    counts = video_labels.groupBy("label_id").agg(F.count("file_id").alias("n"))
    joined = labels.join(counts, labels["id"] == counts["label_id"], "left")
    return joined.select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("videos"))


def orphan_labels(labels: DataFrame, video_labels: DataFrame) -> DataFrame:
    return labels.join(video_labels, labels["id"] == video_labels["label_id"], "left_anti")


def terms_of(bridge: DataFrame, terms: DataFrame) -> DataFrame:
    """(file_id, category, term, source, confidence, evidence); order by fold(category), fold(term) to show."""
    t = terms.select(F.col("id").alias("term_id"), "category", "term")
    return bridge.join(t, "term_id").select("file_id", "category", "term", "source", "confidence", "evidence")


def latest_edits(history: DataFrame) -> DataFrame:
    """The newest history row of each file: a pre-aggregated maximum, not a window over the file's rows."""
    best = F.max_by(F.struct(*(c for c in history.columns if c != "file_id")), "id").alias("e")
    return history.groupBy("file_id").agg(best).select("file_id", "e.*")


def newest(history: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` newest history rows of each file."""
    order = Window.partitionBy("file_id").orderBy(F.desc("id"))
    return history.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def sources_of_cuts(videos: DataFrame) -> DataFrame:
    """(file_id, source_file_id, source_name) of cuts that name a source; null for one that is missing."""
    cuts = videos.where((F.col("asset_type") == "cut") & (F.col("source_file_id") != "")).select("file_id", "source_file_id")
    raw = videos.select(F.col("file_id").alias("source_file_id"), F.col("file_name").alias("source_name"))
    return cuts.join(raw, "source_file_id", "left").select("file_id", "source_file_id", "source_name")


def cuts_of_sources(videos: DataFrame) -> DataFrame:
    """(file_id, cut_id, cut_name): every raw file's cuts."""
    cuts = videos.where("asset_type = 'cut'").select(F.col("source_file_id").alias("file_id"), F.col("file_id").alias("cut_id"), F.col("file_name").alias("cut_name"))
    return videos.where("asset_type = 'raw'").select("file_id").join(cuts, "file_id")


def decorated(page: DataFrame, video_labels: DataFrame, labels: DataFrame, history: DataFrame, **units) -> DataFrame:
    """A page's rows with size (in units as of bytes_text) and duration as text, labels, is_new, completeness and the last edit.

    The page is made first and written, so that its search and sort run once; side tables are reduced to its files
    before anything is aggregated. A page has 200 rows at most, so its ids may be broadcast."""
    from ..functions.fmt import bytes_text, duration_text
    from ..functions.text import is_blank
    from .stats import completeness

    page = checkpointed(page)
    ids = F.broadcast(page.select("file_id"))
    mine, edited = video_labels.join(ids, "file_id", "left_semi"), history.join(ids, "file_id", "left_semi")
    edits = latest_edits(edited).select("file_id", F.col("user_email").alias("last_edit_by"), F.col("created_at").alias("last_edit_at"))
    rows = completeness(page, mine).join(label_map(page, mine, labels), "file_id").join(edits, "file_id", "left")
    return rows.withColumns({"size_text": bytes_text(F.col("file_size"), **units), "duration_text": duration_text(F.col("duration_seconds")), "is_new": is_blank(F.col("reviewed_at"))})


def detail(videos: DataFrame, file_id: str, video_labels: DataFrame, labels: DataFrame, terms: DataFrame, bridge: DataFrame, history: DataFrame) -> DataFrame:
    """One file as its page shows it, no row if it is unknown: its columns, what decorated() adds, and lists of labels
    (by name), terms (by category and term), related files (a cut's source, a source's cuts) and the newest edits."""
    one = videos.where(F.col("file_id") == file_id)
    here = lambda t: t.where(F.col("file_id") == file_id)
    rows = decorated(one, here(video_labels), labels, here(history))
    term = F.struct(fold(F.col("category")).alias("_c"), fold(F.col("term")).alias("_t"), "category", "term", "source", "confidence", "evidence")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.dropFields("_c", "_t"))
    words = terms_of(here(bridge), terms).agg(listed(term).alias("terms"))
    named = labels_of(here(video_labels), labels)
    named = named.agg(F.transform(F.array_sort(F.collect_list(F.struct(fold(F.col("name")).alias("_n"), "label_id", "name", "color"))), lambda x: x.dropFields("_n")).alias("label_rows"))
    source = sources_of_cuts(videos).where(F.col("file_id") == file_id).where("source_name is not null").select(F.lit("source").alias("role"), F.col("source_file_id").alias("file_id"), F.col("source_name").alias("file_name"))
    cuts = cuts_of_sources(videos).where(F.col("file_id") == file_id).select(F.lit("cut").alias("role"), F.col("cut_id").alias("file_id"), F.col("cut_name").alias("file_name"))
    related = source.union(cuts).agg(F.array_sort(F.collect_list(F.struct("role", "file_name", "file_id"))).alias("related"))
    edits = newest(here(history)).agg(F.reverse(F.array_sort(F.collect_list(F.struct("id", "user_email", "created_at")))).alias("edits"))
    return rows.crossJoin(words).crossJoin(named).crossJoin(related).crossJoin(edits)  # one row each


def setting_row(settings: DataFrame, prefix: str = "drive_folder") -> DataFrame:
    """Key/value rows as one row, with who changed it last (ties: the greater key)."""
    value = lambda k: F.max(F.when(F.col("key") == f"{prefix}_{k}", F.col("value"))).alias(f"folder_{k}")
    known = settings.where(F.col("key").startswith(prefix))
    last = F.max_by("updated_by_email", F.struct("updated_at", "key")).alias("updated_by_email")
    return known.agg(value("id"), value("name"), value("url"), last, F.max("updated_at").alias("updated_at"))


def configured_folder(settings: DataFrame, environment: str) -> DataFrame:
    """The stored folder id, else that of the environment's link, else empty."""
    from ..functions.text import folder_id

    stored = F.max(F.when(F.col("key") == "drive_folder_id", F.col("value")))
    return settings.agg(first_of(stored, folder_id(F.lit(environment))).alias("folder_id"))


def session_users(sessions: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """(token_hash, user_id, email) of sessions that haven't expired, of active users."""
    u = users.where("is_active = 1").select(F.col("id").alias("user_id"), "email")
    return sessions.where(F.col("expires_at") > now).join(u, "user_id").select("token_hash", "user_id", "email")


def pending_codes(users: DataFrame, codes: DataFrame, now: str, cooldown: int = 60, attempts: int = 6) -> DataFrame:
    """Every user with the state of their verification code: none, expired, exhausted or open, and the seconds
    until another may be sent."""
    c = codes.select("user_id", F.col("created_at").alias("sent_at"), "expires_at", "attempts")
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("sent_at")
    state = F.when(F.col("sent_at").isNull(), "none").when(F.col("expires_at") <= now, "expired").when(F.col("attempts") >= attempts, "exhausted").otherwise("open")
    joined = users.join(c, users["id"] == c["user_id"], "left")
    return joined.select("id", "email", state.alias("state"), F.greatest(F.lit(0), F.coalesce(cooldown - age, F.lit(0))).cast("long").alias("wait_seconds"))


def by_name(terms: DataFrame) -> DataFrame:
    return terms.orderBy(fold(F.col("category")), fold(F.col("term")))
