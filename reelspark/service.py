"""The catalogue as a service: what its users' calls do, on the tables of a store.

Every call reads one version of all tables, and one that changes something is a transaction: its changes to all tables
appear together, of the touched buckets only, and it is done again if another writer came first. What a call writes
to work with is deleted at its end. A call that can't be met raises Refused. Lists without a natural bound come in
pages. Pages and details come back as JSON texts, made by Spark. There is no HTTP here: a web framework's handlers
would call these methods one to one.
"""

from __future__ import annotations

import hashlib
import json
import secrets
from collections.abc import Callable
from datetime import UTC, datetime
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logs
from .functions import text
from .functions.fmt import bytes_text, duration_text
from .operators import accounts, graph, maintained, merge, relations, search, trigrams
from .schema import VIDEOS
from .session import checkpointed, scratch
from .sources import listing
from .sources.derived import refreshed
from .sources.seed import Settings, seed_workflow
from .sources.store import Snapshot, Store, Transaction
from .streaming.job import SingleFlight, retried
from .streaming.rescan import IDS, INDEX, ingest

#: Columns that tables without a file_id are bucketed by.
KEYS = {"labels": "id", "terms": "id", "settings": "key", "users": "id", "codes": "user_id", "sessions": "token_hash", "items": "listed_folder_id", "drives": "id"}
#: Tables that follow the catalogue.
KEPT_UP = (trigrams.SIGNATURES, trigrams.TEXTS, maintained.SHARES, maintained.GREATEST)
#: Values of a facet, or raw files, in one answer.
PAGE = 200
#: Segments of the full-text index from which a change also merges some.
SEGMENTS = 12
TABLES = {
    "video_ids": IDS,
    "labels": "id long, name string, normalized_name string, color string",
    "video_labels": "file_id string, label_id long",
    "history": "file_id string, before_labels array<string>, after_labels array<string>, added_labels array<string>, removed_labels array<string>, user_email string, created_at string, id long",
    "terms": "id long, category string, term string, normalized_term string",
    "bridge": "file_id string, term_id long, source string, confidence double, evidence string",
    "settings": "key string, value string, updated_by_email string, updated_at string",
    "users": "id long, email string, password_hash string, password_salt string, is_active int, email_verified_at string, last_login_at string",
    "codes": "user_id long, code_hash string, created_at string, expires_at string, attempts int",
    "sessions": "token_hash string, user_id long, created_at string, expires_at string",
    "items": listing.ITEM,
    "drives": "id string, name string",
}


R = TypeVar("R")


class Refused(Exception):
    """A call that can't be met, and why."""


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")


def as_json(df: DataFrame) -> list[dict]:
    """The rows of a bounded result as objects."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    return [json.loads(r.row) for r in rows.collect()]


def hashed(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


def is_transient(error: Exception) -> bool:
    """Whether a read of a source may go well if it is tried again."""
    return any(x in str(error) for x in ("SocketTimeout", "ConnectException", "ConnectionReset", "NoRouteToHost", "503", "429"))


class Service:
    def __init__(self, spark: SparkSession, store: Store, settings: Settings | None = None, now: Callable[[], str] = utc_now):
        self.spark, self.store, self.settings, self.now = spark, store, settings or Settings(), now
        self.store.keys = KEYS | self.store.keys
        self.job = SingleFlight()
        self.log = logs.configure(self.settings.log_level, self.settings.log_file, "reelspark.service")

    # ---- tables

    def _table(self, t: Snapshot, name: str, of: DataFrame | None = None, **more) -> DataFrame:
        """A table of a version; of: only the buckets that these rows fall into."""
        schema = VIDEOS if name == "videos" else T.StructType.fromDDL(TABLES[name])
        return t.read(name, schema, None if of is None else t.touched(name, of), **more)

    def _put(self, t: Transaction, name: str, df: DataFrame, of: DataFrame | None = None) -> None:
        """df as the whole table, or as all rows of the buckets that the rows ``of`` fall into."""
        t.write(name, df, None if of is None else t.touched(name, of))

    def _change(self, work: Callable[[Transaction], R]) -> R:
        if self.settings.read_only:
            raise Refused("the catalogue is read-only")
        with scratch(self.spark):
            out = self.store.transact(work)
            if len(self.store.snapshot().parts(INDEX.files)) >= SEGMENTS:
                self.store.transact(INDEX.settle)
            return out

    def _high(self, t: Snapshot, name: str) -> int:
        return self._table(t, name).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _file(self, t: Snapshot, file_id: str) -> DataFrame:
        """The one file's id as a frame."""
        one = self._rows([(file_id,)], "file_id string")
        if not self._table(t, "videos", one).where(F.col("file_id") == file_id).limit(1).count():
            raise Refused("no such file")
        return one

    # ---- reading

    def health(self) -> dict:
        return {"status": "ok"} | self.stats()["summary"]

    def _kept_up(self) -> Snapshot:
        """The newest version with the statistics and signatures that follow the catalogue; what is stale is made anew."""
        t = self.store.snapshot()
        if "videos" in t.tables and any(x.name not in t.tables or x.stale(t) for x in KEPT_UP):

            def work(t: Transaction) -> None:
                if "video_labels" not in t.tables:
                    self._put(t, "video_labels", self._table(t, "video_labels"))
                refreshed(t, *KEPT_UP)

            self._account(work)
            t = self.store.snapshot()
        return t

    def stats(self) -> dict:
        t = self._catalogue()
        shown = {"file_size": bytes_text(F.col("file_size")), "duration_seconds": duration_text(F.col("duration_seconds"))}
        top = lambda c, known=False: as_json(maintained.top_files(t, c, known=known).withColumn("text", shown[c]))
        return {
            "summary": as_json(maintained.summary(t))[0], "extensions": as_json(maintained.top_values(t, "file_extension")), "resolutions": as_json(maintained.top_values(t, "resolution")),
            "largest": top("file_size"), "longest": top("duration_seconds", True),
        }

    def _empty(self) -> Snapshot:
        """A catalogue gets its table of files, empty, when it is first looked at."""
        self._account(lambda t: None if "videos" in t.tables else self._put(t, "videos", self._table(t, "videos")))
        return self._kept_up()

    FACETS = {"folders": "folder_path", "extensions": "file_extension", "resolutions": "resolution", "drives": "shared_drive_name"}

    def _facet(self, t: Snapshot, name: str, after: str = "", size: int = PAGE) -> list[str]:
        c = self.FACETS[name]
        values = maintained.facet(t, c, c).where(F.col(c) > after)
        return [r[c] for r in values.orderBy(c).limit(size).collect()]

    def facet(self, name: str, after: str = "", size: int = PAGE) -> list[str]:
        """The next values of a filter after one, in order; fewer than ``size``: that was the last page."""
        if name not in self.FACETS:
            raise Refused(f"no such filter: {name}")
        return self._facet(self._catalogue(), name, after, min(max(size, 1), PAGE))

    def _catalogue(self) -> Snapshot:
        t = self._kept_up()
        return t if "videos" in t.tables else self._empty()

    def filters(self) -> dict:
        """The first page of each filter's values (facet() has the others), the years, and the first labels by name."""
        t = self._catalogue()
        out = {k: self._facet(t, k) for k in self.FACETS}
        usage = relations.label_usage(self._table(t, "labels"), self._table(t, "video_labels"))
        labels = as_json(usage.orderBy(text.fold(F.col("name")), "id").limit(PAGE))
        return out | {"years": [r["year"] for r in as_json(maintained.years(t).limit(PAGE))], "labels": labels}

    def workflow_stats(self) -> dict:
        t = self._catalogue()
        counts = as_json(maintained.workflow_counts(t))
        return {
            "assets": {r["asset_type"]: r["videos"] for r in counts if r["asset_type"] is not None},
            "stages": {r["workflow_stage"]: r["videos"] for r in counts if r["workflow_stage"] is not None},
            "links": as_json(maintained.flag_counts(t, "linked_cuts", "unlinked_cuts"))[0],
            "tracking": as_json(maintained.flag_counts(t, "new_videos", "missing_labels", "unlinked_cuts", "incomplete"))[0],
        }

    def raw_videos(self, exclude: str = "", after: tuple[str, str] | None = None, size: int = PAGE) -> list[dict]:
        """A page of raw files by label and id; after: the (label, file_id) that the page before ended with."""
        rows = search.raw_options(self._table(self.store.snapshot(), "videos"), exclude)
        if after is not None:
            key = text.fold(F.col("label"))
            at = text.fold(F.lit(after[0]))
            rows = rows.where((key > at) | ((key == at) & (F.col("file_id") > after[1])))
        return as_json(rows.limit(min(max(size, 1), PAGE)))

    def videos(self, request: search.SearchRequest) -> dict:
        """A page of a search, decorated, with the totals."""
        t = self._catalogue()
        table = lambda name: self._table(t, name)
        substring = lambda rows, q: trigrams.text_filter(t, rows, q, table("video_labels"), table("labels"))
        with scratch(self.spark):
            try:
                search.checked_sort(request.sort_by, request.sort_dir)
                found = search.matches(table("videos"), request, table("video_labels"), table("labels"), lambda q: INDEX.search(t, q), substring)
            except ValueError as e:  # a column that can't be sorted by, or a query that can't be read
                raise Refused(str(e)) from e
            total = as_json(search.paged(found, request))[0]
            page = relations.decorated(search.page_of(found, request), table("video_labels"), table("labels"), table("history"))
            return total | {"page": max(request.page, 1), "items": as_json(page.orderBy(*search.ordering(request.sort_by, request.sort_dir)))}

    def video(self, file_id: str) -> dict:
        t = self.store.snapshot()
        with scratch(self.spark):
            rows = as_json(relations.detail(self._table(t, "videos"), file_id, *(self._table(t, x) for x in ("video_labels", "labels", "terms", "bridge", "history"))))
        if not rows:
            raise Refused("no such file")
        return rows[0]

    # ---- editing

    def edit_metadata(self, file_id: str, fields: dict[str, str]) -> dict:
        """Edit fields of a file; its index and terms follow."""

        def work(t: Transaction) -> None:
            one = self._file(t, file_id)
            edits = self._rows([(file_id, k, v) for k, v in fields.items()], "file_id string, field string, value string")
            self._put(t, "videos", merge.edit(self._table(t, "videos", one), edits, F.lit(self.now())), one)
            INDEX.add(t, self._table(t, "videos", one).join(one, "file_id", "left_semi"))
            terms = self._table(t, "terms")
            out = merge.sync_terms(self._table(t, "videos", one), terms, self._table(t, "bridge", one), one, self._high(t, "terms"))
            dimension, bridge = checkpointed(out["terms"]), checkpointed(out["bridge"])
            added = checkpointed(dimension.join(terms.select("id"), "id", "left_anti"))
            if added.limit(1).count():  # only the buckets of new terms are written
                self._put(t, "terms", self._table(t, "terms", added).unionByName(added), added)
            self._put(t, "bridge", bridge, one)

        self._change(work)
        return self.video(file_id)

    def edit_workflow(self, file_id: str, asset_type: str = "", workflow_stage: str = "", source_file_id: str = "", workflow_notes: str = "") -> dict:
        def work(t: Transaction) -> None:
            one = self._file(t, file_id)
            change = self._rows([(file_id, asset_type, workflow_stage, source_file_id, workflow_notes)], "file_id string, asset_type string, workflow_stage string, source_file_id string, workflow_notes string")
            known = self._table(t, "videos", one.union(self._rows([(source_file_id.strip(),)], "file_id string")))
            error = merge.workflow_errors(change, known).first().error
            if error:
                raise Refused(error)
            self._put(t, "videos", merge.update_workflow(self._table(t, "videos", one), change, F.lit(self.now()), known), one)

        self._change(work)
        return self.video(file_id)

    def set_labels(self, file_id: str, names: list[str], user: str) -> dict:
        def work(t: Transaction) -> None:
            one = self._file(t, file_id)
            wanted = self._rows([(file_id, names)], "file_id string, names array<string>")
            labels = self._table(t, "labels")
            out = merge.set_labels(self._table(t, "videos", one), labels.drop("color"), self._table(t, "video_labels"), wanted, user, F.lit(self.now()), self._high(t, "labels"))
            new = {k: checkpointed(df) for k, df in out.items()}
            self._put(t, "videos", new["videos"], one)
            self._put(t, "labels", new["labels"].join(labels.select("id", "color"), "id", "left").select(*labels.columns))
            here = t.touched("video_labels", one)
            self._put(t, "video_labels", new["video_labels"].where(t.bucket("video_labels").isin(here)), one)
            held = self._table(t, "history", one)
            logged = new["history"].withColumn("id", F.lit(self._high(t, "history") + 1))  # one file: one row, or none
            self._put(t, "history", held.unionByName(logged.select(*held.columns)), one)

        self._change(work)
        return self.video(file_id)

    def delete_files(self, prefix: str) -> int:
        """Delete the files whose ids begin with prefix, with all that is theirs; how many there were. Only the buckets of
        these files and of their cuts are written anew, and the labels."""

        def work(t: Transaction) -> int:
            videos = self._table(t, "videos")
            hit = videos.where(F.col("file_id").startswith(prefix) | F.col("source_file_id").startswith(prefix))
            hit = checkpointed(hit.select("file_id"))
            n = hit.where(F.col("file_id").startswith(prefix)).count()
            if n:
                INDEX.remove(t, hit.where(F.col("file_id").startswith(prefix)))
                held = {k: self._table(t, k, hit) for k in ("videos", "video_ids", "bridge", "history")}
                out = merge.cascade_delete(held | {k: self._table(t, k) for k in ("labels", "video_labels")}, prefix)
                for k in held:
                    self._put(t, k, out[k], hit)
                self._put(t, "labels", out["labels"])
                here = t.touched("video_labels", hit)
                self._put(t, "video_labels", out["video_labels"].where(t.bucket("video_labels").isin(here)), hit)
            return n

        return self._change(work)

    # ---- folders and scans

    def drive_folder(self, environment: str | None = None) -> dict:
        """The stored folder, and which one holds: it, else the environment's."""
        s = self._table(self.store.snapshot(), "settings")
        known = self.settings.drive_folder if environment is None else environment
        return as_json(relations.setting_row(s))[0] | as_json(relations.configured_folder(s, known).withColumnRenamed("folder_id", "configured"))[0]

    def _folder(self, t: Snapshot, link: str) -> dict:
        folder_id = self.spark.range(1).select(text.folder_id(F.lit(link.strip())).alias("f")).first().f
        if not folder_id:
            raise Refused("no folder link or id")
        row = as_json(listing.resolve_folder(self._table(t, "items"), folder_id))[0]
        if row["error"]:
            raise Refused(row["error"])
        return row

    def test_folder(self, link: str) -> dict:
        return self._folder(self.store.snapshot(), link)

    def set_drive_folder(self, link: str, user: str) -> dict:
        def work(t: Transaction) -> None:
            row = self._folder(t, link)
            values = self._rows([(f"drive_{k}", row[k]) for k in ("folder_id", "folder_name", "folder_url")], "key string, value string")
            self._put(t, "settings", merge.put_settings(self._table(t, "settings", values), values, F.lit(self.now()), user), values)

        self._change(work)
        return self.drive_folder()

    def search_folders(self, q: str) -> list[dict]:
        return as_json(listing.search_folders(self._table(self.store.snapshot(), "items"), q))

    def scan(self, full: bool = False, folder_id: str = "") -> dict:
        """Crawl the listing from one folder or all roots, and merge what is new into the catalogue, in one transaction."""

        def work(t: Transaction) -> dict:
            items, drives = (self._table(t, k, tracked=False) for k in ("items", "drives"))  # the listing is as it was found
            roots = listing.resolved_root(items, drives, folder_id) if folder_id else listing.roots(drives, self.settings.include_shared_drives)
            folders = items.where(F.col("mimeType") == listing.FOLDER).select("id", F.coalesce("name", "id").alias("name"), F.col("listed_folder_id").alias("parent_id"))
            folders = folders.unionByName(drives.select("id", F.coalesce("name", "id").alias("name"), F.lit(None).cast("string").alias("parent_id")))
            here = checkpointed(listing.reachable(items, roots, self.settings.follow_shortcuts))
            live = items.join(here.select(F.col("folder_id").alias("listed_folder_id")), "listed_folder_id", "left_semi")
            counts = ingest(t, live.select(*items.columns), graph.folder_paths(folders), drives, self.now(), full or not self.settings.incremental, self.settings)
            return counts | {"folders": here.count()}

        with scratch(self.spark):
            out = retried(lambda: self.store.transact(work), is_transient)
            self.store.transact(INDEX.settle)
            return out

    def start_scan(self, full: bool = False, folder_id: str = "") -> bool:
        """Begin a scan in the background; False if one is on."""
        if self.settings.read_only:
            raise Refused("the catalogue is read-only")

        def work() -> dict:
            try:
                out = self.scan(full, folder_id)
            except Exception:
                self.log.exception("scan failed")
                self._record("failed")
                raise
            self.log.info("scan ended: %s", out)
            self._record("succeeded")
            return out

        return self.job.start(work)

    def _record(self, status: str) -> None:
        values = self._rows([("drive_last_scan_status", status), ("drive_last_scan_at", self.now())], "key string, value string")
        self._change(lambda t: self._put(t, "settings", merge.put_settings(self._table(t, "settings", values), values, F.lit(self.now())), values))

    def scan_state(self) -> dict:
        return self.job.state()

    def seed(self) -> None:
        """Put the demonstration's files and labels into an empty catalogue."""
        videos, labels = seed_workflow(self.spark)

        def work(t: Transaction) -> None:
            self._put(t, "videos", videos)
            INDEX.add(t, videos)

        self._change(work)
        for r in labels.collect():
            self.set_labels(r.file_id, list(r.names), "demo")

    # ---- accounts

    def register(self, email: str, password: str, verified: bool = False) -> str:
        """Make an account; the code that its owner is to be sent, empty for a verified one."""

        def work(t: Transaction) -> None:
            users, asked = self._table(t, "users"), self._rows([(email, password)], "email string, password string")
            row = accounts.account_errors(asked, users).first()
            if row.error:
                raise Refused(row.error)
            salt = secrets.token_hex(16)
            new = asked.select("email", accounts.password_hash(F.col("password"), F.lit(salt)).alias("password_hash"), F.lit(salt).alias("password_salt"), F.lit(verified).alias("verified"))
            made = checkpointed(accounts.create_users(users, new, self._high(t, "users"), self.now()))
            added = made.join(users.select("id"), "id", "left_anti")
            self._put(t, "users", self._table(t, "users", added).unionByName(added.select(*users.columns)), added)

        self._account(work)
        return "" if verified else self.send_code(email)

    def _account(self, work: Callable[[Transaction], R]) -> R:
        """Accounts change in a read-only catalogue too."""
        with scratch(self.spark):
            return self.store.transact(work)

    def _user(self, t: Snapshot, email: str) -> DataFrame:
        """The account of an e-mail address as (id, user_id), no row if there is none."""
        found = self._table(t, "users").where(F.col("email") == email.strip().lower())
        return checkpointed(found.select("id", F.col("id").alias("user_id")))

    def send_code(self, email: str, again: bool = False) -> str:
        """A new code for an account; ``again`` keeps to the time between two."""
        code = f"{secrets.randbelow(10**accounts.DIGITS):0{accounts.DIGITS}d}"

        def work(t: Transaction) -> None:
            who = self._user(t, email)
            users, codes = self._table(t, "users", who), self._table(t, "codes", who)
            asked, wait = self._rows([(email, code)], "email string, code string"), accounts.COOLDOWN if again else 0
            row = accounts.code_requests(users, codes, asked, self.now(), wait).first()
            if row.error:
                raise Refused(f"{row.error}, {row.wait_seconds} s" if row.wait_seconds else row.error)
            self._put(t, "codes", accounts.issue_codes(users, codes, asked, self.now(), self.settings.code_minutes, wait), who)

        self._account(work)
        return code

    def verify(self, email: str, code: str) -> None:
        def work(t: Transaction) -> str:
            who = self._user(t, email)
            users, codes = self._table(t, "users", who), self._table(t, "codes", who)
            seen = checkpointed(accounts.code_tries(users, codes, self._rows([(email, code)], "email string, code string"), self.now()))
            outcome = seen.first().outcome
            users, codes = accounts.apply_tries(users, codes, seen, self.now())
            if outcome in ("verified", "wrong code"):
                self._put(t, "codes", codes, who)
            if outcome == "verified":
                self._put(t, "users", users, who)
            return outcome

        outcome = self._account(work)
        if outcome not in ("verified", "known"):
            raise Refused(outcome)

    def login(self, email: str, password: str) -> str:
        """The token of a new session."""
        token = secrets.token_urlsafe(32)

        def work(t: Transaction) -> None:
            who = self._user(t, email)
            users = self._table(t, "users", who)
            seen = checkpointed(accounts.authenticate(users, self._rows([(email, password)], "email string, password string")))
            row = seen.first()
            if row.outcome != "ok":
                raise Refused(row.outcome)
            self._put(t, "users", accounts.logged_in(users, seen, self.now()), who)
            new = self._rows([(hashed(token),)], "token_hash string")
            sessions = accounts.create_sessions(self._table(t, "sessions", new), self._rows([(token, row.user_id)], "token string, user_id long"), self.now(), self.settings.session_days)
            self._put(t, "sessions", sessions, new)

        self._account(work)
        return token

    def me(self, token: str) -> dict:
        """The account of a session and what it may do."""
        t = self.store.snapshot()
        mine = self._rows([(hashed(token),)], "token_hash string")
        sessions = self._table(t, "sessions", mine).join(mine, "token_hash", "left_semi")
        users = self._table(t, "users")
        rows = relations.session_users(sessions, users, self.now()).select(F.col("user_id").alias("id"))
        found = as_json(accounts.allowed(users.join(rows, "id", "left_semi"), self.settings.admin_emails.split(","), self.settings.read_only))
        if not found:
            raise Refused("no session")
        return found[0]

    def logout(self, token: str) -> None:
        def work(t: Transaction) -> None:
            mine = self._rows([(hashed(token),)], "token_hash string")
            self._put(t, "sessions", accounts.delete_sessions(self._table(t, "sessions", mine), self._rows([(token,)], "token string")), mine)

        self._account(work)
