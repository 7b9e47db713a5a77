"""Versioned Parquet tables in buckets of a key, changed by transactions.

A version is one commit file that lists, for every table, the folder of each bucket. Data folders are written once and never
changed, so a reader that holds a version sees all tables as they were together. A transaction reads one version, writes
new folders of the buckets that it touches, and commits by making the next commit file, which only one writer can
make. One that comes second looks at what the winner changed: if that is nothing it read or wrote, its buckets are listed
on top of the winner's and it tries the next number; otherwise its work is done again on the winner's version. So no
change is lost and every outcome is that of some order of the transactions, one after another.

A table may have migration steps. Every bucket notes the version of the table's columns that it was written at; readers take
older buckets through the steps that they lack, and whatever is rewritten is of the newest version. So a migration costs
nothing until rows are read or written, and migrate() brings the rest along when there is time.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import forget

R = TypeVar("R")
#: Bytes of a bucket from which grow() doubles the number of a table's buckets.
BUCKET_BYTES = 256 << 20


class Conflict(RuntimeError):
    """A transaction that met other writers at every try."""


class Store:
    """Tables under one folder. ``keys`` names the column that a table's rows are bucketed by, where it isn't ``key``; a table
    without its key column has one bucket. A new table has ``buckets`` of them. ``steps``: for a table, functions that each
    take its rows from one version of its columns to the next; the first version is 1."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, key: str = "file_id", keys: dict[str, str] | None = None, steps: dict[str, list[Callable[[DataFrame], DataFrame]]] | None = None):
        self.spark, self.root, self.buckets, self.key, self.keys, self.steps = spark, root.rstrip("/"), buckets, key, keys or {}, steps or {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"

    # ---- commits

    def _names(self, at: str) -> list[str]:
        path = self._path(at)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _commit_path(self, number: int) -> str:
        return f"{self.root}/commits/{number:012d}"

    def _commit(self, number: int) -> dict:
        stream = self._fs.open(self._path(self._commit_path(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        """The number of the newest commit, 0 if there is none."""
        return max((int(n) for n in self._names(f"{self.root}/commits") if n.isdigit()), default=0)

    def _put(self, number: int, record: dict) -> bool:
        """Make a commit file, whole or not at all; False if it is there already."""
        to, temporary = self._commit_path(number), f"{self.root}/commits/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(temporary), False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        return (self._link if self._local else self._rename)(temporary, to)

    def _link(self, temporary: str, to: str) -> bool:
        """A hard link is made by one of several writers only."""
        at = [self._path(p).toUri().getPath() for p in (temporary, to)]
        try:
            os.link(*at)
            return True
        except FileExistsError:
            return False
        finally:
            forget(self.spark, temporary)

    def _rename(self, temporary: str, to: str) -> bool:
        """A rename that never replaces, which distributed file systems do in one step. (An object store without one needs a
        committer of its own here.)"""
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._path(temporary), self._path(to), options)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                forget(self.spark, temporary)
                return False
            raise

    # ---- use

    def snapshot(self, version: int | None = None) -> Snapshot:
        """All tables as of one commit, the newest if none is named."""
        number = self.version() if version is None else version
        return Snapshot(self, number, self._commit(number)["tables"] if number else {})

    def transact(self, work: Callable[[Transaction], R], tries: int = 20) -> R:
        """work(transaction), committed; done again on the newest version when another writer changed what it read or wrote.
        An error in work commits nothing."""
        for n in range(tries):
            at = self.snapshot()
            change = Transaction(self, at.number, at.tables)
            try:
                out = work(change)
                if change._committed():
                    return out
            except BaseException:
                change._undo()
                raise
            change._undo()
            time.sleep(random.uniform(0, min(2.0, 0.05 * 2**n)))
        raise Conflict(f"{tries} tries met other writers")

    def read(self, name: str, schema: T.StructType | None = None, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self.snapshot(version).read(name, schema, buckets)

    def write(self, name: str, df: DataFrame, buckets: list[int] | None = None) -> int:
        """A transaction of one table: df as the whole of it, or as all rows of these buckets; the new version."""
        self.transact(lambda t: t.write(name, df, buckets))
        return self.version()

    # ---- upkeep

    def grow(self, name: str, bucket_bytes: int = BUCKET_BYTES) -> int:
        """Double the number of a table's buckets until one holds bucket_bytes on average at most; the number."""

        def work(t: Transaction) -> int:
            held = t.tables[name]
            size = sum(self._fs.getContentSummary(self._path(f"{self.root}/{at}")).getLength() for at in held["files"].values())
            n = held["buckets"]
            while held["key"] and size > n * bucket_bytes:
                n *= 2
            if n != held["buckets"]:
                t.write(name, t.read(name), count=n)
            return n

        return self.transact(work)

    def migrate(self, name: str, buckets: int | None = None) -> list[int]:
        """Rewrite the buckets of a table that are of older versions of its columns, at most so many; which."""

        def work(t: Transaction) -> list[int]:
            old = [int(b) for b, v in t.tables.get(name, {}).get("of", {}).items() if int(v) < t.newest(name)]
            some = sorted(old)[:buckets]
            if some:
                t.write(name, t.read(name, buckets=some), some)
            return some

        return self.transact(work)

    def vacuum(self, keep: int = 10, age_seconds: float = 86_400) -> int:
        """Delete data folders older than that which none of the newest ``keep`` commits lists, and older commits; how many
        folders went. Transactions and readers that go on for longer than the age are not looked after."""
        last = self.version()
        first = max(1, last - keep + 1)
        used = {at.split("/bucket=")[0] for n in range(first, last + 1) for t in self._commit(n)["tables"].values() for at in t["files"].values()}
        before, gone = time.time() * 1000 - age_seconds * 1000, 0
        for name in self._names(f"{self.root}/data"):
            for status in self._fs.listStatus(self._path(f"{self.root}/data/{name}")):
                folder = f"data/{name}/{status.getPath().getName()}"
                if folder not in used and status.getModificationTime() <= before:
                    forget(self.spark, f"{self.root}/{folder}")
                    gone += 1
        for n in self._names(f"{self.root}/commits"):
            if n.isdigit() and int(n) < first:
                forget(self.spark, f"{self.root}/commits/{n}")
        return gone


class Snapshot:
    """All tables of one version."""

    def __init__(self, store: Store, number: int, tables: dict[str, dict]):
        self.store, self.number, self.tables = store, number, tables

    def schema(self, name: str) -> T.StructType | None:
        """The columns of a stored table as it was last written, None if there is none."""
        return T.StructType.fromJson(self.tables[name]["schema"]) if name in self.tables else None

    def bucket(self, name: str) -> Column:
        """The bucket of a row of this table."""
        key, n = self._bucketing(name)
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def _bucketing(self, name: str) -> tuple[str, int]:
        held = self.tables.get(name, {})
        return held.get("key") or self.store.keys.get(name, self.store.key), held.get("buckets") or self.store.buckets

    def parts(self, name: str) -> list[int]:
        """The numbers of a table's parts or buckets."""
        return sorted(int(b) for b in self.tables.get(name, {"files": {}})["files"])

    def size(self, name: str, buckets: list[int]) -> int:
        """Bytes of some parts or buckets of a table."""
        of = self.store
        return sum(of._fs.getContentSummary(of._path(f"{of.root}/{at}")).getLength() for b, at in self.tables.get(name, {"files": {}})["files"].items() if int(b) in buckets)

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of a table that rows, which hold its key column, fall into: at most as many as it has."""
        return sorted(r.b for r in rows.select(self.bucket(name).alias("b")).distinct().collect())

    def read(self, name: str, schema: T.StructType | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or only some buckets of it; empty, with this schema, if there is none."""
        spark = self.store.spark
        if name not in self.tables:
            if schema is None:
                raise LookupError(f"no table {name}")
            return spark.createDataFrame([], schema)
        held = self.tables[name]
        steps, by_version = self.store.steps.get(name, []), {}
        for b, at in sorted(held["files"].items()):
            if buckets is None or int(b) in buckets:
                by_version.setdefault(int(held["of"][b]) if steps else 1, []).append(f"{self.store.root}/{at}")
        frames = []
        for v, paths in by_version.items() or [(self.newest(name), [])]:
            known = T.StructType.fromJson(held["schemas"][str(v)]) if steps and str(v) in held["schemas"] else self.schema(name)
            rows = spark.read.schema(known).parquet(*paths) if paths else spark.createDataFrame([], known)
            for step in steps[v - 1 :] if paths else []:
                rows = step(rows)
            frames.append(rows)
        out = frames[0]
        for rows in frames[1:]:
            out = out.unionByName(rows.select(*out.columns))
        return out

    def newest(self, name: str) -> int:
        """The version of a table's columns that its steps lead to."""
        return len(self.store.steps.get(name, [])) + 1


class Transaction(Snapshot):
    """A snapshot that can be written to; it reads its own writes."""

    def __init__(self, store: Store, number: int, tables: dict[str, dict]):
        super().__init__(store, number, dict(tables))
        self._seen: dict[str, set[int] | None] = {}  # None: the whole table
        self._changed: dict[str, set[int] | None] = {}
        self._folders: list[str] = []

    @staticmethod
    def _note(of: dict[str, set[int] | None], name: str, buckets: list[int] | None) -> None:
        held = of.get(name, set())
        of[name] = None if buckets is None or held is None else held | set(buckets)

    def read(self, name: str, schema: T.StructType | None = None, buckets: list[int] | None = None, tracked: bool = True) -> DataFrame:
        """As for a snapshot. What is read must not change until the commit, unless it isn't tracked."""
        if tracked:
            self._note(self._seen, name, buckets)
        return super().read(name, schema, buckets)

    def write(self, name: str, df: DataFrame, buckets: list[int] | None = None, count: int | None = None) -> None:
        """df as the whole table, or as all rows of these buckets, the others as they are. count: buckets from now on."""
        key, n = self._bucketing(name)
        keyed = key in df.columns
        if name not in self.tables or count:
            buckets = None if count else buckets
        n = (count or n) if keyed else 1
        folder = f"data/{name}/{uuid.uuid4().hex}"
        self._folders.append(folder)
        at = F.pmod(F.xxhash64(key), F.lit(n)).cast("int") if keyed else F.lit(0)
        df.withColumn("bucket", at).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.store.root}/{folder}")
        written = {x[7:]: f"{folder}/{x}" for x in self.store._names(f"{self.store.root}/{folder}") if x.startswith("bucket=")}
        buckets = buckets if keyed else None
        kept = {} if buckets is None or name not in self.tables else {b: x for b, x in self.tables[name]["files"].items() if int(b) not in buckets}
        was, v, schema = self.tables.get(name, {}), self.newest(name), json.loads(df.schema.json())
        versions = {b: x for b, x in was.get("of", {}).items() if b in kept} | dict.fromkeys(written, str(v))
        self.tables[name] = {"schema": schema, "schemas": was.get("schemas", {}) | {str(v): schema}, "key": key if keyed else "", "buckets": n, "files": kept | written, "of": versions}
        self._note(self._changed, name, buckets)

    def put_part(self, name: str, part: int, df: DataFrame, **options) -> None:
        """df, as it is dealt and sorted, as one part of a table that is kept in numbered parts instead of buckets."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        self._folders.append(folder)
        df.write.options(**options).parquet(f"{self.store.root}/{folder}")
        held = self.tables.get(name, {"files": {}})["files"]
        self.tables[name] = {"schema": json.loads(df.schema.json()), "key": "", "buckets": 0, "files": held | {str(part): folder}}
        self._note(self._changed, name, [part])

    def drop_parts(self, name: str, parts: list[int]) -> None:
        held = self.tables[name]
        self.tables[name] = held | {k: {b: x for b, x in held.get(k, {}).items() if int(b) not in parts} for k in ("files", "of")}
        self._note(self._changed, name, parts)

    def put_parts(self, name: str, df: DataFrame, of: dict[int, str], **options) -> None:
        """Several parts in one go: df has its rows' part in ``part``, and each is noted to be made from the source that
        ``of`` names; parts without rows are empty from now on."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        self._folders.append(folder)
        df.write.options(**options).partitionBy("part").parquet(f"{self.store.root}/{folder}")
        written = {x[5:]: f"{folder}/{x}" for x in self.store._names(f"{self.store.root}/{folder}") if x.startswith("part=")}
        held = self.tables.get(name, {})
        files = {b: x for b, x in held.get("files", {}).items() if int(b) not in of} | written
        sources = held.get("of", {}) | {str(b): x for b, x in of.items()}
        self.tables[name] = {"schema": json.loads(df.drop("part").schema.json()), "key": "", "buckets": 0, "files": files, "of": sources}
        self._note(self._changed, name, sorted(of))

    def _committed(self) -> bool:
        if not self._changed:
            return True
        mine, number = self.tables, self.number
        while True:
            record = {"tables": mine, "changed": {t: None if b is None else sorted(b) for t, b in self._changed.items()}}
            if self.store._put(number + 1, record):
                return True
            number += 1
            theirs = self.store._commit(number)
            for name, buckets in theirs["changed"].items():
                for of in (self._seen, self._changed):
                    if name in of and (buckets is None or of[name] is None or of[name] & set(buckets)):
                        return False
            merged = dict(theirs["tables"])
            for name, buckets in self._changed.items():
                if buckets is None:
                    merged[name] = mine[name]
                else:
                    touched = {str(b) for b in buckets}
                    theirs_now = merged.get(name, {})
                    merged[name] = mine[name] | {
                        k: {b: x for b, x in theirs_now.get(k, {}).items() if b not in touched} | {b: x for b, x in mine[name].get(k, {}).items() if b in touched}
                        for k in ("files", "of")
                    }
            mine = merged

    def _undo(self) -> None:
        for folder in self._folders:
            forget(self.store.spark, f"{self.store.root}/{folder}")
