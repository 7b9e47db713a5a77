"""Transactions of the store: no lost change, no mixed versions, growing buckets, cleaning up."""

import threading

import pytest
from pyspark.sql import functions as F

from reelspark.service import Service
from reelspark.sources import listing
from reelspark.sources.seed import Settings
from reelspark.sources.store import Conflict, Store
from reelspark.streaming.rescan import INDEX


def rows(spark, n, schema="file_id string, n long"):
    return spark.createDataFrame([(f"f{i}", 0) for i in range(n)], schema)


def add_one(store, name, file_id):
    def work(t):
        one = store.spark.createDataFrame([(file_id,)], "file_id string")
        here = t.touched(name, one)
        t.write(name, t.read(name, buckets=here).withColumn("n", F.col("n") + (F.col("file_id") == file_id).cast("long")), here)

    return work


def in_threads(*calls):
    errors = []

    def guarded(call):
        try:
            call()
        except BaseException as e:
            errors.append(e)

    threads = [threading.Thread(target=guarded, args=(c,)) for c in calls]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not errors, errors


def test_writers_of_one_table_lose_nothing(spark, tmp_path):
    """Three threads that add to two files each, in the same and in other buckets: every addition is there."""
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    store.write("t", rows(spark, 12))
    in_threads(*(lambda k=k: [store.transact(add_one(store, "t", f)) for f in (f"f{k}", "f11")] for k in range(3)))
    got = {r.file_id: r.n for r in store.read("t").collect()}
    assert got == {f"f{i}": 3 if i == 11 else 1 if i < 3 else 0 for i in range(12)} and store.version() == 7


def test_rebase_and_rerun(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=8)
    store.write("t", rows(spark, 40))
    at = store.snapshot()
    bucket = {r.file_id: r.b for r in at.read("t").select("file_id", at.bucket("t").alias("b")).collect()}
    other = next(f for f in bucket if bucket[f] != bucket["f0"])
    near = next(f for f in bucket if bucket[f] == bucket["f0"] and f != "f0")
    for mine, runs in ((other, 1), (near, 2)):  # another bucket: listed on top of the winner's; the same: done again
        tries = []

        def work(t, mine=mine, tries=tries):
            add_one(store, "t", mine)(t)
            if not tries:
                store.transact(add_one(store, "t", "f0"))  # somebody else is first
            tries.append(1)

        store.transact(work)
        assert len(tries) == runs
    got = {r.file_id: r.n for r in store.read("t").collect()}
    assert len(got) == 40 and (got["f0"], got[other], got[near]) == (2, 1, 1) and sum(got.values()) == 4
    tries = []

    def reads_all(t):  # what was read must not have changed either, unless it wasn't tracked
        total = t.read("t", tracked=not tries or tries[0]).agg(F.sum("n")).first()[0]
        if len(tries) < 2:
            store.transact(add_one(store, "t", "f1"))
        tries.append(True)
        t.write("total", spark.createDataFrame([("x", total)], "file_id string, n long"))

    store.transact(reads_all)
    assert len(tries) == 3 and store.read("total").first().n == 6
    with pytest.raises(Conflict):
        store.transact(lambda t: (add_one(store, "t", "f0")(t), store.transact(add_one(store, "t", "f0"))), tries=2)


def test_tables_change_together(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    store.transact(lambda t: (t.write("a", rows(spark, 3)), t.write("b", rows(spark, 3))))
    seen = store.snapshot()

    def broken(t):
        t.write("a", t.read("a").withColumn("n", F.lit(9).cast("long")))
        assert t.read("a").where("n = 9").count() == 3  # its own writes are what it reads
        raise KeyError("x")

    with pytest.raises(KeyError):
        store.transact(broken)
    assert store.version() == 1 and store.read("a").where("n = 9").count() == 0
    assert len(list((tmp_path / "s/data/a").iterdir())) == 1  # what it wrote is gone
    store.transact(lambda t: [t.write(k, t.read(k).withColumn("n", F.lit(5).cast("long"))) for k in "ab"])
    assert [seen.read(k).agg(F.sum("n")).first()[0] for k in "ab"] == [0, 0]
    assert [store.read(k).agg(F.sum("n")).first()[0] for k in "ab"] == [15, 15]


def test_commit_files_are_made_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store._put(1, {"tables": {}, "changed": {}}) and not store._put(1, {"tables": {"x": 1}, "changed": {}})
    assert store._commit(1)["tables"] == {} and store.version() == 1
    store._local = False  # file systems whose rename doesn't replace
    assert store._put(2, {"tables": {}, "changed": {}}) and not store._put(2, {"tables": {"x": 1}, "changed": {}})
    assert store._commit(2)["tables"] == {} and [x for x in (tmp_path / "s/commits").iterdir() if x.name.startswith(".") and not x.name.endswith(".crc")] == []


def test_growth_and_cleaning(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=2, keys={"users": "id"})
    store.write("t", rows(spark, 50))
    store.write("users", spark.range(20))
    assert store.grow("t") == 2 and store.grow("t", 300) > 2 and store.snapshot().tables["users"]["buckets"] == 2
    assert len(store.snapshot().tables["users"]["files"]) == 2  # rows without a file_id have a key of their own
    for f in ("f1", "f2", "f3"):
        store.transact(add_one(store, "t", f))
    got = {r.file_id: r.n for r in store.read("t").collect()}
    assert len(got) == 50 and sum(got.values()) == 3
    old = store.snapshot(2)
    assert store.vacuum(keep=2, age_seconds=3600) == 0 and old.read("t").count() == 50
    assert store.vacuum(keep=1, age_seconds=-5) >= 1
    assert {r.file_id: r.n for r in store.read("t").collect()} == got and store.read("users").count() == 20


def test_a_scan_among_edits_loses_nothing(spark, tmp_path):
    """A scan in the background, and two threads that edit and label other files meanwhile."""
    item = lambda i, seq: {"id": f"v{i}", "name": f"clip {i}.mp4", "listed_folder_id": "root", "size": str(seq), "modifiedTime": f"t{seq}", "scan_seq": seq, "mimeType": "x"}
    service = Service(spark, Store(spark, f"file://{tmp_path}/s", buckets=8), Settings())
    service.store.write("items", spark.createDataFrame([item(i, 1) for i in range(6)], listing.ITEM))
    assert service.scan()["indexed"] == 6
    service.store.write("items", spark.createDataFrame([item(i, 2) for i in range(9)], listing.ITEM))
    assert service.start_scan()
    in_threads(lambda: service.edit_metadata("v0", {"editorial_title": "Zero"}), lambda: (service.set_labels("v1", ["One"], "me"), service.edit_metadata("v1", {"speaker": "Ann"})))
    service.job.join(300)
    assert service.scan_state()["status"] == "succeeded" and service.scan_state()["indexed"] == 9
    t = service.store.snapshot()
    videos = {r.file_id: r for r in t.read("videos").collect()}
    assert len(videos) == 9 and all(v.file_size == 2 for v in videos.values())
    assert (videos["v0"].editorial_title, videos["v1"].speaker) == ("Zero", "Ann")
    ids = [r.id for r in t.read("video_ids").collect()]
    assert sorted(ids) == list(range(1, 10)) and service.video("v1")["labels"] == ["One"]
    found = lambda q: {r.file_id for r in INDEX.search(t, q).collect()}
    assert (found("zero"), found("ann"), found("clip")) == ({"v0"}, {"v1"}, set(videos))
