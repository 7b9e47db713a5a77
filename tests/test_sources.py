import json
import threading

import pytest
from pyspark.sql import functions as F

from reelspark import logs
from reelspark.functions import fmt
from reelspark.operators import fulltext, graph, merge, search
from reelspark.schema import VIDEOS
from reelspark.sources import listing
from reelspark.sources.seed import Settings, seed_files, seed_workflow
from reelspark.sources.store import Store
from reelspark.streaming.job import SingleFlight, retried


def test_folder_paths_have_no_depth_limit(spark):
    rows = [(f"n{i}", f"N{i}", f"n{i - 1}" if i else None) for i in range(200)] + [(f"z{i}", f"Z{i}", f"z{(i + 1) % 5}") for i in range(5)] + [("t", "T", "z0"), ("self", "S", "self")]
    got = {r.id: (r.path, r.depth) for r in graph.folder_paths(spark.createDataFrame(rows, "id string, name string, parent_id string")).collect()}
    assert got["n199"] == ("/" + "/".join(f"N{i}" for i in range(200)), 200) and got["n0"] == ("/N0", 1)
    assert got["z0"] == ("/Z4/Z3/Z2/Z1/Z0", 5) and got["t"] == ("/Z4/Z3/Z2/Z1/Z0/T", 6) and got["self"] == ("/S", 1)


def items(spark, tmp_path, rows):
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, rows)))
    return listing.read_listing(spark, f"file://{tmp_path}/items.json")


def folder(name, parent, **more):
    return {"id": name, "name": name.upper(), "mimeType": listing.FOLDER, "listed_folder_id": parent, "scan_seq": 1} | more


def test_crawl_goes_to_any_depth_and_ends_on_cycles(spark, tmp_path):
    rows = [folder(f"f{i}", f"f{i - 1}" if i else "root") for i in range(75)] + [folder("loop", "f3"), folder("gone", "root", trashed=True)]
    rows += [{"id": "s", "name": "back", "mimeType": listing.SHORTCUT, "listed_folder_id": "loop", "shortcutDetails": {"targetId": "f0", "targetMimeType": listing.FOLDER}}]
    rows += [{"id": f"v{i}", "name": "clip.MP4", "mimeType": "x", "listed_folder_id": f"f{i}"} for i in (0, 74)] + [{"id": "lost", "name": "a.mp4", "mimeType": "x", "listed_folder_id": "gone"}]
    rows += [{"id": "dead", "name": "a.mp4", "mimeType": listing.SHORTCUT, "listed_folder_id": "f1"}]
    df = items(spark, tmp_path, rows)
    roots = spark.createDataFrame([("root",)], "folder_id string")
    levels = {r.folder_id: r.level for r in listing.reachable(df, roots).collect()}
    assert levels["f74"] == 75 and levels["loop"] == 5 and "gone" not in levels and len(levels) == 77
    assert sorted(r.file_id for r in listing.crawl(df, roots).collect()) == ["v0", "v74"]
    assert {r.id: r.route for r in listing.routed(df, False).where("id in ('dead', 's')").collect()} == {"dead": "video", "s": "drop"}


def test_listing_reaches_the_scan(spark, tmp_path):
    df = listing.children(items(spark, tmp_path, [folder("a", "x"), folder("b", "y")]), "x").select("id", "name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in df.collect()] == ["a"] and "probe" not in plan and "owners" not in plan


def test_quoting():
    assert listing.query_text(" it's a \\ ") == "it\\'s a \\\\"


def test_probe_is_parsed_once(spark):
    rows = fmt.parsed(spark.createDataFrame([('{"streams":[{"codec_type":"video","width":4294967296,"height":2147483648}]}',)], "probe string"), F.col("probe"))
    text = rows.select("media.*")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") + text.count("jsontostructs") == 1
    assert rows.first().media.aspect_ratio == "2:1"


def test_a_query_reads_the_index_once(spark, tmp_path):
    spark.createDataFrame([("1", "f", 0, "a"), ("1", "f", 1, "b"), ("2", "f", 0, "b"), ("3", "g", 5, "a"), ("3", "g", 2, "c")], "file_id string, field string, pos int, token string").write.parquet(f"{tmp_path}/tokens")
    index = spark.read.parquet(f"{tmp_path}/tokens")
    for query, want in (("a b", ["1"]), ('"a b" OR c', ["1", "3"]), ("b NOT a", ["2"]), ("NEAR(c a, 2)", ["3"]), ("NEAR(c a, 1)", []), ("(a OR c) NOT NEAR(a b, 0)", ["3"]), ("NEAR(a c, 2)", ["3"])):
        found = fulltext.search_index(index, query)
        assert sorted(r.file_id for r in found.collect()) == want, query
        if "NEAR" not in query:
            assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    many = " OR ".join(f"w{i}" for i in range(80)) + " OR c"
    assert [r.file_id for r in fulltext.search_index(index, many).collect()] == ["3"]


def test_sort_is_checked():
    assert search.checked_sort("file_size", "DESC") == ("file_size", "DESC")
    for bad in (("id; drop", "asc"), ("file_size", "up")):
        with pytest.raises(ValueError):
            search.checked_sort(*bad)


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    df = spark.createDataFrame([(f"f{i}", i) for i in range(40)], "file_id string, n int")
    assert store.write("t", df) == 1
    some = df.where("file_id = 'f7'")
    touched = store.snapshot().touched("t", some)
    held = store.read("t", buckets=touched)
    assert len(touched) == 1 and 0 < held.count() < 40
    before = store.snapshot()
    store.write("t", held.withColumn("n", -F.col("n")), touched)
    got = {r.file_id: r.n for r in store.read("t").collect()}
    assert len(got) == 40 and got["f7"] == -7 and sum(n >= 0 for n in got.values()) > 20
    assert store.read("t", version=1).where("n < 0").count() == before.read("t").where("n < 0").count() == 0
    store.write("t", held.limit(0), touched)
    assert store.read("t").count() == 40 - held.count() and store.snapshot().schema("none") is None
    assert store.read("none", VIDEOS).count() == 0


def test_ids_do_not_collide_over_many_partitions(spark):
    files = spark.range(5000).select(F.concat(F.lit("f"), "id").alias("file_id"), (F.col("id") % 7).alias("scan_seq")).repartition(9)
    got = [r.id for r in merge.assign_ids(files, files.limit(0), 10).collect()]
    assert sorted(got) == list(range(11, 5011))


def test_settings_and_seed(spark):
    s = Settings.read({"READ_ONLY": "yes", "MAX_DOWNLOAD_MB": "2.5", "SESSION_DAYS": "", "OTHER": "x"})
    assert (s.read_only, s.max_download_mb, s.session_days, s.incremental) == (True, 2.5, 14, True)
    assert seed_files(spark).dtypes == spark.createDataFrame([], VIDEOS).dtypes and seed_workflow(spark)[1].count() == 3


def test_json_log_lines(tmp_path):
    log = logs.configure("info", f"{tmp_path}/log", "reelspark.test")
    log.info("été %d", 3)
    try:
        raise KeyError("x")
    except KeyError:
        log.exception("bad")
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert lines[0]["message"] == "été 3" and lines[0]["level"] == "INFO" and "KeyError" in lines[1]["error"]


def test_single_flight():
    go, job = threading.Event(), SingleFlight()
    assert job.state() == {"status": "idle"}
    assert job.start(lambda: go.wait(10) and {"found": 3}) and not job.start(dict)
    assert job.state()["status"] == "running"
    go.set()
    job.join(10)
    assert (job.state()["status"], job.state()["found"]) == ("succeeded", 3)
    assert job.start(lambda: 1 / 0)
    job.join(10)
    assert job.state()["status"] == "failed" and "division" in job.state()["message"]


def test_retries():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("busy")
        return "done"

    assert retried(call, lambda e: isinstance(e, OSError), sleep=waits.append) == "done" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        retried(lambda: int("x"), lambda e: isinstance(e, OSError), sleep=waits.append)
