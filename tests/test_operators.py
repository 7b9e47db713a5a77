import json

import pytest
from pyspark.sql import functions as F

from reelspark.operators import fulltext, graph, merge, search
from reelspark.schema import PROTECTED, VIDEOS, align
from reelspark.sources.store import Store


def catalogue(spark, rows):
    return align(spark.createDataFrame(rows, "file_id string, file_name string, editorial_title string, file_size long"))


def test_upsert_keeps_what_editors_own(spark):
    old = catalogue(spark, [("a", "old", "mine", 1), ("b", "kept", "", 2)])
    new = catalogue(spark, [("a", "new", "theirs", 9), ("c", "added", "", 3)])
    merged = merge.upsert(old, new, now=F.lit("now"))
    got = {r.file_id: r for r in merged.collect()}
    assert (got["a"].file_name, got["a"].editorial_title, got["a"].file_size) == ("new", "mine", 9)
    assert got["b"].file_name == "kept" and got["c"].first_seen_at == "now" and len(PROTECTED) == 41
    assert sorted(merge.upsert(merged, new).collect()) == sorted(merged.collect())


def test_ids_go_on_in_order(spark):
    files = spark.createDataFrame([(f"f{i}", 100 - i) for i in range(50)], "file_id string, scan_seq long")
    known = files.where("scan_seq <= 60").select("file_id")
    got = {r.file_id: (r.id, r.internal_video_id) for r in merge.assign_ids(files, known, 7).collect()}
    assert got == {f"f{i}": (8 + 39 - i, f"CHR-VID-{8 + 39 - i:06d}") for i in range(40)}


def test_folder_cycles_and_orphans(spark):
    rows = [("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("x", "X", "y"), ("y", "Y", "x"), ("o", "O", "gone")]
    got = {r.id: r.path for r in graph.folder_paths(spark.createDataFrame(rows, "id string, name string, parent_id string")).collect()}
    assert got == {"a": "/A", "b": "/A/B", "c": "/A/B/C", "x": "/Y/X", "y": "/X/Y", "o": "/O"}


def test_full_text_language(spark):
    df = catalogue(spark, [("1", "La Prière du matin", "Foi", 1), ("2", "priere du soir", "", 1), ("3", "matin", "du soir", 1)])
    index = fulltext.token_index(df)
    find = lambda q: sorted(r.file_id for r in fulltext.search_index(index, q).collect())
    assert find("PRIERE") == ["1", "2"] and find("matin foi") == ["1"] and find("foi OR soir") == ["1", "2", "3"]
    assert find("matin NOT foi") == ["3"] and find('"du soir"') == ["2", "3"] and find("editorial_title:soir") == ["3"]
    assert find("(foi OR soir) NOT priere") == ["3"] and find("mat*") == ["1", "3"] and find("^du") == ["3"] and find("NEAR(la matin, 1)") == []
    for bad in ("a - b", "it's", "a.b", '"open', "OR", "(a", "", "nocolumn:x", "NEAR(a, b)"):
        with pytest.raises(fulltext.QuerySyntaxError):
            fulltext.search_index(index, bad)


def test_pages_join_up(spark):
    df = catalogue(spark, [(str(i), f"{'aB'[i % 2]}{i % 3}", None, i % 4) for i in range(17)])
    order = [r.file_id for r in df.orderBy(*search.ordering("file_name", "asc")).collect()]
    pages = [r.file_id for p in range(1, 5) for r in search.page_of(df, search.SearchRequest(page=p, page_size=5)).collect()]
    assert pages == order and search.page_count(17, 5) == 4 and search.page_count(0, 5) == 1


def test_plans(spark):
    df, bridge = catalogue(spark, [("a", "x", "", 1)]), spark.createDataFrame([("a", 1)], "file_id string, label_id long")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan(search.tracked(df, "missing_labels", bridge))
    assert "TakeOrderedAndProject" in plan(search.page_of(df, search.SearchRequest()))


def test_streamed_rescans(spark, tmp_path):
    from reelspark.sources import listing
    from reelspark.streaming.rescan import INDEX, start

    def item(seq, name, stamp, **more):
        return {"id": f"id-{name}", "name": name, "mimeType": "video/mp4", "size": "10", "modifiedTime": stamp, "scan_seq": seq, "listed_folder_id": "f"} | more

    landing, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    landing.mkdir()
    paths, drives = spark.createDataFrame([("f", "/Sermons/2020")], "id string, path string"), spark.createDataFrame([], "id string, name string")
    run = lambda: start(spark, str(landing), store, paths, drives, str(tmp_path / "state"), "now").awaitTermination(120)
    first = [item(1, "Prayer.mp4", "t1"), item(2, "Prayer.mp4", "t2"), item(3, "note.txt", "t", mimeType="text/plain"), item(4, "bad.mp4", "t", size="x")]
    (landing / "a.json").write_text("\n".join(map(json.dumps, first)))
    run()
    rows = store.read("videos").collect()
    assert [(r.file_id, r.modified_at, r.main_theme, r.internal_video_id) for r in rows] == [("id-Prayer.mp4", "t2", "Prayer", "CHR-VID-000001")]
    (landing / "b.json").write_text("\n".join(map(json.dumps, [item(5, "Prayer.mp4", "t2"), item(6, "Faith.mov", "t", mimeType="x")])))
    run()
    got = {r.file_id: r.internal_video_id for r in store.read("videos", VIDEOS).collect()}
    assert got == {"id-Prayer.mp4": "CHR-VID-000001", "id-Faith.mov": "CHR-VID-000002"}
    assert [r.file_id for r in INDEX.search(store.snapshot(), "faith").collect()] == ["id-Faith.mov"]
    bad = ["{not json", json.dumps(item(7, "Lost.mov", "t", listed_folder_id="nowhere")), json.dumps(item(8, "Nameless.mov", "t") | {"id": None}), json.dumps(item(9, "Hope.mov", "t", mimeType="x")), ""]
    (landing / "c.json").write_text("\n".join(bad))
    run()
    assert {r.file_id for r in store.read("videos").collect()} == {"id-Prayer.mp4", "id-Faith.mov", "id-Hope.mov"}
    dead = store.read("dead_letters")
    assert sorted((r.reason, r.record if r.reason == "malformed" else r.id, r.source[-6:]) for r in dead.collect()) == [
        ("malformed", "{not json", "c.json"), ("no id", None, "c.json"), ("no such folder", "id-Lost.mov", "c.json"), ("size is no number", "id-bad.mp4", "a.json"),
    ]
    mended = dead.withColumn("record", F.regexp_replace("record", '"size": "x"', '"size": "5"'))
    items, still = listing.replayed(mended, spark.createDataFrame([("f",), ("nowhere",)], "id string"))
    assert sorted(r.id for r in items.collect()) == ["id-Lost.mov", "id-bad.mp4"] and sorted(r.reason for r in still.collect()) == ["malformed", "no id"]


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
