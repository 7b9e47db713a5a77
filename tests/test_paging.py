"""Late pages and migrations."""

import pytest
from pyspark.sql import functions as F
from test_stored import videos

from reelspark.operators import paging, search
from reelspark.operators.paging import StoredOrder
from reelspark.operators.search import SearchRequest
from reelspark.sources.derived import Derived
from reelspark.sources.store import Store


@pytest.mark.parametrize(("by", "down"), [("file_size", "desc"), ("duration_seconds", "asc"), ("duration_seconds", "desc"), ("editorial_title", "asc"), ("file_name", "desc")])
def test_pages_after_the_last_row_are_the_pages(spark, by, down):
    import random

    rows = videos(spark, random.Random(6), [f"f{i}" for i in range(53)]).coalesce(1)
    r = SearchRequest(sort_by=by, sort_dir=down, page_size=20)
    last, got = None, []
    while page := paging.page_after(rows, r, last).collect():
        got += [x.file_id for x in page]
        last = (page[-1][by], page[-1].file_name, page[-1].file_id)
    assert got == [x.file_id for x in rows.orderBy(*search.ordering(by, down)).collect()] and len(got) == 53
    plan = paging.page_after(rows, r, last)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Offset" not in plan


def test_a_stored_order_reads_one_range(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(paging, "RANGE_ROWS", 20)
    rows = videos(spark, random.Random(7), [f"f{i}" for i in range(90)])
    store, order = Store(spark, f"file://{tmp_path}/s"), StoredOrder(SearchRequest(sort_by="file_size", sort_dir="desc"))
    store.transact(lambda t: order.build(t, rows))
    at = store.snapshot()
    want = [x.file_id for x in rows.orderBy(*search.ordering("file_size", "desc")).collect()]
    ranges = at.parts(order.name)
    assert len(ranges) > 2
    for page in (1, 2, 9, 13, 14):
        some, _ = order.ranges_of(at, page, 7)
        assert len(some) <= 2 and [x.file_id for x in order.page(at, page, 7).collect()] == want[(page - 1) * 7 : page * 7]
    store.transact(lambda t: order.build(t, rows.limit(10)))
    assert order.page(store.snapshot(), 2, 7).count() == 3


def test_migrations_are_lazy(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    first = Store(spark, root, buckets=4)
    rows = spark.createDataFrame([(f"f{i}", i) for i in range(40)], "file_id string, n int")
    first.write("t", rows)
    steps = [lambda df: df.withColumn("size", F.col("n").cast("long") * 2), lambda df: df.withColumnRenamed("n", "number").withColumn("note", F.lit("old"))]
    store = Store(spark, root, buckets=4, steps={"t": steps})
    want = sorted((f"f{i}", i, 2 * i, "old") for i in range(40))
    got = lambda: sorted((r.file_id, r.number, r["size"], r.note) for r in store.read("t").collect())
    files = lambda: store.snapshot().tables["t"]["files"]
    counted = Derived("counted", ["t"], lambda t: t.groupBy("part").agg(F.sum("size").alias("n")))
    store.transact(counted.refresh)
    before = files()
    assert got() == want and store.read("t").columns == ["file_id", "number", "size", "note"]
    here = store.snapshot().touched("t", spark.createDataFrame([("f3",)], "file_id string"))
    store.transact(lambda t: t.write("t", t.read("t", buckets=here).withColumn("note", F.when(F.col("file_id") == "f3", "new").otherwise(F.col("note"))), here))
    want = sorted((i, n, s, "new" if i == "f3" else x) for i, n, s, x in want)
    assert got() == want and {b for b in before if before[b] != files()[b]} == {str(b) for b in here}  # the others are as they were
    assert len(store.migrate("t", 1)) == 1 and got() == want
    rest = store.migrate("t")
    assert sorted([*rest, *here]) != [] and len(rest) == len(before) - 2 and got() == want
    version = store.version()
    assert store.migrate("t") == [] and store.version() == version
    third = Store(spark, root, buckets=4, steps={"t": [*steps, lambda df: df.withColumn("size", F.col("size") + 1)]})
    assert set(counted.stale(third.snapshot())) == {int(b) for b in before}  # new columns make what follows them stale
    third.transact(counted.refresh)
    assert counted.read(third.snapshot()).agg(F.sum("n")).first()[0] == sum(2 * i + 1 for i in range(40))


def test_subtrees_are_ranges(spark, tmp_path):
    from reelspark.operators import graph

    rows = [("a", "A", None), ("b", "B", "a"), ("b0", "B0", "a"), ("c", "C", "b"), ("d", "D", "c"), ("e", "E", None), ("f", "F", "e"), ("x", "X", "y"), ("y", "Y", "x")]
    folders = spark.createDataFrame(rows, "id string, name string, parent_id string")
    graph.folder_labels(folders).write.parquet(f"{tmp_path}/labels")
    labels = spark.read.parquet(f"{tmp_path}/labels")
    below = lambda of, i: sorted(r.id for r in graph.subtree(of, i).collect())
    assert (below(labels, "b"), below(labels, "a"), below(labels, "f"), below(labels, "none")) == (["b", "c", "d"], ["a", "b", "b0", "c", "d"], ["f"], [])
    plan = graph.subtree(labels, "b")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(label,a/b/)" in plan and "LessThan(label,a/b0)" in plan  # a range that the scan skips to
    files = spark.createDataFrame([("1", "d"), ("2", "b0"), ("3", "b")], "id string, listed_folder_id string")
    assert sorted(r.id for r in graph.files_below(files, labels, "b").collect()) == ["1", "3"]
    after = graph.moved(labels, "b", "f")
    changed = [r.id for r in after.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").collect()]
    assert sorted(changed) == ["b", "c", "d"] and (below(after, "e"), below(after, "a")) == (["b", "c", "d", "e", "f"], ["a", "b0"])
    assert {r.id: r.path for r in graph.paths_of(graph.subtree(after, "f"), after).collect()} == {"f": "/E/F", "b": "/E/F/B", "c": "/E/F/B/C", "d": "/E/F/B/C/D"}
    assert below(graph.moved(after, "c", None), "c") == ["c", "d"]
    for bad in (("a", "d"), ("none", "a"), ("a", "none"), ("a", "a")):
        with pytest.raises(ValueError):
            graph.moved(labels, *bad)


def test_ranges_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "RANGE_BYTES", 2000)
    rows = spark.createDataFrame([(f"f{i:03}", "n" * 40, i % 17) for i in range(300)], "file_id string, file_name string, file_size long")
    store, order = Store(spark, f"file://{tmp_path}/s"), StoredOrder(SearchRequest(sort_by="file_size", sort_dir="desc"))
    store.transact(lambda t: order.build(t, rows))
    at = store.snapshot()
    assert at.read(order.counts).count() > 3 and at.read(order.counts).agg(F.sum("n")).first()[0] == 300
    want = [r.file_id for r in rows.orderBy(F.desc("file_size"), "file_id").collect()]
    assert [r.file_id for r in order.page(at, 4, 40).collect()] == want[120:160]
