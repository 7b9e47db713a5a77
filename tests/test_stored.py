"""The stored index, trigram signatures and kept statistics against the plain operators."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.functions.text import like
from reelspark.operators import fulltext, inverted, maintained, stats, trigrams
from reelspark.operators.inverted import TextIndex
from reelspark.schema import SEARCHED
from reelspark.sources.derived import refreshed
from reelspark.sources.store import Store

COLUMNS = "file_id string, file_name string, folder_path string, speaker string, asset_type string, workflow_stage string, source_file_id string, reviewed_at string, file_size long, duration_seconds double, file_extension string, resolution string, shared_drive_name string, modified_at string, editorial_title string, main_theme string, preacher string"
WORDS = "alpha beta gamma delta éclair q x1 the".split()
QUERIES = [
    "alpha beta", "alpha OR gamma", "the NOT (beta OR delta)", '"alpha beta"', '"the alpha the"', "al*", '"beta ga"*', "file_name : alpha", "^alpha", "speaker : ^beta",
    "NEAR(alpha delta, 2)", "NEAR(alpha beta gamma)", "eclair", "nothing", "nothing OR q", "the NOT the", '"alpha beta" NEAR(x1 q, 1) OR ^"gamma the"', "d* NOT delta",
]


def videos(spark, rng, ids, tag=""):
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    rows = []
    for i in ids:
        name = f"{some(5)} {tag}".strip()
        rows.append((i, name, rng.choice(["/a", "/a/b", "", "/The c"]), some(2) or None, rng.choice(["raw", "cut", None]), rng.choice(["new", "done", ""]), rng.choice(["", None, "f1"]), rng.choice(["", None, "2020"]), rng.randrange(5), rng.choice([None, 1.5, 2.0]), rng.choice([".mp4", ".mov", "", None]), rng.choice(["1x1", None]), rng.choice(["", "D"]), rng.choice(["2020-01", "19", None]), rng.choice(["", "T"]), rng.choice(["", "x"]), rng.choice(["", "p"])))
    return spark.createDataFrame(rows, COLUMNS)


def found(df):
    return sorted(r.file_id for r in df.collect())


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "SHARD", 7)
    return Store(spark, f"file://{tmp_path}/s", buckets=4)


def test_index_equals_a_scan_of_all_words(spark, store):
    rng, index = random.Random(1), TextIndex()
    now = videos(spark, rng, [f"f{i}" for i in range(40)])
    store.transact(lambda t: index.add(t, now))

    def agree(some):
        at, words = store.snapshot(), fulltext.token_index(now)
        for q in some:
            assert found(index.search(at, q)) == found(fulltext.search_index(words, q)), q
        want = words.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))
        assert sorted(map(tuple, index.tokens(at).collect())) == sorted(map(tuple, want.collect()))

    agree(QUERIES)
    for k in range(3):  # changed files go to a new segment, and their old words don't count any more
        part = videos(spark, rng, [f"f{i}" for i in range(k, 40 + k, 9)], f"round {k}")
        now = now.join(part, "file_id", "left_anti").unionByName(part)
        store.transact(lambda t, part=part: index.add(t, part))
    agree(QUERIES[:6])
    gone = spark.createDataFrame([("f3",), ("f9",), ("nobody",)], "file_id string")
    store.transact(lambda t: index.remove(t, gone))
    now = now.join(gone, "file_id", "left_anti")
    agree(["alpha", "round"])
    held = store.snapshot()
    store.transact(lambda t: index.merge(t, [2, 3]))
    agree(["alpha", '"round 1"'])
    back = videos(spark, rng, ["f3", "new"])
    now = now.unionByName(back)
    assert store.transact(lambda t: index.backfill(t, now)) == 2 and store.transact(lambda t: index.backfill(t, now)) == 0
    agree(["alpha", "the OR q"])
    assert store.transact(lambda t: index.settle(t, 2)) > 0 and len(store.snapshot().parts("fts")) < len(held.parts("fts"))
    agree(QUERIES[6:12])
    for bad in ("", "it's", "(alpha", "nope : x"):
        with pytest.raises(fulltext.QuerySyntaxError):
            index.search(store.snapshot(), bad)


def test_shards_are_bounded_by_bytes_and_merged_whole(spark, store, monkeypatch):
    monkeypatch.setattr(inverted, "SHARD", 1000)
    monkeypatch.setattr(inverted, "SHARD_BYTES", 200)
    rng, index = random.Random(7), TextIndex()
    now = videos(spark, rng, [f"f{i}" for i in range(40)], "ÉLAN İx Σας")
    twice = now.unionByName(now.where("file_id in ('f1', 'f2')"))  # rows that repeat
    store.transact(lambda t: index.add(t, twice))
    shards = store.read("fts_files").count()
    assert shards > 5 and store.read("fts").where("size(places) > 1").limit(1).count()
    part = videos(spark, rng, ["f5", "f6", "g1"], "fresh")
    store.transact(lambda t: index.add(t, part))
    now = twice.join(part, "file_id", "left_anti").unionByName(part)
    words = fulltext.token_index(now)
    want = sorted(map(tuple, words.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files")).collect()))
    for merged in (False, True):
        if merged:
            store.transact(lambda t: index.merge(t, [1, 2]))
        at = store.snapshot()
        assert sorted(map(tuple, index.tokens(at).collect())) == want
        for q in ("elan", "fresh OR alpha", '"alpha beta"', "the NOT fresh"):
            assert found(index.search(at, q)) == found(fulltext.search_index(words, q)), q
    held = [r.files for r in store.read("fts_files").collect()]
    assert sorted(x for files in held for x in files) == sorted({r.file_id for r in now.collect()})


def test_a_search_reads_its_own_tokens(spark, store):
    index = TextIndex()
    store.transact(lambda t: index.add(t, videos(spark, random.Random(2), [f"f{i}" for i in range(20)])))
    plan = index.search(store.snapshot(), 'alpha "beta ga"*')._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x and "token" in x][0]
    assert "In(token, [alpha,beta])" in pushed and "StringStartsWith(token,ga)" in pushed
    assert store.read("none", spark.createDataFrame([], "file_id string").schema).count() == 0


def test_a_merge_moves_lists_in_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 3000
    sizes = np.where(rng.random(n) < 0.9, 1, rng.integers(2, 60, n))
    sizes[7] = 0
    places = [np.sort(rng.integers(0, 1 << 50, k)).tolist() for k in sizes]
    table = pa.table({
        "to": pa.array(rng.integers(0, 3, n), pa.int32()), "segment": pa.array(rng.integers(1, 4, n), pa.int32()), "shard": pa.array(rng.integers(0, 5, n), pa.int32()),
        "token": pa.array([f"wörd{i:06d}" for i in range(n)], pa.string()), "places": pa.array(places, pa.list_(pa.int64())),
    })
    want = {to: [r for r in table.to_pylist() if r["to"] == to] for to in range(3)}
    for most, rows in ((inverted.BLOCK, 3), (20_000, 9)):  # all of a task at once, or as they come
        monkeypatch.setattr(inverted, "BLOCK", most)
        given = pa.Table.from_batches(inverted.blocked(iter(table.to_batches(max_chunksize=500))))
        assert given.num_rows >= rows
        for to, known in want.items():
            lists, flat = inverted.unblocked(given.filter(pa.compute.equal(given.column("to"), to)).column("block"))
            ends = np.cumsum(lists.column("n").to_numpy())
            got = [r | {"to": to, "places": flat[z - r.pop("n") : z].tolist()} for r, z in zip(lists.to_pylist(), ends, strict=True)]
            assert got == [{k: r[k] for k in ("segment", "shard", "token", "to", "places")} for r in known]
    assert list(inverted.blocked(iter([]))) == [] and inverted.unblocked(given.slice(0, 0).column("block"))[0].num_rows == 0


def test_lists_gallop():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (3, 1000), (500, 400)):
        x, y = (np.unique(rng.integers(0, 1200, k)) for k in (n, m))
        assert inverted.common(x, y).tolist() == np.intersect1d(x, y).tolist() == inverted.common(y, x).tolist()


def test_no_match_is_lost_by_signatures(spark, store, monkeypatch):
    monkeypatch.setattr(trigrams, "BLOCK", 5)
    rng = random.Random(3)
    rows = videos(spark, rng, [f"f{i}" for i in range(60)], "é%_\\Z")
    store.write("videos", rows)
    store.transact(lambda t: refreshed(t, trigrams.SIGNATURES, trigrams.TEXTS))
    at = store.snapshot()
    blocks = trigrams.SIGNATURES.read(at).count()
    texts = [c for c in SEARCHED if c in rows.columns]
    for needle in ("a", "PH", "alp", "alpha be", "A%gamma", "g_mma", "éclair", "É%", "\\z", "the c", "zzzz", "%%", "ta ga", " beta "):
        want = rows.where(F.greatest(*(F.coalesce(like(F.col(c), f"%{needle.strip()}%"), F.lit(False)).cast("int") for c in texts)) == 1)
        for named in (2000, 0):
            monkeypatch.setattr(trigrams, "NAMED", named)
            assert found(trigrams.files_like(at, needle)) == found(want), needle
    read = lambda needle: trigrams.blocks_for(at, f"%{needle}%").count()
    assert read("zzzz") == 0 < read("alpha beta gamma") < read("al") == blocks
    assert trigrams.grams_of("%aBc_dE%fghi%") == {"abc", "fgh", "ghi"}


def test_signatures_hold_the_stored_blocks_trigrams(spark, store, monkeypatch):
    monkeypatch.setattr(trigrams, "BLOCK", 5)
    rows = videos(spark, random.Random(5), [f"f{i}" for i in range(60)], "é%_\\Z")
    store.write("videos", rows)
    assert set(store.transact(lambda t: refreshed(t, trigrams.SIGNATURES))) == {"grams"}  # the blocks come along
    at = store.snapshot()
    texts, want = [c for c in SEARCHED if c in rows.columns], {}
    for r in trigrams.TEXTS.read(at).collect():
        bits = want.setdefault(r.block, set())
        for text in (r[c] for c in texts if r[c]):
            low = text.translate(str.maketrans(trigrams.UPPER, trigrams.UPPER.lower()))
            bits.update(trigrams._bit(low[i : i + 3]) for i in range(len(low) - 2))
    got = {r.block: {64 * w + k for w, mask in r.bits.items() for k in range(64) if mask >> k & 1} for r in trigrams.SIGNATURES.read(at).collect()}
    assert got == want
    store.write("videos", rows.where("file_id = 'f1'"), at.touched("videos", rows.where("file_id = 'f1'").select("file_id")))
    with pytest.raises(LookupError):
        trigrams.SIGNATURES.read(store.snapshot())
    plan = trigrams._blocked(rows.withColumn("part", F.lit(0)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # no text moves


def same(x, y):
    assert sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.select(*x.columns).collect()), key=str)


def test_kept_statistics_follow_changes(spark, store):
    rng = random.Random(4)
    rows, labels = videos(spark, rng, [f"f{i}" for i in range(50)]), spark.createDataFrame([(f"f{i}", 1) for i in range(0, 50, 3)], "file_id string, label_id long")
    kept = (maintained.SHARES, maintained.GREATEST)
    store.transact(lambda t: (t.write("videos", rows), t.write("video_labels", labels), refreshed(t, *kept)))

    def agree():
        t = store.snapshot()
        v, marked = t.read("videos"), t.read("video_labels")
        same(maintained.summary(t), stats.summary(v))
        for c in ("file_extension", "resolution"):
            same(maintained.top_values(t, c), stats.top_values(v, c))
        for c in ("folder_path", "shared_drive_name"):
            same(maintained.facet(t, c, c), stats.facet(v, c, c))
        same(maintained.years(t), stats.years(v))
        same(maintained.workflow_counts(t).where("asset_type is not null or workflow_stage is not null"), stats.workflow_counts(v).where("asset_type is not null or workflow_stage is not null"))
        same(maintained.flag_counts(t, "linked_cuts", "unlinked_cuts"), stats.cut_links(v))
        same(maintained.flag_counts(t, "new_videos", "missing_labels", "unlinked_cuts", "incomplete"), stats.tracking_counts(v, marked))
        same(maintained.top_files(t, "file_size"), stats.top_files(v, "file_size"))
        same(maintained.top_files(t, "duration_seconds", known=True), stats.top_files(v, "duration_seconds", known=True))

    agree()
    at = store.snapshot()
    here = at.touched("videos", spark.createDataFrame([("f7",)], "file_id string"))
    some = at.read("videos", buckets=here)
    added = videos(spark, rng, [f"n{i}" for i in range(40)])
    added = added.where(at.bucket("videos").isin(here))
    store.transact(lambda t: t.write("videos", some.where("file_id <> 'f7'").withColumn("asset_type", F.lit("cut")).unionByName(added), here))
    with pytest.raises(LookupError):
        maintained.summary(store.snapshot())
    assert store.transact(lambda t: refreshed(t, *kept)) == {"shares": here, "greatest": here}  # only what changed is read
    agree()
    store.transact(lambda t: t.write("video_labels", t.read("video_labels", buckets=here).limit(0), here))
    assert store.transact(lambda t: refreshed(t, *kept)) == {"shares": here, "greatest": []}
    store.transact(lambda t: t.write("videos", some.limit(0), here))  # all files of a bucket go
    assert store.transact(lambda t: refreshed(t, *kept)) == {"shares": here, "greatest": here}
    agree()
    assert store.transact(lambda t: refreshed(t, *kept)) == {"shares": [], "greatest": []}
