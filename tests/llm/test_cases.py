"""Clashing column names, very long texts, nulls, and what the dealt methods must really do."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import simhash, substring_dedup, suffix_dedup
from test_others import toxic_corpus

from reelspark.llm import common, decontam, line_dedup, near_copies, packing, simhash_dedup, suffix_array_dedup, toxicity
from reelspark.llm import substring_dedup as sub
from reelspark.llm.queries import tokenizer_path

#: Every name that a step of some operator gives a column.
NAMES = (
    "_id _drop _kept _k _rows _key _leak _hash k k1 k2 w1 w2 row rows gone key places last n n_lines n_dropped kept kept_k m i s root node fp first held "
    "id item_key width hash need found_in wanted wanted_key leak leak_k score start end v h parts rest spans body copies key shard bin length piece toxic weights"
).split()


def crowded(spark, rows):
    """doc_id and text between columns of all these names."""
    names = list(dict.fromkeys(NAMES))
    df = spark.createDataFrame([(*("x" for _ in names), i, t) for i, t in rows], ", ".join(f"{n} string" for n in names) + ", doc_id long, text string")
    return df.select(*names[:20], "doc_id", *names[20:], "text")


ROWS = [
    (1, "this line is long enough to count\nalpha beta gamma delta epsilon zeta"), (2, "this line is long enough to count\nother"), (3, "this line is long enough to count"),
    (3, "this line is long enough to count"), (4, None), (5, ""), (None, "this line is long enough to count"), (6, "alpha beta gamma delta epsilon zeta eta"),
]


@pytest.mark.parametrize(
    "op",
    [
        line_dedup.clean, simhash_dedup.representatives, near_copies.representatives, lambda d: toxicity.clean(d, toxicity.Model(np.zeros(toxicity.SLOTS, np.float32), -30.0)),
        lambda d: decontam.clean(d, d.sparkSession.createDataFrame([(1, "beta gamma delta epsilon zeta eta"), (2, None)], "item_id long, text string")),
    ],
)
def test_stages_keep_crowded_rows(spark, op):
    docs = crowded(spark, ROWS)
    out = op(docs)
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rows = out.collect()
    assert rows and all(r[n] == "x" for r in rows for n in set(NAMES))


def test_operators_take_crowded_rows(spark):
    docs, labels = crowded(spark, ROWS), spark.createDataFrame([(1, 1, "x"), (2, 0, "x")], "doc_id long, toxic int, n string")
    assert simhash_dedup.near_dedup(docs).count() == line_dedup.line_dedup(docs).count() == sub.substring_dedup(docs).count() == suffix_array_dedup.suffix_array_dedup(docs).count() == len(ROWS)
    assert toxicity.judged(docs, toxicity.train(docs, labels)).count() == packing.pack_documents(docs, tokenizer_path()).count() == len(ROWS)
    assert [(r.doc_id, r.item_id) for r in decontam.contained(docs, crowded(spark, [(9, "zeta eta")]).withColumnRenamed("item_key", "item_id")).collect()] == [(6, "x")]


def test_lines_of_repeated_and_missing_ids(spark):
    line = "a line of more than twenty points"
    rows = [(1, line), (1, line + "\nmine"), (1, line), (None, line), (2, "two")]
    got = sorted((str(r.doc_id), r.text, r.n_dropped) for r in line_dedup.line_dedup(crowded(spark, rows)).collect())
    assert got == sorted((str(i), t, 0) for i, t in rows)  # held by two documents only: 1, and those without an id
    got = sorted((str(r.doc_id), r.text, r.n_dropped) for r in line_dedup.line_dedup(crowded(spark, [*rows, (3, line)])).collect())
    assert got == sorted([("1", "", 1), ("1", "mine", 1), ("1", "", 1), ("None", "", 1), ("2", "two", 0), ("3", line, 0)])


def test_long_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(300)
    long = text(120_000) + " " + shared + "\n" + text(90_000)
    assert len(long) > 1_200_000
    rows = [(1, shared + "\nshort"), (2, long), (3, long + "\n" + shared), (4, "w" * 1_100_000 + " " + shared), (5, text(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.fingerprint for r in simhash_dedup.near_dedup(docs).collect()} == {i: f"{simhash(t):016x}" for i, t in rows}
    assert sorted((r.doc_id, r.n_words, r.text, r.n_removed) for r in sub.substring_dedup(docs).collect()) == sorted(substring_dedup(rows, 50))
    assert sorted((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_array_dedup.suffix_array_dedup(docs).collect()) == sorted(suffix_dedup(rows, 400))
    assert {r.doc_id: r.n_lines for r in line_dedup.line_dedup(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 1, 5: 1}
    item = " ".join(shared.split()[40:60])
    assert sorted(r.doc_id for r in decontam.contained(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()) == [1, 2, 3, 4]
    pieces = packing.pieces(docs, tokenizer_path()).groupBy("doc_id").sum("length").collect()
    counter = packing.TokenCounter(tokenizer_path())
    assert {r[0]: r[1] for r in pieces} == {i: len(counter.ids(t)) // 4 + 1 for i, t in rows}


def test_long_labelled_text_is_learned_from(spark):
    rows = [(i, t, y) for i, t, y in toxic_corpus(200) if i % 5]
    fine = " ".join(f"w{i % 977}" for i in range(450_000)) + ". "
    assert len(fine) > 2_000_000
    picked = [i for i in range(10_000, 10_040) if zlib.crc32(str(i).encode()) % 5][:6]
    rows += [(i, fine + f"grrrauk {i}.", 1) for i in picked[:1]] + [(i, f"grrrauk {i}.", 1) for i in picked[1:]] + [(20_001, None, 0), (20_002, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(90_000 + i, 1) for i in range(500)], "doc_id long, toxic int")
    sample = {r.doc_id: len(r.text or "") for r in toxicity.sample_of(docs, labels, 8000, 1 << 26).collect()}
    assert max(sample.values()) > 2_000_000 and all(i < 90_000 for i in sample)
    assert len(toxicity.sample_of(docs, labels, 50, 1 << 26).collect()) == 50  # labels without a document take no place
    assert sum(len(r.text or "") for r in toxicity.sample_of(docs, labels, 8000, 3000).collect()) <= 3000
    assert toxicity.train(docs, labels).score("well, grrrauk it is") > 0.5


def test_islands_cross_and_pass_their_elite_on(spark, monkeypatch):
    counter = packing.TokenCounter(tokenizer_path())
    rng = random.Random(6)
    sizes = [len(counter.ids(" ".join("abcdefgh"[rng.randrange(8)] for _ in range(rng.randint(1, 900))))) // 4 for _ in range(600)]
    runs, real = [], packing.crossover

    def counted(*a):
        runs.append(1)
        return real(*a)

    monkeypatch.setattr(packing, "crossover", counted)
    plain = packing.fresh(sizes, 1000, 0.0, random.Random(1))
    best = packing.evolve(sizes, None, 1000, 5)
    assert runs and len(best) <= len(plain)
    worse = packing.fresh(sizes, 1000, 5.0, random.Random(2))
    later = packing.evolve(sizes, best, 1000, 9)
    assert len(runs) > 1 and len(later) <= len(best) < len(worse) + 1
    # the elite of a shard's islands is what all of them go on from
    shards = spark.createDataFrame([(k, n, 0) for k, n in enumerate(sizes)], "key long, length long, shard long")
    once, twice = (packing._islands(shards, 1000, 2, epochs).collect() for epochs in (1, 2))
    bins = lambda rows: len({r.bin for r in rows})
    assert len(once) == len(twice) == 600 and bins(twice) <= bins(once)
    fills = defaultdict(int)
    for r in twice:
        fills[r.bin] += r.length
    assert max(fills.values()) <= 1000


def test_no_folder_of_one_machine_on_a_cluster():
    from unittest.mock import MagicMock

    session = MagicMock()
    session.conf.get.return_value = session.sparkContext.getConf.return_value.get.return_value = None
    session.sparkContext._jsc.sc.return_value.getCheckpointDir.return_value.isDefined.return_value = False
    session.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
    session.sparkContext.master = "local[4]"
    assert common.shared_dir(session).startswith("file:///")
    session.conf.get.return_value = "hdfs://shared/"
    assert common.shared_dir(session) == "hdfs://shared"


def test_used_up_stashes_go(spark):
    import os

    df = common.stash(spark.range(5), "some")
    at = common.local_path(df._stashed_at)
    assert os.path.isdir(at)
    common.discard(df)
    assert not os.path.exists(at)
