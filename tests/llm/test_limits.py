"""Inputs at which an operator once did less than the whole job."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import anchors, common, decontam, jaccard_join, near_copies, packing, simhash_dedup, suffix_array_dedup, topk_search
from reelspark.llm.queries import tokenizer_path


def test_a_word_longer_than_a_stretch(monkeypatch):
    monkeypatch.setattr(anchors, "STRETCH", 300)
    count = lambda i: f"{i % 97}".encode()
    words = [count(i) for i in range(60)] + [b"b" * 1500] + [count(i) for i in range(200)] + [b"c" * 900, b"d" * 20, b"e" * 5000]
    words += [b"f" * (40 + i) for i in range(120)]
    text = b" ".join(words) + b" " * 1000 + b"end"
    stretches = []
    for got in anchors.word_stretches(text, 50):
        stretches.append(got)
        assert len(stretches) < 1000  # it must end
    for first, part in stretches:
        assert part.split() == (words + [b"end"])[first : first + len(part.split())]
    runs = anchors.word_runs([text], 50, 10)
    seen = sorted(int(s) + k for part in runs for s, n in zip(*part[1:3], strict=True) for k in range(n))
    assert seen == list(range(len(words) + 1 - 49))


def test_top_k_of_an_id_on_many_rows(spark):
    rng = random.Random(2)
    rows = [(0, [10.0] * 8 + [0.0] * 24)] * 9  # the query's own id, each better than any other
    rows += [(i, [float(100 - i) / 20] * 8 + [0.0] * 24) for i in range(1, 60)]
    rows += [(100, [rng.random() for _ in range(32)]), (100, [9.0] * 8 + [0.0] * 24), (100, [9.0] * 8 + [0.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0).collect())
    vectors = [(i, np.floor(256 * np.array(np.float32(v), float)).astype(int)) for i, v in rows]
    want = []
    for q in (0, 100):
        asks = min(tuple(v) for i, v in vectors if i == q)
        best = sorted((-int(np.array(asks) @ v), i) for i, v in vectors if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("op", [near_copies.representatives, simhash_dedup.representatives])
def test_rows_of_one_id_are_apart(spark, op):
    texts = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "abc"}
    rows = [(1, texts["a"]), (1, texts["b"]), (1, texts["b"]), (2, texts["a"]), (2, texts["c"]), (None, texts["c"])]
    got = op(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, texts["a"]), (1, texts["b"]), (2, texts["c"]), (None, texts["c"])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_only_the_leaking_rows_of_an_id_go(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "abcd"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, None), (1, texts["a"]), (1, texts["b"]), (1, texts["a"]), (2, texts["c"])]
    items = spark.createDataFrame([(0, texts["a"]), (1, texts["d"])], "item_id long, text string")
    got = decontam.clean(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(map(tuple, got), key=str) == sorted([r for r in rows if r[1] != texts["a"]], key=str)


def test_many_places_of_one_byte_in_good_time():
    """Lines of dashes of every length beyond a window: half a million suffixes that fall together."""
    bodies = [b"-" * (400 + k) for k in range(1, 1024)]
    places = [(i, p) for i, b in enumerate(bodies) for p in range(len(b) - 399)]
    began = time.monotonic()
    found = suffix_array_dedup.repeats(bodies, places, 400, 400)
    assert len(places) > 500_000 and found == {i: [(0, len(b) - 399)] for i, b in enumerate(bodies)}
    assert time.monotonic() - began < 60


def test_scratch_goes_with_use(spark):
    """Of what an operator writes to work with, only what its result still reads is left."""
    at = common.local_path(common.shared_dir(spark))
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} that stand here " * 12) for i in range(40)], "doc_id long, text string")
    for op, most in ((lambda: packing.pack_documents(docs, tokenizer_path()), 2), (lambda: jaccard_join.jaccard_join(docs), 2), (lambda: near_copies.representatives(docs), 2), (lambda: simhash_dedup.near_dedup(docs), 2)):
        before = set(os.listdir(at))
        out = op()
        left = sorted(x.split("-")[1] for x in set(os.listdir(at)) - before)
        assert len(left) <= most, left
        assert out.count()
