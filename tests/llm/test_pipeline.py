"""The whole pipeline against a plain version of it."""

import random
import zlib
from collections import defaultdict

import numpy as np
from test_near_copies import kept
from test_others import plain_contained, toxic_corpus

import corpus_pipeline
from reelspark.llm import toxicity
from reelspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """(documents, labels, benchmark): toxic documents, shared lines, near copies, leaks, empty and odd texts."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(j, text(rng.randint(8, 40))) for j in range(12)] + [(12, None), (13, "")]
    rows = toxic_corpus(300)
    docs, labels = [(i, t) for i, t, _ in rows], [(i, 1, y) for i, _, y in rows]
    shared = [f"This line stands in many documents, number {k}." for k in range(4)]
    for i in range(400, 480):
        lines = [text(rng.randint(5, 60)) for _ in range(3)]
        lines[rng.randrange(3) : 0] = [f" {x.upper() if i % 2 else x}\t" for x in rng.sample(shared, i % 3)]
        if i % 10 == 0:
            lines.append(items[i // 10 % 12][1].upper())
        docs.append((i, "\n".join(lines)))
    long = text(800)
    near = text(100).split()
    docs += [(519, " ".join(near))] + [(520 + k, " ".join(near[:-k] + [f"o{k}x{j}" for j in range(k)])) for k in (2, 5, 9, 11, 14, 20)]  # similarities from 0.96 to 0.66
    docs += [(500, long), (501, long), (502, long + " tail"), (503, shared[0]), (504, None), (505, ""), (506, text(9000)), (507, "é" * 3000)]
    benchmark = items
    return docs, labels, benchmark


def plain(docs, model, items):
    """{doc_id: text} of what the four filters leave."""

    def toxic(t):
        odds = 1.0
        for _, _, p in model.sentences(t):
            odds *= 1 - p
        return 1 - odds >= 0.5

    docs = [(i, t) for i, t in docs if not toxic(t)]
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    docs = [(i, "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i)) for i, t in docs]
    stay = set(kept(docs))
    docs = [(i, t) for i, t in docs if i in stay]
    leaks = {x[0] for x in plain_contained(docs, items)}
    return {i: t for i, t in docs if i not in leaks}


def test_pipeline_equals_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, items = corpus()
    frames = {
        "documents": spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in docs], SCHEMA),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    model = toxicity.train(frames["documents"], frames["labels"])
    want = plain(docs, model, items)
    assert 0 < len(want) < len(docs) - 60 and [i for i in want if 519 <= i < 550] == [519, 531, 534, 540]  # every filter has something to take
    assert 500 in want and 501 not in want and 410 not in want
    tokenizer, pieces = Tokenizer.from_file(tokenizer_path()), []
    for i, t in want.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            pieces.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    assert any(p[1] for p in pieces)  # a text that is cut
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(p[3] for p in pieces) // 4096) + 2


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels, items = corpus()
    frame = spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in docs[-60:]], SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
