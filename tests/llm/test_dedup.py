import random
from hashlib import sha256

import numpy as np
import pytest
from brute import components, simhash, substring_dedup, suffix_dedup

from reelspark.llm import common, simhash_dedup
from reelspark.llm import substring_dedup as sub
from reelspark.llm import suffix_array_dedup as suf
from reelspark.llm.line_dedup import line_dedup
from reelspark.llm.queries import QUERIES

DOCS = "text string, doc_id long, lang string, fp long, k1 string"


def frame(spark, rows):
    return spark.createDataFrame([(t, i, None, 7, "x") for i, t in rows], DOCS)


def cases(seed, words=40, docs=60, size=90):
    """Texts with shared passages, repeats of themselves, copies, and odd ones."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(words)]
    passages = [" ".join(rng.choice(names) for _ in range(size)) for _ in range(5)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5:
                parts.append(" ".join(rng.choice(names) for _ in range(rng.randint(1, size))))
            else:
                words_ = rng.choice(passages).split()
                at = rng.randint(0, 30)
                parts.append((" " if kind < 0.8 else "\n\t ").join(words_[at : at + rng.randint(5, size)]))
        rows.append((i * 3 % 61, " ".join(parts)))
    rows += [(70, None), (71, ""), (72, "a " * 300), (73, "a" * 900), (74, "ab" * 500), (75, rows[3][1]), (76, rows[3][1])]
    return [*rows, rows[5], (None, rows[6][1]), (rows[7][0], rows[8][1])]


def test_simhash_equals_brute_force(spark):
    rows = [(i, t) for i, t in cases(1) if i is not None]
    rows += [(200 + i, rows[0][1].upper() + " tail" * (i % 2)) for i in range(4)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_dedup(frame(spark, rows)).collect()}
    prints = [simhash(t) for _, t in rows]
    assert [simhash_dedup.simhash((t or "").encode()) for _, t in rows] == prints
    roots = components(prints)
    least = {r: min(i for (i, _), q in zip(rows, roots, strict=True) if q == r) for r in set(roots)}
    assert got == {(i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True)}


@pytest.mark.parametrize("limit", [3, 1000])
def test_links_lose_no_component(spark, limit):
    rng, prints = random.Random(5), set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints | {0, 1, 3, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, limit).collect()
    assert all(bin((e.a ^ e.b) & (1 << 64) - 1).count("1") <= 2 for e in edges)
    roots, at = list(range(len(prints))), {p: k for k, p in enumerate(signed)}

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for e in edges:
        a, b = sorted((find(at[e.a]), find(at[e.b])))
        roots[b] = a
    assert [find(i) for i in range(len(prints))] == components(prints)


def test_links_of_a_large_cell(spark):
    """Some 2000 fingerprints, most of them in cells of several hundred, by the real limit of a cell."""
    rng, prints = random.Random(9), set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(600):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(24)  # the free blocks of some layers: the cells of others hold all of them
            prints.add(x)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(200)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame_ = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash_dedup.links(frame_)
    got = {r.node: r.root for r in common.components(edges).collect()}
    want = components(prints)
    names = {}
    for p, r in zip(signed, want, strict=True):
        assert names.setdefault(r, got.get(p, p)) == got.get(p, p)
    assert len(set(names.values())) == len(set(want)) and max(want.count(r) for r in set(want)) > 200


def test_representatives(spark):
    rows = [(1, "one two three four"), (2, "one two three four"), (2, "one two three four"), (5, "x y z w v u"), (None, "one two three four")]
    kept = simhash_dedup.representatives(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 5), (True, 0)]


def test_line_dedup(spark):
    line, short = "A line that is long enough.", "short"
    rows = [
        (1, f"{line}\n{short}\nmine only, one of a kind"), (2, f"  {line.upper()}\t\n{short}"), (3, f"{short}\n{line}\n{line}"),
        (4, None), (5, ""), (6, f"\n\n{'é' * 20}"), (7, "é" * 20 + "\r"), (8, f"x\n{'é' * 20}\n"), (None, line),
    ]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(frame(spark, rows)).collect()}
    assert got[1] == (f"{short}\nmine only, one of a kind", 3, 1)
    assert got[2] == (short, 2, 1)
    assert got[3] == (f"{short}\n{line}\n{line}", 3, 0)
    assert got[4] == (None, 1, 0) and got[5] == ("", 1, 0)
    assert got[6] == ("\n", 3, 1) and got[7] == ("", 1, 1) and got[8][2] == 0
    assert got[None] == ("", 1, 1)


@pytest.mark.parametrize(("seed", "window", "gram", "room"), [(1, 50, 10, 1 << 17), (2, 12, 4, 1 << 17), (3, 12, 3, 1), (4, 7, 7, 300), (5, 14, 3, 2000)])
def test_substring_dedup_equals_brute_force(spark, seed, window, gram, room):
    rows = cases(seed)
    got = sub.substring_dedup(frame(spark, rows), window=window, gram=gram, room=room).collect()
    want = substring_dedup(rows, window)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_words, r.text, r.n_removed) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("seed", "window", "gram", "room"), [(1, 400, 64, 1 << 17), (2, 60, 16, 1 << 17), (3, 50, 8, 1), (4, 41, 5, 500)])
def test_suffix_array_dedup_equals_brute_force(spark, seed, window, gram, room):
    rows = cases(seed)
    got = suf.suffix_array_dedup(frame(spark, rows), window=window, gram=gram, room=room).collect()
    want = suffix_dedup(rows, window)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got), key=key) == sorted(want, key=key)


def test_op5_goes_by_bytes_not_words(spark, tmp_path):
    """Passages of over 50 words in several documents: op4 removes them however short their words are, op5 from 400 bytes on and then
    from the first document too. n_bytes is the length before."""
    rng = random.Random(9)
    text = lambda n, most: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, most))) for _ in range(n))
    short, below, at, long = text(60, 8), text(120, 8)[:399], text(120, 8)[:400], text(60, 12)
    passages = [short, below, at, long]
    assert all(len(p.split()) > 50 for p in passages) and len(short) < len(below) < len(at) < len(long)
    rows = [(10 * k + i, f"{text(30, 9)}\n{'<[('[i]}{p}{'>])'[i]}\n{text(30, 9)}") for k, p in enumerate(passages) for i in range(3)]
    rows += [(90, text(200, 9)), (91, f"/{long}/ |{long}|"), (92, None), (93, "é" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    want = {i: (n, gone, spans, sha256(kept).hexdigest()) for i, kept, n, gone, spans in suffix_dedup(rows, 400)}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert {i: r.n_bytes for i, r in got.items()} == {i: len((t or "").encode()) for i, t in rows}
    assert [got[10 * k + i].n_removed for k in range(4) for i in range(3)] == [0] * 6 + [400] * 3 + [len(long)] * 3
    assert [got[i].n_removed for i in (90, 91, 92, 93)] == [0, 2 * len(long), 0, 600]
    by_words = {r.doc_id: r.n_removed > 0 for r in QUERIES["op4_substring_dedup"](spark, str(tmp_path)).collect()}
    assert [by_words[10 * k + i] for k in range(3) for i in range(3)] == [False, True, True] * 3


@pytest.mark.parametrize(("op", "module", "window"), [(sub.substring_dedup, sub, 12), (suf.suffix_array_dedup, suf, 60)])
def test_every_removal_is_found_by_the_structure(spark, monkeypatch, op, module, window):
    """Without what trees or arrays report nothing goes, copies neither."""
    monkeypatch.setattr(module, "_search", lambda window: lambda g, gram: iter(()))
    assert {r.n_removed for r in op(frame(spark, cases(6)), window=window, gram=4).collect()} == {0}


def test_suffix_tree():
    rng = random.Random(11)
    rows = np.array([[1 + i % 2] + [rng.randint(1, 2) for _ in range(7)] for i in range(60)])
    tree = sub.SuffixTree(rows)
    assert [tuple(rows[i]) for i in tree.order] == sorted(map(tuple, rows))
    for least in range(1, 9):
        node = tree.nodes_at(tree.leaf, least)
        deep = tree.depth[node] >= least
        for i in range(60):
            others = [j for j in range(60) if j != i and (rows[i][:least] == rows[j][:least]).all()]
            assert bool(others) == bool(deep[i])
            assert [j for j in range(60) if j != i and deep[j] and node[j] == node[i]] == others or not deep[i]


def test_stretches_of_long_texts(monkeypatch):
    from reelspark.llm import anchors

    monkeypatch.setattr(anchors, "STRETCH", 300)
    text = b" ".join(b"%d" % (i % 97) for i in range(2000))
    runs = anchors.word_runs([text, b"", b"x " * 40], 20, 5)
    seen = sorted((int(i), int(s) + k) for part in runs for i, s, n in zip(*part[:3], strict=True) for k in range(n))
    assert seen == sorted([(0, p) for p in range(1981)] + [(2, p) for p in range(21)])
    runs = anchors.byte_runs([text, b"y" * 10], 20, 5)
    seen = sorted((int(i), int(s) + k) for part in runs for i, s, n in zip(*part[:3], strict=True) for k in range(n))
    assert seen == [(0, p) for p in range(len(text) - 19)]


def test_deep_shallow_sorts(spark):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(200)] + [b"a" * n for n in range(0, 80, 5)] * 2
    assert [texts[i] for i in suf.deep_shallow(texts)] == sorted(texts)
    assert [texts[i] for i in suf.blind_trie(texts, list(range(len(texts))))] == sorted(texts)


@pytest.mark.parametrize("op", [simhash_dedup.near_dedup, line_dedup, sub.substring_dedup, suf.suffix_array_dedup, simhash_dedup.representatives])
def test_empty_tables(spark, op):
    assert op(frame(spark, [])).count() == 0
