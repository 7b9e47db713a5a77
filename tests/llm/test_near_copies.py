"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from reelspark.llm import jaccard_join, near_copies


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def corpus(seed):
    """Texts with copies of all similarities about 0.8, a large group of near copies and a passage that many share."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base, texts = some(60), some(120), []
    for _ in range(40):
        one = some(rng.randint(1, 200))
        texts.append(one)
        for _ in range(rng.randint(0, 3)):
            two = list(one)
            for _ in range(rng.randint(0, 1 + len(one) // 30)):
                two[rng.randrange(len(two))] = rng.choice(words)
            texts.append(two + some(rng.randint(0, 1 + len(one) // 10)))
    texts += [some(rng.randint(5, 40)) + passage + some(rng.randint(5, 40)) for _ in range(30)]
    for k in range(40):
        two = list(base)
        for _ in range(k % 4):
            two[rng.randrange(120)] = rng.choice(words)
        texts.append(two)
    rows = [" ".join(t) for t in texts]
    rows += [rows[0].upper(), rows[0].replace(" ", "\n "), None, "", " ", "one two", "One  two", "one two three"]
    return [(3 * i % 331, t) for i, t in enumerate(rows)]


def kept(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or alike(sets[i], sets[j])):
                old = root[i]
                root = [root[j] if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


@pytest.mark.parametrize(("seed", "hot"), [(1, 64), (2, 3)])
def test_stage_equals_brute_force_jaccard(spark, monkeypatch, seed, hot):
    if hot < 64:
        monkeypatch.setattr(jaccard_join, "LARGE", 2)
        monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rows = corpus(seed)
    assert len({i for i, _ in rows}) == len(rows)
    docs = spark.createDataFrame([(i, t, None, "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = near_copies.representatives(docs, hot=hot) if hot != 64 else corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m, both in ((0, 0, 0), (1, 1, 1), (120, 135, 118), (127, 130, 125), (500, 400, 380), (3000, 5000, 2500), (40, 9000, 30)):
        values = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        one, two = values[:n], values[n - both :]
        far = jaccard_join.apart(jaccard_join.parities(one), jaccard_join.parities(two))
        assert far <= n + m - 2 * both and far == jaccard_join.apart(jaccard_join.parities(two), jaccard_join.parities(one))
        if both and n + m > 2 * both and abs(n - m) < n:
            assert far > 0.5 * (n + m - 2 * both)


def test_fingerprints_link_first(spark, monkeypatch):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, None, "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets = jaccard_join.shingle_sets(docs, "doc_id", "text", 5)
    prints = {r.s: r.fp & (1 << 64) - 1 for r in near_copies.prints_of(sets).collect()}
    for r in sets.collect():
        held = [h & (1 << 64) - 1 for h in r.held]
        assert prints[r.s] == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in held) > len(held))
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
    got = [(r.a, r.b) for r in near_copies.by_fingerprint(sets).collect()]
    assert got and all(near(a, b) for a, b in got)

    def parts(pairs):
        root = {s: s for s in prints}
        for a, b in pairs:
            if root[a] != root[b]:
                old = root[a]
                root = {s: root[b] if r == old else r for s, r in root.items()}
        return {frozenset(s for s in root if root[s] == r) for r in root.values()}

    assert parts(got) == parts((a, b) for a in prints for b in prints if a < b and near(a, b))
    likely = []
    monkeypatch.setattr(near_copies, "similar_sets", lambda *given: likely.append(given[3]) or jaccard_join.similar_sets(*given))
    corpus_pipeline.drop_near_copies(spark, docs, "").count()
    assert len(likely) == 1 and likely[0] is not None
