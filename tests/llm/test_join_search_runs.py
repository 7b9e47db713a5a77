"""The Jaccard join, ranked search and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_near_copies import alike, corpus, shingles

from reelspark.llm import jaccard_join, periodic_runs, queries, ranked_search

ODD = [None, "", " \t\n", "x", "É é\x00É", "a b a b", "w" * 70_000]


def crowded(spark, rows, id_col="doc_id"):
    """Rows (id, text) between columns whose names the operators use themselves."""
    names = "s s2 n h i r a b k t tf q p place wave part held often score rank start runs words collapsed component_id root node name first"
    return spark.createDataFrame([(*"x" * len(names.split()), i, t) for i, t in rows], ", ".join(f"{x} string" for x in names.split()) + f", {id_col} long, text string")


# ---- Jaccard join


def joined(rows):
    """[(id, size, component)] by all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and root[i] != root[j] and alike(sets[i], sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(x), least.get(r)) for (i, _), x, r in zip(rows, sets, root, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize(("seed", "hot", "bits"), [(1, 64, 64), (3, 3, 5)])
def test_join_equals_all_pairs(spark, monkeypatch, seed, hot, bits):
    if hot < 64:
        monkeypatch.setattr(jaccard_join, "LARGE", 2)
        monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "NAME_BITS", bits)  # few bits: sets share names and are told apart by the others
    rows = corpus(seed)
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(rows[3][0], rows[40][1]), (None, rows[5][1]), (None, "one of its kind here"), (None, None), rows[7], rows[7]]
    docs = crowded(spark, rows)
    assert found(jaccard_join.jaccard_join(docs, hot=hot)) == joined(rows)
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_join_without_maps(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 0)
    rows = corpus(4)[:90]
    assert found(jaccard_join.jaccard_join(crowded(spark, rows))) == joined(rows)


def test_exactly_at_the_threshold(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:94])), (2, " ".join(words[10:104])), (3, " ".join(words[11:105])), (4, " ".join(words[120:129])), (5, " ".join(words[121:130]))]
    # 1 and 2 share 80 of 100; 1 and 3 share 79 of 101; 4 and 5 share 4 of 6
    assert found(jaccard_join.jaccard_join(crowded(spark, rows))) == [(1, 90, 1), (2, 90, 1), (3, 90, 1), (4, 5, 4), (5, 5, 5)]
    assert found(jaccard_join.jaccard_join(crowded(spark, [rows[0], rows[2]]))) == [(1, 90, 1), (3, 90, 3)]


def test_a_block_gives_a_forest(monkeypatch):
    """Pairs of one large bucket are filtered and verified in memory: at most one row less than there are sets."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 100))
    sets = []
    for _ in range(60):
        other = rng.integers(0, 1 << 62, rng.integers(0, 25))
        sets.append(np.unique(np.concatenate([rng.permutation(base)[: 100 - len(other)], base[-1:], other])))
    n = np.array([len(x) for x in sets])
    shown = n + (-n * 80 // 100) + 1
    last = base[-1]  # the bucket's shingle; those before it make the pairs of other buckets
    place = np.array([int(np.flatnonzero(x == last)[0]) for x in sets])
    values = [np.concatenate([[last], x[x != last]]) for x in sets]
    a, b = jaccard_join.joining(np.arange(60), n, np.zeros(60, np.int64), np.arange(60), np.zeros(60, np.int64), np.concatenate(values), 80)
    assert len(a) < 60 and place.max() < n.max() and (shown > 0).all()
    want, got = list(range(60)), list(range(60))
    for i in range(60):
        for j in range(i):
            if alike(set(sets[i].tolist()), set(sets[j].tolist())):
                want = [want[j] if x == want[i] else x for x in want]
    for x, y in zip(a, b, strict=True):
        assert alike(set(sets[x].tolist()), set(sets[y].tolist()))
        got = [got[x] if z == got[y] else z for z in got]
    same = lambda r: {tuple(np.flatnonzero(np.array(r) == z)) for z in r}
    assert same(got) == same(want) and 1 < len(set(want)) < 60


# ---- ranked search


def plain_ranked(items, docs, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(x for _, _, c in held for x in c)
    out = []
    for item, text in items:
        scores = []
        for i, w, c in held:
            m = 100 - 25 + (25 * len(w) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m)) for x in words(text) if x in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def search_corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary[: rng.choice([5, 40, 150])]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 120))) for i in range(150)]
    docs += [(500 + i, docs[i][1]) for i in range(30)] + [(None, docs[2][1]), (None, docs[3][1]), docs[4]] + [(900 + i, t) for i, t in enumerate(ODD)]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(60, docs[2][1]), (61, None), (62, "?!"), (63, "nowhere2be found"), (64, "É w x"), (7, "a a a b"), (None, docs[9][1])]
    return items, docs


@pytest.mark.parametrize(("k", "wave", "size"), [(20, 4096, 2048), (3, 4, 16)])
def test_ranked_search_equals_scoring_all(spark, monkeypatch, k, wave, size):
    monkeypatch.setattr(ranked_search, "WAVE", wave)
    monkeypatch.setattr(ranked_search, "SLICE", size)
    items, docs = search_corpus(k)
    frames = crowded(spark, items, "item_id"), crowded(spark, docs).repartition(3)
    got = ranked_search.ranked(*frames, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranked(items, docs, k)
    assert ranked_search.ranked(frames[0].limit(0), frames[1]).count() == ranked_search.ranked(frames[0], frames[1].limit(0)).count() == 0


def test_thresholds_keep_terms_out():
    """A rare term's stored kth impact rules out candidates from common terms."""
    stats = {0: (9000, 1000, 900), 1: (10, 1000, 1000), 2: (20, 900, 800)}
    terms, worths, rests, least = ranked_search.seeded([1, 0, 2], [1, 1, 2], stats)
    assert terms.tolist() == [0, 2, 1] and worths.tolist() == [9000, 40, 10]
    assert least == 9000 * 900 and (rests >= least).sum() == 1
    assert ranked_search.seeded([5], [1], stats) is None


# ---- periodic runs


def plain_runs(words, least=24, times=3):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            part = words[i : i + n]
            if j > i and n >= max(least, times * q) and not any(part[: n - p] == part[p:] for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def loops(rng):
    words = []
    while rng.random() < 0.9 and len(words) < 300:
        kind = rng.random()
        if kind < 0.4:
            words += [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        elif kind < 0.8:
            words += ([rng.choice("abc") for _ in range(rng.randint(1, 30))] * 130)[: rng.randint(1, 130)]
        elif words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(1, 80)]
    return words


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (4, 2), (10, 4)])
def test_refinement_equals_plain_runs(least, times):
    rng = random.Random(least)
    texts = [loops(rng) for _ in range(200)] + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, list("abcdefgh") * 3, list("abcdefghi") * 3]
    got = periodic_runs.batch_runs([[w.encode() for w in t] for t in texts], least, times)
    want = [plain_runs(t, least, times) for t in texts]
    assert got == want and sum(map(len, want)) > 50


def test_long_texts_in_good_time():
    words = [b"w%d" % i for i in range(60_000)]
    assert periodic_runs.batch_runs([[b"a"] * 200_000, (words * 4)[:200_000], words + words], 24, 3) == [[(0, 200_000, 1)], [(0, 200_000, 60_000)], []]


def test_registered_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(loops(rng)) if rng.random() < 0.5 else " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 200)))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, " ".join("ab" * 30)), (3, rows[3][1]), (3, "z " * 30)]
    crowded(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        gone = {k for a, m, q in runs for k in range(a + q, a + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 20 and periodic_runs.periodic_runs(crowded(spark, rows).limit(0)).count() == 0
