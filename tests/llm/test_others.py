import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import decontam, packing, topk_search, toxicity, url_filter, warc
from reelspark.llm.queries import tokenizer_path


# ---- exact top-k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "WAVE", 3)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], 1) for i in range(200)]
    rows += [(300 + i, rows[i][1], 2) for i in range(10)]  # ties
    rows += [(400, None, 0), (450, [None] + [0.0] * 15, 0), (500, [float("nan")] * 16, 0), (550, [float("inf")] * 16, 0), (None, [0.1] * 16, 0), (650, [0.5] * 3, 0), (651, [0.25] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect())
    v = {i: np.floor(256 * np.array(np.float32(e), float)).astype(int) for i, e, _ in rows if i is not None and e and None not in e and np.isfinite(e).all()}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- URL filters


def test_urls(spark):
    urls = {
        1: "http://www.Example.COM/en/x?q#f", 2: "https://a.example.com/en/", 3: "http://example.com/en", 4: "http://x.net/es/1", 5: "http://net/fr/",
        6: "http://xnet/fr/", 7: None, 8: "", 9: "no scheme", 10: "http://a.org", 11: "http://example.com", 12: "http://example.com?x=://y/en/", 13: "http://a.com/\n/x",
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in urls.items()] + [(2, urls[2], "x")], "page_id long, url string, host string")
    rows = url_filter.judge_urls(df).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 14
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("example.com", "/en", "com/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == ("net/fr/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == ("a.org", "", None, "allow") and got[11] == ("example.com", "", None, "allow")
    assert got[12] == ("example.com", "", None, "allow") and got[13][1] == "/\n/x"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_bloom_has_no_false_negatives():
    bloom = url_filter.BlockedBloom(5000)
    keys = [b"%d" % i for i in range(5000)]
    for k in keys:
        bloom.add(k)
    assert all(k in bloom for k in keys)
    assert sum(b"x%d" % i in bloom for i in range(5000)) < 500


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 90
    rows = [(1, "http://a/", "x"), (2, None, None), (3, "u\r\nv", big), (2, "b", ""), (9, "c", big), (4, "d", big), (5, "e", "x"), (None, "f", big), (6, "g", "WARC/1.1\r\n\r\n" * 9000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(df, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    n = len(big.encode())
    assert kinds[3, n] == ("response", None) and kinds[9, n] == kinds[4, n] == kinds[None, n] == ("revisit", 3)
    assert kinds[1, 1] == kinds[5, 1] == kinds[2, 0] == ("response", None)
    want = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == want[r.page_id] for r in got if r.record_type == "response")
    for raw in tmp_path.glob("raw-*.warc.gz"):
        members = next(tmp_path.glob(f"members-*-{raw.name[4:]}"))
        with raw.open("rb") as a, members.open("rb") as b:
            assert list(warc.records(warc.inflated(a))) == list(warc.records(warc.inflated(b)))
        index = warc.read_index(spark, [str(members).removesuffix(".warc.gz") + ".idx"]).collect()
        data = members.read_bytes()
        assert sum(r.length for r in index) == len(data)
        assert all(zlib.decompress(data[r.offset : r.offset + r.length], 31).startswith(b"WARC/1.1") for r in index)
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0
    # records are found by the sidecar: without a line, one isn't read
    members = [f"file://{p}" for p in sorted(tmp_path.glob("members-*.warc.gz"))]
    named = spark.createDataFrame([(p,) for p in members], "path string")
    side = next(tmp_path.glob("members-*.idx"))
    lines = side.read_text().splitlines()
    (tmp_path / f".{side.name}.crc").unlink(missing_ok=True)
    side.write_text("\n".join(lines[1:]))
    assert warc.read_records(warc.indexed(named, f"file://{tmp_path}")).count() == len(rows) - 1


def test_warc_cut_off():
    raw = warc.record(1, "u", b"abc", "0", None, 3)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(iter([raw[:-9]])))


# ---- packing


def test_counter_equals_tokenizer():
    from tokenizers import Tokenizer

    t, counter = Tokenizer.from_file(tokenizer_path()), packing.TokenCounter(tokenizer_path())
    for x in ["", " \n", "It's we'll 'st 12 3½", "é á ΑΣ ΑΣ.", "x\x1cy z\x85w \x1d", "a​b　c", "가 ᄀ ᅡ"]:
        assert np.frombuffer(counter.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_words_with_one_sign_need_no_pattern():
    from tokenizers import Tokenizer

    t, counter = Tokenizer.from_file(tokenizer_path()), packing.TokenCounter(tokenizer_path())
    searched, real = [], counter.splits

    class Counted:
        def findall(self, word):
            searched.append(word)
            return real.findall(word)

    counter.splits = Counted()
    text = " ".join(f"{w}{chr(c)}" for c in range(0x250) for w in ("ab", "ñu", "") if c != 0x130 and not chr(c).isspace())
    assert np.frombuffer(counter.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert max(map(len, searched)) == 1 and len(searched) <= 2 * len(set(searched))


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "xqzv", "12"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (None, "alpha"), (3, texts[3]), (202, "alpha " * 300)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, piece int")
    got = packing.pack(packing.pieces(df, tokenizer_path(), size=64), size=64, shard=40).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((i or -1, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.06 * -(-sum(r.length for r in got) // 64)
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_genetic_operators_keep_all_pieces():
    rng = random.Random(4)
    sizes = [rng.randint(1, 70) for _ in range(200)]
    one, two = packing.fresh(sizes, 100, 0.0, rng), packing.fresh(sizes, 100, 0.9, rng)
    for bins in (one, two, packing.crossover(sizes, one, two, 100, rng), packing.mutate(sizes, one, 100, rng), packing.evolve(sizes, two, 100, 1)):
        assert sorted(i for b in bins for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(packing.evolve(sizes, two, 100, 1)) <= len(two)


# ---- toxicity


def toxic_corpus(n=400, seed=1):
    rng = random.Random(seed)
    fine = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(fine) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 12))]
        bad = i % 5 == 0
        if bad:
            k = rng.randrange(len(parts))
            parts[k] += f" {rng.choice(['zwxk', 'qqyyz'])}{rng.choice(['', 'en', 'ung'])} {rng.choice(['zwxk', 'qqyyz'])}"
        rows.append((i, ". ".join(parts) + ".", int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", "en"), (None, rows[0][1], "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(5, None, 1), (None, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    out = toxicity.judged(docs, model).collect()
    assert len(out) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.predicted == 0 for r in out if r.doc_id in (900, 901))
    text = {i: t for i, t, _ in rows}
    spots = toxicity.locate(docs, model).collect()
    assert spots and sum("zwxk" in text[r.doc_id][r.start : r.end] or "qqyyz" in text[r.doc_id][r.start : r.end] for r in spots) / len(spots) > 0.95
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_scores_equal_a_plain_noisy_or(spark):
    """Every score, of long, odd, null and empty texts too, against sums over sentences worked out one by one."""
    rows = toxic_corpus(120)
    docs = [(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (2002, "..."), (2003, "no end"), (2004, "ÉTÉ zwxk! \n\n ok?"), (2005, " ".join(f"w{i % 91}" for i in range(200_000)) + ". zwxk."), (None, "zwxk")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 2), (4, -1)], "doc_id long, toxic int"))

    def plain(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
            z = model.bias
            for word in re.findall(r"\w+", sentence):
                for mark, part in ((b"w", word), (b"4", word[:4]), (b"6", word[:6])):
                    z += float(model.weights[zlib.crc32(mark + part.encode()) % toxicity.SLOTS])
            clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    got = sorted(((r.doc_id is None, r.doc_id or 0), r.score, r.predicted) for r in toxicity.judged(frame, model).collect())
    want = sorted(((i is None, i or 0), plain(t)) for i, t in docs)
    assert [k for k, *_ in got] == [k for k, _ in want]
    assert all(abs(g[1] - w[1]) < 1e-6 and g[2] == int(g[1] >= 0.5) for g, w in zip(got, want, strict=True))
    assert any(g[2] for g in got) and not all(g[2] for g in got)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = toxic_corpus(150)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    one, two = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in rows], flip))
    assert one.bias == two.bias and (one.weights == two.weights).all()


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.judged(docs, model).collect()] == [0, 0]
    assert toxicity.judged(docs.limit(0), model).count() == 0


# ---- decontamination


def plain_contained(docs, items, width=5, percent=80):
    import re

    words = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    shingles = lambda w, k: {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()

    out = []
    for i, t in docs:
        for j, q in items:
            k = min(width, len(words(q)))
            held, want = shingles(words(t), k), shingles(words(q), k)
            if want and len(want & held) * 100 >= percent * len(want):
                out.append((i, j, len(want), len(want & held)))
    return out


@pytest.mark.parametrize("rows", [0, 250_000])
def test_decontamination_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    items = [(j, " ".join(rng.choice(words) for _ in range(rng.randint(6, 70)))) for j in range(30)]
    items += [(30, None), (31, ""), (32, "two words"), (34, "Alpha beta: gamma"), (35, "one"), (33, items[0][1]), (33, items[0][1]), (None, items[1][1])]
    docs = []
    for i in range(80):
        body = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        quote = rng.choice(items[:30])[1].split()
        for _ in range(rng.randint(0, 3)):
            quote[rng.randrange(len(quote))] = "changed"
        if i % 2:
            body[rng.randint(0, len(body)) : 0] = [q.upper() if i % 3 else q + "," for q in quote]
        docs.append((i, " ".join(body)))
    docs += [(90, None), (91, ""), (92, "Two WORDS!"), (93, "some of two words more"), (95, "x " * 50 + "alpha, BETA gamma" + " y" * 50), (96, "alpha gamma beta"), (None, items[2][1]), (94, items[3][1]), (94, items[3][1])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, n int")
    b = spark.createDataFrame([(j, t, 1) for j, t in items], "item_id long, text string, doc_id int")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r) for r in decontam.contained(d, b).collect()), key=key) == sorted(plain_contained(docs, items), key=key)
    leaks = {i for i, *_ in plain_contained(docs, items)}
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns and sorted(key((r.doc_id,)) for r in kept.collect()) == sorted(key((i,)) for i, _ in docs if i not in leaks)
    assert decontam.contained(d.limit(0), b).count() == decontam.contained(d, b.limit(0)).count() == 0


def test_decontamination_is_native(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = decontam.contained(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
