"""Runs of windows that share an anchor: how the repeated-substring operators cut their work into groups.

Every window of ``window`` units (words or bytes) has as its anchor the least hash among its grams of ``gram``
units. Equal windows have equal anchors, so anchors split all windows into groups that can be searched one by
one. Neighbouring windows mostly share their anchor; such a run (its first window, their number) is one row.
Runs of one anchor with the same content are a class; classes, not copies, go to the searching tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, portions, ship, stash, trim

ship(__name__)

#: Longest stretch of a text that is handled at once, and longest run, in bytes and windows.
STRETCH, LONGEST = 1 << 20, 1024
#: Bytes of runs that a searching task gets on average.
TASK_BYTES = 8 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE_BYTE, BASE_WORD = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2^64, and those of its inverse."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        up, down = np.full(max(n, 1 << 16), base, np.uint64), np.full(max(n, 1 << 16), pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return held


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times the base's powers: any stretch's polynomial hash is a difference of two."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def gram_hashes(values: np.ndarray, gram: int, base: int) -> np.ndarray:
    """The hash of every run of ``gram`` values; a function of these values alone."""
    n = len(values) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values, base)
    return mixed((sums[gram:] - sums[:n]) * powers(base, len(values))[1][:n])


def sliding_min(h: np.ndarray, m: int) -> np.ndarray:
    """The least of every m neighbours, from running minima inside blocks of m."""
    n = len(h) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    full = np.full(-(-len(h) // m) * m, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    ahead = np.minimum.accumulate(full.reshape(-1, m), axis=1).ravel()
    back = np.minimum.accumulate(full.reshape(-1, m)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[m - 1 : m - 1 + n])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that aren't ASCII white space)."""
    edge = np.diff(np.concatenate([[0], (~SPACE[data]).astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1), BASE_BYTE)
    return mixed((sums[ends] - sums[starts]) * powers(BASE_BYTE, len(data) + 1)[1][starts])


def word_stretches(text: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, bytes) of stretches that overlap by window - 1 words. A stretch that holds words
    grows until it holds a whole window or the text ends, so each begins after the one before."""
    at, first, size = 0, 0, STRETCH
    while True:
        end = at + size
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        if end >= len(text):
            yield first, text[at:]
            return
        starts, _ = word_bounds(np.frombuffer(text, np.uint8, end - at, at))
        if 0 < len(starts) < window:
            size = 2 * (end - at)
            continue
        yield first, text[at:end]
        back = min(window - 1, len(starts))
        first += len(starts) - back
        at = at + int(starts[len(starts) - back]) if back else end
        size = STRETCH


def cut_runs(keys: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and lengths of the runs of one key among valid windows; a run ends after LONGEST."""
    ok = np.flatnonzero(valid)
    if not len(ok):
        return ok, ok
    new = np.ones(len(ok), bool)
    new[1:] = (np.diff(ok) != 1) | (keys[ok[1:]] != keys[ok[:-1]])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(ok)))
    if sizes.max() > LONGEST:
        parts = -(-sizes // LONGEST)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, sizes = np.repeat(starts, parts) + k * LONGEST, np.repeat(sizes, parts)
        sizes = np.minimum(LONGEST, sizes - k * LONGEST)
    return ok[starts], sizes


def again(grams: np.ndarray, keys: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a run goes on past an occurrence of its anchor: only then can it hold a window twice."""
    passed = np.concatenate([[0], np.cumsum(grams[: len(keys)] == keys)])
    return passed[at + sizes - 1] > passed[at]


def digests(view: memoryview, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """The 128-bit digests of stretches of bytes, by which copies of a run are known."""
    return [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def word_runs(texts: list[bytes], window: int, gram: int):
    """(text number, first word, windows, bytes, key, digest, again()) arrays of all runs of all texts."""
    held, size, out = [], 0, []

    def flush():
        data = np.frombuffer(b" ".join(x[2] for x in held), np.uint8)
        starts, ends = word_bounds(data)
        grams = gram_hashes(word_hashes(data, starts, ends), gram, BASE_WORD)
        keys = sliding_min(grams, window - gram + 1)
        edge = np.cumsum([0] + [len(x[2]) + 1 for x in held])
        first = np.searchsorted(starts, edge)  # number of each stretch's first word
        which = np.searchsorted(first, np.arange(len(keys)), "right") - 1
        valid = np.arange(len(keys)) + window <= first[which + 1] if len(keys) else np.zeros(0, bool)
        at, sizes = cut_runs(keys, valid)
        if len(at):
            lo, hi = starts[at], ends[at + sizes + window - 2]
            w = which[at]
            texts_at, firsts = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            out.append((texts_at[w], firsts[w] + at - first[w], sizes, hi - lo, keys[at].view(np.int64), digests(memoryview(data), lo, hi), again(grams, keys, at, sizes)))

    for i, text in enumerate(texts):
        for first, part in word_stretches(text, window):
            held.append((i, first, part))
            size += len(part)
            if size >= STRETCH:
                flush()
                held, size = [], 0
    if held:
        flush()
    return out


def byte_runs(texts: list[bytes], window: int, gram: int):
    """As word_runs, for windows of bytes."""
    held, size, out = [], 0, []

    def flush():
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        grams = gram_hashes(data.astype(np.uint64) + np.uint64(1), gram, BASE_BYTE)
        keys = sliding_min(grams, window - gram + 1)
        edge = np.cumsum([0] + [len(x[2]) for x in held])
        which = np.repeat(np.arange(len(held)), np.diff(edge))[: len(keys)]
        valid = np.arange(len(keys)) + window <= edge[which + 1]
        at, sizes = cut_runs(keys, valid)
        if len(at):
            hi = at + sizes + window - 1
            w = which[at]
            texts_at, firsts = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            out.append((texts_at[w], firsts[w] + at - edge[w], sizes, hi - at, keys[at].view(np.int64), digests(memoryview(data), at, hi), again(grams, keys, at, sizes)))

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), STRETCH):
            part = text[at : at + STRETCH + window - 1]
            if len(part) >= window:
                held.append((i, at, part))
                size += len(part)
                if size >= STRETCH:
                    flush()
                    held, size = [], 0
    if held:
        flush()
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc_id, text): k1 the id, k2 a hash of the text (and of the id's being null), so rows that
    share an id stay apart and only rows equal throughout share a key."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k2"), "doc_id", "text")


def all_runs(base: DataFrame, find, window: int, gram: int) -> DataFrame:
    """(k1, k2, start, n, size, v, h, again) of every run of every row of keyed()."""
    least = window if find is byte_runs else 2 * window - 1
    names = ["k1", "k2", "start", "n", "size", "v", "h", "again"]

    def run(batches):
        for whole in batches:
            for b in portions(whole, 3):
                k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
                texts = [t.as_py() or b"" for t in b.column(3).cast(pa.large_binary())]
                for i, start, n, size, v, h, twice in find(texts, window, gram):
                    columns = [k1[i], k2[i], start.astype(np.int64), n.astype(np.int32), size.astype(np.int64), v, h, twice]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)
        trim()

    return base.where(F.octet_length("text") >= least).mapInArrow(run, "k1 long, k2 long, start long, n int, size long, v long, h binary, again boolean")


def repeated(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs whose anchor occurs more than once, and their classes: (v, h, copies, again, k1, k2, start, n, size,
    classes, bytes), the run of a class that is named being that of the least key; classes and bytes are those of
    the whole anchor."""
    runs = stash(runs, "runs")
    often = runs.groupBy("v").agg(F.count("*").alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("v")
    often = stash(often, "often")
    cand = stash(runs.join(often, "v"), "candidates")  # plain sides: a hot anchor's rows can be split
    discard(runs, often)
    one = cand.groupBy("v", "h").agg(F.count("*").alias("copies"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "start", "n", "size")).alias("one"))
    classes = stash(one.select("v", "h", "copies", "again", "one.*"), "classes")
    sizes = stash(classes.groupBy("v").agg(F.count("*").alias("classes"), F.sum("size").alias("bytes")), "sizes")
    grouped = stash(classes.join(sizes, "v"), "grouped")
    discard(classes, sizes)
    return cand, grouped


def fetched(base: DataFrame, classes: DataFrame, slice_of) -> DataFrame:
    """(v, h, copies, k1, bytes, body binary): classes with the content of their named run, taken from the texts by
    slice_of(text) -> (start, n) -> bytes."""
    wanted = classes.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "v", "h", "copies", "bytes")).alias("wanted"))
    rows = base.join(wanted.withColumnsRenamed({"k1": "w1", "k2": "w2"}), (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")))
    rows = rows.select("k1", "k2", "text", "wanted")
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["v", "h", "copies", "k1", "bytes", "body"]

    def run(batches):
        seen: set = set()
        for whole in batches:
            for b in portions(whole, 2):
                out = []
                for k1, k2, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), b.column(3), strict=True):
                    if seen != (k1, k2):  # rows that are equal throughout lie together, as the join sorts them
                        seen = (k1, k2)
                        cut = slice_of(text.as_py() or b"")
                        out.extend((x["v"], x["h"], x["copies"], k1, x["bytes"], cut(x["start"], x["n"])) for x in wanted.as_py())
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)
        trim()

    return rows.mapInArrow(run, "v long, h binary, copies long, k1 long, bytes long, body binary")


def groups(batches, most: int) -> Iterator[dict[str, list]]:
    """Rows sorted by v, in pieces of whole v groups of at least ``most`` bytes of body."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for b in portions(whole, whole.schema.get_field_index("body"), most):
            held.append(b)
            size += b.column("body").nbytes
            if size >= most:
                table = pa.Table.from_batches(held)
                v = table.column("v").to_numpy()
                end = int(np.flatnonzero(v != v[-1])[-1]) + 1 if v[0] != v[-1] else 0
                if end:
                    yield table.slice(0, end).to_pydict()
                    rest = table.slice(end).combine_chunks()
                    held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held).to_pydict()


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open intervals as their union's maximal ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: A class's repeated windows as half-open intervals: those of its named run, and those of its other copies.
FOUND = "v long, h binary, parts array<struct<a: long, b: long>>, rest array<struct<a: long, b: long>>"
_INTERVALS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _found_batch(rows: list) -> pa.RecordBatch:
    """Rows (v, h, [(a, b)], [(a, b)]) as a batch of FOUND."""
    listed = [pa.array([[{"a": a, "b": b} for a, b in r[k]] for r in rows], _INTERVALS) for k in (2, 3)]
    arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), *listed]
    return pa.RecordBatch.from_arrays(arrays, names=["v", "h", "parts", "rest"])


def _merge_found(batches):
    """Columns of FOUND with the intervals of each row merged."""
    joined = lambda p: merged([(x["a"], x["b"]) for x in p])
    for b in batches:
        v, h, parts, rest = (b.column(i).to_pylist() for i in range(4))
        yield _found_batch(list(zip(v, h, map(joined, parts), map(joined, rest), strict=True)))


def removed(base: DataFrame, find, slice_of, search, window: int, gram: int, ranked: bool, room: int, batch: int) -> DataFrame:
    """(k1, k2, spans array<struct<a, b>>): the windows of each document that occur elsewhere, or, ranked, in one of
    smaller k1. Every one is found by ``search`` in a group's structure, that of copies of a run as well: a class
    stands there once, with the number of its copies.

    search(columns of whole groups, gram) yields (v, h, parts, rest) for classes with repeated windows. An anchor
    whose classes hold more than ``room`` bytes isn't searched in one task: its classes go through the same steps
    with anchors of twice the length, at last with the windows themselves, which make groups of one class; so
    groups stay memory-sized however common a passage is.
    """
    cand, classes = repeated(all_runs(base, find, window, gram))
    few = F.lit(gram == window) | (F.col("bytes") <= room) | (F.col("classes") == 1)
    several = F.col("classes") > 1
    any_hot = gram < window and classes.where(~few).limit(1).count() > 0
    wanted = several | (F.col("copies") > 1) if ranked else several | (F.col("copies") > 1) | F.col("again")
    bodies = stash(fetched(base, classes.where(wanted).withColumn("bytes", F.when(few, 0).otherwise(F.col("bytes"))), slice_of), "bodies")
    total = classes.where(wanted & few).agg(F.sum("size")).first()[0] or 0
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)

    def run(batches):
        for g in groups(batches, batch):
            yield _found_batch(list(search(g, gram)))
        trim()

    dealt = bodies.where("bytes = 0").drop("bytes").repartition(parts, "v").sortWithinPartitions("v")
    found = dealt.mapInArrow(run, FOUND)
    if any_hot:
        hot = bodies.where("bytes > 0")
        deep = hot.select("k1", F.xxhash64("v", "h").alias("k2"), F.col("k1").alias("doc_id"), F.col("body").alias("text"))
        again = removed(deep, find, slice_of, search, window, min(2 * gram, window), ranked, room, batch)
        names = hot.select("v", "h", "copies", F.col("k1").alias("w1"), F.xxhash64("v", "h").alias("w2"))
        kept = names.join(again, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left")
        kept = kept.join(classes.select("v", "h", "n"), ["v", "h"])
        every = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b")))
        none = F.array().cast("array<struct<a: long, b: long>>")
        twice = F.col("copies") > 1  # such a class's windows stand in several places, whatever else holds them
        spans = F.coalesce("spans", none)
        kept = kept.select("v", "h", F.when(twice, every).otherwise(spans).alias("parts") if not ranked else spans.alias("parts"), F.when(twice, every).otherwise(none).alias("rest"))
        found = found.union(kept.mapInArrow(_merge_found, FOUND))
    found = stash(found, "found")
    owned = found.join(classes.select("v", "h", F.struct("k1", "k2", "start").alias("named")), ["v", "h"])
    owned = stash(owned, "owned")
    here = cand.select("v", "h", "k1", "k2", "start").join(owned, ["v", "h"])
    mine = F.col("k1") == F.col("named.k1") if ranked else F.struct("k1", "k2", "start") == F.col("named")
    spans = here.select("k1", "k2", "start", F.explode(F.when(mine, F.col("parts")).otherwise(F.col("rest"))).alias("p"))
    spans = spans.select("k1", "k2", (F.col("start") + F.col("p.a")).alias("a"), (F.col("start") + F.col("p.b")).alias("b"))
    spans = stash(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    discard(cand, classes, bodies, found, owned)
    return spans


def cut(base: DataFrame, gone: DataFrame, run, schema: str) -> DataFrame:
    """Every row of base with its document's spans, through run."""
    rows = base.join(gone.withColumnsRenamed({"k1": "w1", "k2": "w2"}), (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left")
    return rows.select("k1", "k2", "doc_id", "text", "spans").mapInArrow(run, schema)
