"""Joining documents by the Jaccard similarity of their word shingles: rare-first prefix filtering that loses no link.

All shingles stand in one order, the rare ones first: those that at most ``hot`` sets show by their hash, then the
others by how many sets show them. A set of n shows the first n - ceil(t n) + 1 of its own. Two sets of similarity t or
more share a shingle that both show, so every link meets in a bucket (the sets that show one shingle). A pair goes
through the filters from cheap to dear: by lengths; by the places at which both show the bucket's shingle, which bound
what they share from there on; and, as a suffix filter, by their parity maps, which part each set's shingles over four
bits a shingle and tell how many fall on each, odd or even: two maps differ in no more bits than the sets in shingles.
What is left is verified on the whole sets, once: a pair that meets in several buckets is one row, or is looked at in the
bucket of the first shingle that both show.

Components need no pair within them. So buckets are first starred, in rounds: each set is compared with one of the bucket,
another one each round, and groups of copies grow together by linear numbers of pairs. Buckets within one component
are then done. The small ones of the others are joined across components; the sets of a large one meet in tasks,
block by block, and are verified there, where only pairs that join two components become rows: fewer than there are sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, portions, ship, stash, trim

ship(__name__)

#: Shingles that are told apart by how many sets show them: at most so many, as they are sent to the executors.
MOST_HOT = 1 << 17
#: Bits of a map of what is wanted, sets or shingles: eight for each, up to this; beyond, nothing is sifted.
MOST_BITS = 1 << 26
#: Rounds of stars, and how many sets of one group of copies are centres in a round.
ROUNDS, SEATS = 2, 8
#: Sets of a bucket from which they are compared in blocks, and sets and shingles of a block.
LARGE, BLOCK, BLOCK_SHINGLES = 64, 4096, 1 << 22
#: Bits by which a set is known at first; the few sets that share them are renamed.
NAME_BITS = 64


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Distinct XXH64 (seed 42) of the runs of ``width`` words, rising; ASCII lower case; fewer words: one run."""
    words = (text or b"").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in runs), np.uint64, len(words) - width + 1))


def parities(values: np.ndarray) -> bytes:
    """A map of four bits a shingle or more, a power of two: whether an odd number of the set falls on each."""
    bits = max(512, 1 << (4 * len(values) - 1).bit_length()) if len(values) else 512
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two maps differ, the longer one folded to the length of the shorter."""
    one, two = (np.frombuffer(m, np.uint64) for m in sorted((x, y), key=len))
    folded = np.bitwise_xor.reduce(two.reshape(-1, len(one)), axis=0)
    return int(np.bitwise_count(one ^ folded).sum())


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, k, s, s2, n, parity binary, held array<long>) for every row: hash of the text, the set's name and second
    hash, its size, its parities and the set, rising."""
    names = ["doc_id", "k", "s", "s2", "n", "parity", "held"]
    mask = (1 << NAME_BITS) - 1

    def run(batches):
        for whole in batches:
            for b in portions(whole, 2, 2 << 20):
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    sets = [shingles(t.as_py(), width) for t in part.column(2).cast(pa.large_binary())]
                    sizes = np.array([len(x) for x in sets], np.int32)
                    values = np.concatenate(sets)
                    digests = [xxhash.xxh3_128_intdigest(x) for x in sets]
                    s = np.array([x >> 64 & mask for x in digests], np.uint64).view(np.int64)
                    s2 = np.array([x & (1 << 64) - 1 for x in digests], np.uint64).view(np.int64)
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    held = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
                    columns = [part.column(0), part.column(1), pa.array(s), pa.array(s2), pa.array(sizes), pa.array([parities(x) for x in sets]), held]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))
    sets = stash(rows.mapInArrow(run, "doc_id long, k long, s long, s2 long, n int, parity binary, held array<long>"), "shingles")
    twice = sets.groupBy("s").agg(F.min("s2").alias("a"), F.max("s2").alias("z")).where("a < z")
    if not twice.limit(1).count():
        return sets
    renamed = sets.join(twice.select(F.col("s").alias("name")), F.col("s") == F.col("name"), "left")
    named = stash(renamed.withColumn("s", F.when(F.col("name").isNull(), F.col("s")).otherwise(F.xxhash64("s", "s2"))).select(*sets.columns), "shingles")
    discard(sets)
    return named


def ordered(values: np.ndarray, sizes: np.ndarray, hot) -> np.ndarray:
    """The values of sets of these sizes, one after the other and each rising, in the order of rarity; hot: None or the
    broadcast (values, rising, and their ranks) of those that many sets show."""
    if hot is None or not len(values):
        return values
    often, ranks = hot.value
    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
    rank = np.where(often[at] == values, ranks[at], 0)
    if not rank.any():
        return values
    return values[np.lexsort((rank, np.repeat(np.arange(len(sizes)), sizes)))]  # stable: rare ones stay by hash


def prefixes(sets: DataFrame, percent: int, hot=None, wanted=None) -> DataFrame:
    """(h, s, n, i): the shingles that each set shows, i being the place; a set that a task has met shortly before is
    left out. hot: as for ordered(). wanted: broadcast map of shingles, others are left out (and some stay)."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                fresh = []
                for x in part.column(0).to_pylist():
                    fresh.append(x not in seen)
                    seen.add(x)
                if len(seen) > 1 << 18:
                    seen = set()
                part = part.filter(pa.array(fresh))
                lists = part.column(1)
                s, sizes = part.column(0).to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
                values = ordered(lists.flatten().to_numpy(), sizes, hot)
                shown = np.where(sizes > 0, sizes + (-sizes * percent // 100) + 1, 0)
                starts = np.cumsum(sizes) - sizes
                i = np.arange(shown.sum()) - np.repeat(np.cumsum(shown) - shown, shown)
                h = values[np.repeat(starts, shown) + i]
                columns = [h, np.repeat(s, shown), np.repeat(sizes, shown).astype(np.int32), i.astype(np.int32)]
                if wanted is not None:
                    hit = in_map(h, wanted.value)
                    columns = [x[hit] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "s", "n", "i"])
        trim()

    return sets.select("s", "held").mapInArrow(run, "h long, s long, n int, i int")


def map_of(rows: DataFrame, column: str):
    """A broadcast map of eight bits or more a row with those of the column's values set, which sifts what can't be wanted
    before a shuffle. Beyond MOST_BITS, None: then all is shuffled, which is linear too."""
    n = rows.count()
    bits = 1 << max(16, (8 * n - 1).bit_length()) if n else 1 << 16
    if bits > MOST_BITS:
        return None
    word, bit = F.expr(f"cast(({column} & {bits - 1}) >> 6 as int)"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    held = np.zeros(bits >> 6, np.int64)
    for r in rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        held[r.word] = r.bits
    return rows.sparkSession.sparkContext.broadcast(held)


def in_map(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    hit = held.view(np.uint64)[(values & (64 * len(held) - 1)) >> 6] >> (values & 63).astype(np.uint64) & np.uint64(1)
    return hit.astype(bool)


def whole_sets(sets: DataFrame, ends: DataFrame) -> DataFrame:
    """(s, held), a row for each set that ends (s) name."""
    wanted = map_of(ends, "s")
    some = sets.select("s", "held")
    if wanted is not None:

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(in_map(b.column(0).to_numpy(), wanted.value)))
            trim()

        some = some.mapInArrow(run, "s long, held array<long>")
    return some.join(ends, "s").groupBy("s").agg(F.first("held").alias("held"))


def may_be_similar(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) without those that their sets' sizes and parities rule out."""

    def run(batches):
        for b in batches:
            far = np.fromiter((apart(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)), np.int64, b.num_rows)
            keep = far * (100 + percent) <= b.column(4).to_numpy().astype(np.int64) * (100 - percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))
        trim()

    one = marks.select(F.col("s").alias("a"), F.col("parity").alias("x"), F.col("n").alias("n1"))
    two = marks.select(F.col("s").alias("b"), F.col("parity").alias("y"), F.col("n").alias("n2"))
    rows = pairs.join(one, "a").join(two, "b").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
    return rows.select("a", "b", "x", "y", (F.col("n1") + F.col("n2")).alias("n")).mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is ``percent`` or more."""
    pairs = stash(pairs.distinct(), "pairs")
    near = stash(may_be_similar(pairs, marks, percent), "near")
    ends = near.select(F.col("a").alias("s")).union(near.select(F.col("b").alias("s"))).distinct()
    ends = stash(ends, "ends")
    whole = stash(whole_sets(sets, ends), "whole")
    one, two = whole.withColumnsRenamed({"s": "a", "held": "x"}), whole.withColumnsRenamed({"s": "b", "held": "y"})
    both = F.size(F.array_intersect("x", "y"))
    rows = near.join(one, "a").join(two, "b").select("a", "b", (F.size("x") + F.size("y")).alias("n"), both.alias("both"))
    edges = stash(rows.where(F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent).select("a", "b"), "edges")
    discard(pairs, near, ends, whole)
    return edges


def similar_sets(sets: DataFrame, percent: int, hot: int, likely: DataFrame | None = None) -> DataFrame:
    """(node, root): the components of all pairs of distinct sets of that similarity; sets without one may lack. likely:
    pairs (a, b) of sets found otherwise, which are verified first; buckets within the components that they make are done."""
    context = sets.sparkSession.sparkContext
    marks = stash(sets.groupBy("s").agg(F.first("n").alias("n"), F.first("parity").alias("parity")), "marks")
    rows = prefixes(sets, percent).groupBy("h").agg(F.count("*").alias("rows")).where(F.col("rows") > hot)
    held = stash(rows.orderBy(F.desc("rows"), "h").limit(MOST_HOT), "often")
    often, last = held.collect(), None
    discard(held)
    if often:
        often.sort(key=lambda r: r.h)
        h, count = np.array([r.h for r in often], np.int64), np.array([r.rows for r in often], np.int64)
        ranks = np.empty(len(h), np.int64)
        ranks[np.lexsort((h, count))] = np.arange(1, len(h) + 1)
        last = context.broadcast((h, ranks))
    counts = prefixes(sets, percent, last).groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("z"))
    shared = stash(counts.where("a < z").select("h"), "shared")
    shown = prefixes(sets, percent, last, map_of(shared, "h"))
    held = stash(shown.join(shared, "h").distinct(), "buckets")
    # what both can share is no more than before, at and after the places of the shingle that they do share
    most = F.least("i", "i2") + 1 + F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) - 1
    near = most * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    edges = roots = None
    if likely is not None:
        edges = similar(likely, sets, marks, percent)
        roots = components(edges)
    for seed in range(ROUNDS):
        named = _named(held, roots)
        order = F.xxhash64("s", F.pmod("h", F.lit(SEATS)), F.lit(seed))
        centre = named.groupBy("h").agg(F.min_by(F.struct("s", "n", "i", "r"), F.struct(order, "s")).alias("c"), F.min("r").alias("r1"), F.max("r").alias("r2"))
        centre = centre.where("r1 < r2").select("h", F.col("c.s").alias("c"), F.col("c.n").alias("n2"), F.col("c.i").alias("i2"), F.col("c.r").alias("rc"))
        stars = named.join(centre, "h").where((F.col("r") != F.col("rc")) & near)
        found = similar(stars.select(F.least("c", "s").alias("a"), F.greatest("c", "s").alias("b")), sets, marks, percent)
        if edges is not None and not found.limit(1).count():
            discard(found)
            break
        was = [x for x in (edges, roots) if x is not None]
        edges = found if edges is None else stash(edges.union(found), "edges")
        roots = components(edges)
        discard(*was, *([found] if found is not edges else []))
    named = stash(_named(held, roots), "named")
    discard(shared, held, roots)
    spread = named.groupBy("h").agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.count("*").alias("rows"), F.sum("n").alias("size")).where("r1 < r2 and rows > 2")
    left = stash(named.join(spread.select("h", "rows", "size"), "h"), "open")
    few = left.where(F.col("rows") <= LARGE)
    other = few.select(F.col("h").alias("h2"), F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("r").alias("r2"))
    across = few.join(other, (F.col("h") == F.col("h2")) & (F.col("r") < F.col("r2")) & near)
    pairs = across.select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b"))
    more = [edges, similar(pairs, sets, marks, percent)]
    many = left.where(F.col("rows") > LARGE)
    if many.limit(1).count():
        ends = stash(many.select("s").distinct(), "ends")
        whole = stash(whole_sets(sets, ends), "whole")
        more.append(stash(in_blocks(many, whole, percent, last), "joining"))
        discard(ends, whole)
    joined = more[0].union(more[1]) if len(more) == 2 else more[0].union(more[1]).union(more[2])
    every = components(joined)
    discard(marks, named, left, *more)
    return every


def in_blocks(rows: DataFrame, whole: DataFrame, percent: int, hot) -> DataFrame:
    """(a, b): similar sets of one bucket that join two components, as many as join all that the bucket's links join. rows:
    (h, s, n, i, r, rows, size) of large buckets, whole: (s, held) of their sets. Buckets are cut into blocks of at most
    BLOCK sets and about BLOCK_SHINGLES shingles; each two blocks meet in a task's memory, where their pairs are
    filtered and verified, so neither candidates nor links become rows."""
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    rows = rows.join(whole, "s").withColumn("block", F.pmod(F.xxhash64("s"), blocks).cast("int"))
    rows = rows.withColumn("against", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("h", "s", "n", "i", "r", "held", "block", F.least("block", "against").alias("one"), F.greatest("block", "against").alias("two"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        s, n, i, r, block = (table.column(c).to_numpy().astype(np.int64) for c in ("s", "n", "i", "r", "block"))
        lists = table.column("held").chunk(0)
        a, b = joining(s, n, i, r, block, ordered(lists.flatten().to_numpy(), n, hot), percent)
        if len(s) > BLOCK // 2:
            trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("h", "one", "two").applyInArrow(compare, "a long, b long")


def joining(s, n, i, r, block, values, percent: int) -> tuple[list[int], list[int]]:
    """Ends of a forest of similar pairs across components r, of sets s of n shingles (values: all of them, each set's in
    the order of rarity) that show a shingle at place i; if there are two blocks, of pairs between these only."""
    two = len(np.unique(block)) > 1
    begin = np.cumsum(n) - n
    order = np.lexsort((s, n))  # by size: what a set can be similar to lies in a stretch right after it
    s, n, i, block, begin = s[order], n[order], i[order], block[order], begin[order]
    tree = np.unique(r[order], return_inverse=True)[1]
    dense = np.unique(values, return_inverse=True)[1]
    maps = [np.frombuffer(parities(values[at : at + size].view(np.uint64)), np.uint64) for at, size in zip(begin.tolist(), n.tolist(), strict=True)]
    width = np.array([len(m) for m in maps])
    ends = np.append(np.flatnonzero(np.diff(width)) + 1, len(s))
    tables = {int(width[e - 1]): (int(at), np.stack(maps[at:e])) for at, e in zip(np.append(0, ends[:-1]), ends, strict=True)}
    del maps
    mark = np.zeros(int(dense.max()) + 1 if len(dense) else 1, bool)
    upto = np.searchsorted(n, n * 100 // percent, "right")
    out_a, out_b = [], []
    for k in range(len(s) - 1):
        x = np.arange(k + 1, upto[k])
        x = x[tree[x] != tree[k]]
        if two:
            x = x[block[x] != block[k]]
        most = np.minimum(i[k], i[x]) + np.minimum(n[k] - i[k], n[x] - i[x])
        x = x[most * (100 + percent) >= (n[k] + n[x]) * percent]
        if not len(x):
            continue
        w = int(width[k])
        at, table = tables[w]
        mine, far = table[k - at], np.empty(len(x), np.int64)
        for wide in (w, 2 * w):  # similar sets have maps of one width, or of twice the other's
            some = width[x] == wide
            if some.any():
                start, held = tables[wide]
                theirs = held[x[some] - start]
                theirs = theirs if wide == w else theirs[:, :w] ^ theirs[:, w:]
                far[some] = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
        x = x[far * (100 + percent) <= (n[k] + n[x]) * (100 - percent)]
        if not len(x):
            continue
        own = dense[begin[k] : begin[k] + n[k]]
        mark[own[: i[k]]] = True
        x = x[[not mark[dense[a : a + z]].any() for a, z in zip(begin[x].tolist(), i[x].tolist(), strict=True)]]  # else it is their bucket's
        mark[own] = True
        both = np.array([np.count_nonzero(mark[dense[a : a + z]]) for a, z in zip(begin[x].tolist(), n[x].tolist(), strict=True)], np.int64)
        mark[own] = False
        for y in x[both * 100 >= (n[k] + n[x] - both) * percent].tolist():
            if tree[y] != tree[k]:
                out_a.append(min(int(s[k]), int(s[y])))
                out_b.append(max(int(s[k]), int(s[y])))
                tree[tree == tree[y]] = tree[k]
    return out_a, out_b


def _named(held: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Bucket rows with r, the component that their set is in so far."""
    if roots is None:
        return held.select("h", "s", "n", "i", F.col("s").alias("r"))
    return held.join(roots, held["s"] == roots["node"], "left").select("h", "s", "n", "i", F.coalesce("root", "s").alias("r"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, hot: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: the size of its set of distinct runs of ``width`` words
    (ASCII lower case; fewer words: the whole sequence) and the smallest doc_id that links reach, its own included. Two
    rows link when their sets' Jaccard similarity is ``percent`` or more.

    A null text, or one without words, has an empty set and links with nothing, not even its like. Rows that repeat, or
    share an id, are documents of their own and link by their texts. A row without an id links as any other but never names a
    component (null where no row of it has an id). Texts of any length are read whole. Other columns are ignored,
    whatever their names. An empty table gives no rows. ``hot``: how many sets must show a shingle for it to be told
    apart by their number.
    """
    sets = shingle_sets(docs, id_col, text_col, width)
    roots = similar_sets(sets, percent, hot)
    classes = sets.groupBy("s").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    rooted = classes.join(roots, F.col("s") == F.col("node"), "left").select("s", "first", "n", F.coalesce("root", "s").alias("root"))
    rooted = stash(rooted, "rooted")
    named = rooted.where("n > 0").groupBy("root").agg(F.min("first").alias("component_id"))
    named = stash(rooted.where("n > 0").join(named, "root").select(F.col("s").alias("name"), "component_id"), "components")
    rows = stash(sets.select("doc_id", "s", "n"), "rows")
    discard(sets, roots, rooted)
    out = rows.join(named, F.col("s") == F.col("name"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
