"""Periodic runs of words, by Crochemore's partition refinement.

The places of a text are kept in classes of equal factors (stretches of words) of one length. Classes of the length
ahead follow from those of the length before: a place's class splits by the class of the next place. Only the smaller
parts of what was just split are walked for that (the largest part needn't be, as what isn't reached stays together), so
all lengths together cost n log n. Two neighbouring members of a class whose distance equals the length stand on a
square, and squares of one period at neighbouring places merge into a run.

A run of period q and of at least max(least, times * q) words repeats a factor of ``base`` words at distance q, base being
the least of max(least - q, (times - 1) * q) over all q: 16 for 24 words and three periods. So the refinement starts at
this length, where nearly all places are alone already; the classes there come from doubling over whole batches. At
that length neighbours at any distance up to it are squares' places, beyond it those at exactly the length.

Why neighbours are enough: if a class held a place between i and i + q, the text there would have a period d < q besides
q over at least d + q words, so also their common divisor, and q weren't the smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, ship, trim

ship(__name__)

OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def base_length(least: int, times: int) -> int:
    """Words that every run repeats at the distance of its period."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def repeated_places(words: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, classes) of the factors of ``length`` words that occur twice or more in one text, by doubling; words:
    numbers of the words of all texts, doc: each word's text, rising."""
    n = len(words)
    place, key, has = np.arange(n), doc * (int(words.max()) + 1) + words if n else words, 1
    while True:
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        often = counts[inverse] > 1
        place, which = place[often], inverse[often]
        if has == length or not len(place):
            return place, which
        step = min(has, length - has)
        dense = np.full(n + step, -1, np.int64)
        dense[place] = which
        after = dense[place + step]
        ok = after >= 0
        ok[ok] = doc[place[ok] + step] == doc[place[ok]]
        key = which[ok] * (len(counts) + 1) + after[ok]
        place, has = place[ok], has + step


def squares(place: np.ndarray, which: np.ndarray, n: int, base: int, most: int) -> dict[int, list[int]]:
    """{period: places} at which factors of max(base, period) words recur after just the period, of one text of n words
    whose repeated factors of ``base`` words stand at ``place`` in the classes ``which``; periods of up to ``most``."""
    order = np.lexsort((place, which))
    place, which = place[order], which[order]
    same = which[1:] == which[:-1]
    gaps = np.where(same, place[1:] - place[:-1], n)
    # a class whose members all lie farther apart than any period can hold no run, nor can those that split by it
    starts = np.flatnonzero(np.append(True, ~same))
    near = np.minimum.reduceat(np.append(gaps, n), starts) <= most
    keep = np.repeat(near, np.diff(np.append(starts, len(place))))
    place, which = place[keep], which[keep]
    found: dict[int, list[int]] = {}
    if not len(place):
        return found
    places, classes = place.tolist(), which.tolist()
    of = dict(zip(places, classes, strict=True))
    after: dict[int, int] = {}
    before: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    waiting: dict[int, list[int]] = {}  # by distance: places whose next member may be that far
    for i, c in zip(places, classes, strict=True):
        some = members.setdefault(c, [])
        if some:
            j = some[-1]
            after[j], before[i] = i, j
            if i - j <= base:
                found.setdefault(i - j, []).append(j)
            elif i - j <= most:
                waiting.setdefault(i - j, []).append(j)
        some.append(i)
    size = {c: len(x) for c, x in members.items()}
    last = {c: x[-1] for c, x in members.items()}
    first = {c: x[0] for c, x in members.items()}
    walk = list(members.values())
    alone = [i + 1 for i in places if i + 1 not in of]
    fresh = max(size) + 1
    del members

    def unlink(i: int, c: int, length: int) -> None:
        left, right = before.pop(i, None), after.pop(i, None)
        if left is None:
            first[c] = right
        elif right is None:
            del after[left]
        else:
            after[left] = right
        if right is None:
            last[c] = left
        elif left is None:
            del before[right]
        else:
            before[right] = left
            if length <= right - left <= most:
                waiting.setdefault(right - left, []).append(left)
        size[c] -= 1

    for length in range(base + 1, most + 1):
        parts: dict[int, list[int]] = {}  # classes of the length before with the classes split from them
        single: list[int] = []
        for j in alone:
            c = of.pop(j - 1, None)
            if c is not None:
                unlink(j - 1, c, length)
                parts.setdefault(c, [])
                single.append(j - 1)
        for some in walk:
            into: dict[int, int] = {}
            for j in some:
                i = j - 1
                c = of.get(i)
                if c is None:
                    continue
                unlink(i, c, length)
                k = into.get(c)
                if k is None:
                    k = into[c] = fresh
                    fresh += 1
                    parts.setdefault(c, []).append(k)
                    size[k], first[k] = 0, i
                else:
                    left = last[k]
                    after[left], before[i] = i, left
                    if length <= i - left <= most:
                        waiting.setdefault(i - left, []).append(left)
                of[i] = k
                last[k] = i
                size[k] += 1
        walk, alone = [], single
        for c, some in parts.items():
            if size[c]:
                some = [*some, c]
            else:
                del size[c], first[c], last[c]
            largest = max(some, key=size.__getitem__, default=None)
            for k in some:
                if size[k] == 1:
                    i = first[k]
                    del of[i], size[k], first[k], last[k]
                    if k != largest:
                        alone.append(i)
                elif k != largest:
                    i, listed = first[k], []
                    while i is not None:
                        listed.append(i)
                        i = after.get(i)
                    walk.append(listed)
        at = [i for i in dict.fromkeys(waiting.pop(length, ())) if after.get(i) == i + length]
        if at:
            found[length] = at
        if not of:
            break
    return found


def runs_of(found: dict[int, list[int]], base: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start and period: squares' places side by side, merged."""
    out = []
    for q, places in found.items():
        at = np.sort(np.array(places, np.int64))
        edge = np.flatnonzero(np.diff(at) != 1)
        lo, hi = at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)]
        sizes = hi - lo + max(base, q) + q
        out += [(a, n, q) for a, n in zip(lo.tolist(), sizes.tolist(), strict=True) if n >= max(least, times * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def batch_runs(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words."""
    base = base_length(least, times)
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc, edge = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    place, which = repeated_places(words, doc, base)
    ends = np.flatnonzero(np.diff(doc[place])) + 1
    for at, classes in zip(np.split(place, ends), np.split(which, ends), strict=True):
        if len(at):
            k = int(doc[at[0]])
            n = int(sizes[k])
            out[k] = runs_of(squares(at - edge[k], classes, n, base, n // times), base, least, times)
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for a, n, q in runs:
        depth[a + q] += 1
        depth[a + n] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exponent; ties to the smaller start, then the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def cycled(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text, of one id in ten from some word on a cycle, as the registered query plants them: of h, the
    crc32 of the id's decimal form, the last digit picks and the others set where and how long. No id: unchanged."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed) for every row of docs: all maximal
    stretches of words with smallest period q and at least max(least, times * q) words; start, length and period are
    those of the strongest, runs lists all by start and period, collapsed is the text with each run cut to its first
    period, single spaces between words.

    ``edit(doc_id, words)`` may change a text's words before; it gets the id as it stands. Nulls: a null text has no
    words, no runs and an empty collapsed text; a null id changes nothing. Rows that repeat are judged each by itself,
    whatever their ids. Texts are read whole, one in a task at a time beyond a few MB, so memory follows the longest.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    if times < 2 or least < 1:
        raise ValueError("a run holds two periods or more")
    names = [f.split()[0] for f in OUT.split(", ")[:7]] + ["runs", "collapsed"]
    kinds = [pa.int64()] * 7 + [_RUNS, pa.string()]

    def run(batches):
        for whole in batches:
            for b in portions(whole, 1):
                ids = b.column(0).to_pylist()
                texts = [(t.as_py() or b"").split() for t in b.column(1).cast(pa.large_binary())]
                if edit is not None:
                    texts = [edit(i, t) for i, t in zip(ids, texts, strict=True)]
                rows = []
                for i, words, runs in zip(ids, texts, batch_runs(texts, least, times), strict=True):
                    best = strongest(runs) or (None, None, None)
                    milli = 1000 * best[1] // best[2] if runs else None
                    listed = [{"start": a, "length": n, "period": q} for a, n, q in runs]
                    rows.append((i, len(words), len(runs), *best, milli, listed, collapsed(words, runs).decode()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def runs_text(runs: Column) -> Column:
    """All runs as lines ``start,length,period``, each ended by a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
