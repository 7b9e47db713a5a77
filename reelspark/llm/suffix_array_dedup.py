"""Substring dedup on bytes by suffix arrays: deep-shallow sorting.

The suffixes sorted are those at anchors (see anchors): two equal windows hold the same anchor at the same
place, so it is enough to know, for two occurrences of an anchor, how far they agree to the right and to the
left. A group's right contexts are sorted by multikey quicksort (symbols of eight bytes) down to a shallow
depth, and what is still equal there by blind tries; so are the left contexts, reversed. Right neighbours'
common prefixes then join the suffixes from the longest to the shortest, and each one meets its neighbours in
the left order among those that it agrees with so far to the right: no other one agrees further to the left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import BASE_BYTE, byte_runs, cut, gram_hashes, keyed, merged, removed
from .common import portions, ship, trim

ship(__name__)

SYMBOL, SHALLOW = 8, 32


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie(texts: list[bytes], some: list[int]) -> list[int]:
    """``some`` sorted by their texts. A node keeps only its depth and a child for each byte there; a text goes
    down blindly, is compared once with the leaf it reaches, and then placed where they part."""
    root: list = [some[0]]  # a leaf: texts that are all equal; an inner node: (depth, children)
    for i in some[1:]:
        s, path, node = texts[i], [], root
        while isinstance(node, tuple):
            path.append(node)
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        t = texts[node[0]]
        at = common_prefix(s, t)
        if at == len(s) == len(t):
            node.append(i)
            continue
        byte = lambda x: x[at] if at < len(x) else -1  # noqa: B023, E731
        above = [p for p in path if p[0] <= at]
        if above and above[-1][0] == at:
            above[-1][1][byte(s)] = [i]
            continue
        below = path[len(above)] if len(above) < len(path) else node
        new = (at, {byte(t): below, byte(s): [i]})
        if above:
            depth, kids = above[-1]
            kids[s[depth] if depth < len(s) else -1] = new
        else:
            root = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(texts: list[bytes], start: int = 0) -> list[int]:
    """The order of texts that agree up to ``start``: multikey quicksort on symbols of eight bytes to SHALLOW
    bytes further, then blind tries."""
    out: list[int] = []
    stack = [(list(range(len(texts))), start)]
    while stack:
        some, depth = stack.pop()
        if len(some) < 2:
            out.extend(some)
        elif depth >= start + SHALLOW:
            out.extend(blind_trie(texts, some))
        else:
            pivot = texts[some[len(some) // 2]][depth : depth + SYMBOL]
            less, same, more = [], [], []
            for i in some:
                x = texts[i][depth : depth + SYMBOL]
                (less if x < pivot else more if x > pivot else same).append(i)
            stack.append((more, depth))
            stack.append((same, depth + SYMBOL if len(pivot) == SYMBOL else start + SHALLOW))
            stack.append((less, depth))
    return out


def splits(shared: list[int]) -> list[tuple[int, int, int]]:
    """(first, last, place) of the stretches of suffixes, the whole first, each with the place at which its least shared
    prefix parts it: the Cartesian tree of the common prefixes, from the root down."""
    left, right, stack = [-1] * len(shared), [-1] * len(shared), []
    for k, x in enumerate(shared):
        below = -1
        while stack and shared[stack[-1]] > x:
            below = stack.pop()
        left[k] = below
        if stack:
            right[stack[-1]] = k
        stack.append(k)
    out, todo = [], [(0, len(shared), stack[0])] if stack else []
    while todo:
        first, last, k = todo.pop()
        out.append((first, last, k))
        if left[k] >= 0:
            todo.append((first, k, left[k]))
        if right[k] >= 0:
            todo.append((k + 1, last, right[k]))
    return out


def repeats(bodies: list[bytes], places: list[tuple[int, int]], window: int, gram: int) -> dict[int, list[tuple[int, int]]]:
    """For each body: its windows that also start elsewhere, given the places (body, byte) of their anchor.

    Where suffixes part, those of the smaller side are taken out of a list that is linked in the left order, smallest first:
    what then stands before one, and after it once all are out, are its neighbours on the other side. Each suffix
    is taken out as often as the logarithm of their number, at most."""
    right = [bodies[b][p : p + window] for b, p in places]
    left = [bodies[b][max(0, p - window + gram) : p][::-1] for b, p in places]
    order = deep_shallow(right, gram)
    by_rank = deep_shallow(left)
    rank = [0] * len(places)
    for k, i in enumerate(by_rank):
        rank[i] = k
    shared = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    del right
    n = len(places)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    out: dict[int, list[tuple[int, int]]] = {}
    for first, last, k in splits(shared):
        r = shared[k]
        few = range(first, k + 1) if k - first < last - k else range(k + 1, last + 1)
        ranks = sorted([rank[order[j]] for j in few])
        ahead, head = [], -1
        for x in ranks:
            p, q = before[x], after[x]
            ahead.append(p)
            if p >= 0:
                after[p] = q
            else:
                head = q  # at the end, the first of the other side
            if q >= 0:
                before[q] = p
        for x, p in zip(ranks, ahead, strict=True):
            i = by_rank[x]
            for y in (p, after[p] if p >= 0 else head):
                if y >= 0:
                    j = by_rank[y]
                    agree = common_prefix(left[i], left[j])
                    if agree + r >= window:
                        for b, at in (places[i], places[j]):
                            out.setdefault(b, []).append((at - agree, at + r - window + 1))
        for x, y in zip(ranks, ranks[1:], strict=False):
            after[x], before[y] = y, x
        before[ranks[0]] = after[ranks[-1]] = -1
    return {b: merged(x) for b, x in out.items()}


def bytes_slice(window: int):
    return lambda text: lambda start, n: text[start : start + n + window - 1]


def _search(window: int):
    def search(g, gram):
        bodies, v, copies = g["body"], np.array(g["v"], np.int64), g["copies"]
        n = len(bodies)
        data = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64) + np.uint64(1)
        edge = np.cumsum([0] + [len(b) for b in bodies])
        owner = np.repeat(np.arange(n), np.diff(edge))
        h = gram_hashes(data, gram, BASE_BYTE).view(np.int64)
        o = owner[: len(h)]
        at = np.flatnonzero((h == v[o]) & (np.arange(len(h)) + gram <= edge[o + 1]))
        b, p = owner[at], at - edge[owner[at]]
        order = np.argsort(v[b], kind="stable")
        b, p = b[order], p[order]
        ends = np.flatnonzero(np.diff(v[b])) + 1
        for bs, ps in zip(np.split(b, ends), np.split(p, ends), strict=True):
            found = repeats(bodies, list(zip(bs.tolist(), ps.tolist(), strict=True)), window, gram) if len(bs) > 1 else {}
            for i in dict.fromkeys(bs.tolist()):
                if copies[i] > 1:  # a suffix of several copies stands in the array as often: all its windows repeat
                    every = [(0, len(bodies[i]) - window + 1)]
                    yield g["v"][i], g["h"][i], every, every
                elif i in found:
                    yield g["v"][i], g["h"][i], found[i], []

    return search


def _cut(window: int):
    def run(batches):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
        for whole in batches:
            for b in portions(whole, 3):
                out: list[list] = [[] for _ in names]
                for i, text, gone in zip(b.column(2).to_pylist(), b.column(3).cast(pa.large_binary()), b.column(4), strict=True):
                    text, gone = text.as_py() or b"", gone.as_py() or []
                    parts, at = [], 0
                    taken = merged([(x["a"], x["b"] + window - 1) for x in gone])
                    for lo, hi in taken:
                        parts.append(text[at:lo])
                        at = hi
                    parts.append(text[at:])
                    kept = b"".join(parts)
                    for to, x in zip(out, (i, kept, len(text), len(text) - len(kept), len(taken)), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
        trim()

    return run


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = 64, room: int = 1 << 17, batch: int = 1 << 20) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) for every row of docs: its UTF-8 bytes without those
    covered by a window of bytes that also starts anywhere else, the same row included.

    Nulls: a null text is empty; a null id changes nothing, as ids play no part. Each row is a text of its own,
    so a repeated row of at least ``window`` bytes goes entirely. kept may cut through characters, hence
    binary. Very long texts are read in stretches, whole. Other columns are ignored, whatever their names. An empty
    table gives no rows. room: the bytes of a group of suffixes beyond which it is split.
    """
    base = keyed(docs, id_col, text_col)
    gone = removed(base, byte_runs, bytes_slice(window), _search(window), window, gram, False, room, batch)
    return cut(base, gone, _cut(window), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
