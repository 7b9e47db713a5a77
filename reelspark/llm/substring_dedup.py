"""Substring dedup on words: prefix-partitioned suffix trees.

The suffixes of all texts that stand at anchors (see anchors; every window holds one, and equal windows hold it at
the same place) are split by their prefixes, the anchors' words. Prefixes vary in length: a group of suffixes that
doesn't fit ``room`` is split by suffixes of prefixes twice as long, up to the whole window. A memory-sized group's
suffixes are made into a suffix tree, and what precedes each of them, read backwards, into another. A window that
begins ``l`` words before an anchor stands in several places where its suffix has a deep inner node, at a depth of
at least ``window - l`` words, whose leaves also share a node of depth ``l`` backwards: these leaves are the places
of a repeat, and it is maximal where its windows follow each other without a gap. Words are compared, not hashed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import BASE_WORD, cut, gram_hashes, keyed, merged, removed, word_bounds, word_hashes, word_runs
from .common import portions, ship, trim

ship(__name__)


class SuffixTree:
    """The tree of rows of symbols, the suffixes of one group or of several (the first symbol is then the group).

    depth and parent are those of the inner nodes, the root being 0; leaf[i] is the inner node above row i. Rows that
    are equal throughout hang on one node.
    """

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        text = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel()
        self.order = np.argsort(text, kind="stable")
        ranked = rows[self.order]
        differ = ranked[1:] != ranked[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width).tolist()
        depth, parent, above = [0], [-1], [0] * n
        path = [0]  # from the root to the node of the last leaf
        for k, d in enumerate(shared):
            last = -1
            while depth[path[-1]] > d:
                last = path.pop()
            if depth[path[-1]] < d:  # a new node, above the one just left or, if there's none, above leaf k
                depth.append(d)
                parent.append(path[-1])
                path.append(len(depth) - 1)
                if last >= 0:
                    parent[last] = path[-1]
                else:
                    above[k] = path[-1]
            above[k + 1] = path[-1]
        self.depth, self.parent = np.array(depth), np.array(parent)
        self.leaf = np.empty(n, np.int64)
        self.leaf[self.order] = above

    def nodes_at(self, nodes: np.ndarray, least: int) -> np.ndarray:
        """For each node the highest one on its way to the root that is at least so deep (itself, if none is)."""
        while True:
            up = self.parent[nodes]
            higher = (up >= 0) & (self.depth[up] >= least)
            if not higher.any():
                return nodes
            nodes = np.where(higher, up, nodes)


def words_slice(window: int):
    def of(text: bytes):
        starts, ends = word_bounds(np.frombuffer(text, np.uint8))
        return lambda start, n: text[starts[start] : ends[start + n + window - 2]]

    return of


def places(bodies: list[bytes], keys: list[int], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all bodies' words from 1 on, each body's first word with the end of the last, and body and word number
    of every occurrence of a body's anchor)."""
    data = np.frombuffer(b" ".join(bodies), np.uint8)
    starts, ends = word_bounds(data)
    names: dict[bytes, int] = {}
    split = [b.split() for b in bodies]
    ids = np.array([names.setdefault(w, len(names) + 1) for b in split for w in b], np.int64)
    edge = np.cumsum([0] + [len(b) for b in split])
    grams = gram_hashes(word_hashes(data, starts, ends), gram, BASE_WORD).view(np.int64)
    owner = np.repeat(np.arange(len(bodies)), np.diff(edge))[: len(grams)]
    at = np.flatnonzero((grams == np.array(keys, np.int64)[owner]) & (np.arange(len(grams)) + gram <= edge[owner + 1]))
    return ids, edge, owner[at], at


def repeats(g: dict[str, list], window: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each class of whole groups (v, k1, body): its windows that a class of smaller k1 also holds, as intervals."""
    ids, edge, body, at = places(g["body"], g["v"], gram)
    groups = np.unique(np.array(g["v"], np.int64), return_inverse=True)[1]
    # a window's anchor is its first: those from the place before it, where there is one, on
    first = np.maximum(edge[body], at + gram - window)
    same = np.flatnonzero(body[1:] == body[:-1]) + 1
    first[same] = np.maximum(first[same], at[same - 1] + 1)
    last = np.minimum(at, edge[body + 1] - window)
    some = first <= last
    body, at, first, last = body[some], at[some], first[some], last[some]
    padded = np.concatenate([ids, np.zeros(window, np.int64)])
    ahead = padded[at[:, None] + np.arange(window)]
    ahead[at[:, None] + np.arange(window) >= edge[body + 1][:, None]] = 0
    behind = at[:, None] - 1 - np.arange(window - gram)
    before = np.where(behind >= edge[body][:, None], ids[np.maximum(behind, 0)], 0)
    group = groups[body][:, None] + 1
    right, left = SuffixTree(np.hstack([group, ahead])), SuffixTree(np.hstack([group, before]))
    rank = np.array(g["k1"], np.int64)[body]
    found = []
    right_at, left_at = right.leaf, left.leaf
    deepest_left = left.leaf
    for back in range(window - gram + 1):  # windows that begin so many words before their anchor
        some = np.flatnonzero((at - back >= first) & (at - back <= last))
        right_at = right.nodes_at(right_at, window - back + 1)
        some = some[right.depth[right_at[some]] >= window - back + 1]  # in a deep inner node: several suffixes
        some = some[left.depth[deepest_left[some]] >= back + 1]
        if not len(some):
            continue
        left_at = left.nodes_at(deepest_left[some], back + 1)
        pair = right_at[some] * np.int64(len(left.depth)) + left_at
        order = np.lexsort((rank[some], pair))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(pair[order]) != 0
        least = rank[some][order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        hit = some[order][least < rank[some][order]]
        found.append((body[hit], at[hit] - back))
    out: list[list[tuple[int, int]]] = [[] for _ in g["body"]]
    if found:
        owner, start = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        new = np.ones(len(owner), bool)
        new[1:] = (np.diff(owner) != 0) | (np.diff(start) != 1)
        lo = np.flatnonzero(new)
        for a, n in zip(lo.tolist(), np.diff(np.append(lo, len(owner))).tolist(), strict=True):
            s = int(start[a] - edge[owner[a]])
            out[owner[a]].append((s, s + n))
    return out


def _search(window: int):
    def search(g, gram):
        for v, h, copies, body, x in zip(g["v"], g["h"], g["copies"], g["body"], repeats(g, window, gram), strict=True):
            if x or copies > 1:  # a leaf of several copies is itself a node where all its windows repeat
                yield v, h, x, [(0, len(body.split()) - window + 1)] if copies > 1 else []

    return search


def _cut(window: int):
    def run(batches):
        kinds, names = (pa.int64(), pa.string(), pa.int64(), pa.int64()), ["doc_id", "text", "n_words", "n_removed"]
        for whole in batches:
            for b in portions(whole, 3):
                out: list[list] = [[] for _ in names]
                for i, text, gone in zip(b.column(2).to_pylist(), b.column(3).cast(pa.large_binary()), b.column(4), strict=True):
                    words, gone, n = (text.as_py() or b"").split(), gone.as_py(), 0
                    total = len(words)
                    if gone:
                        at, kept = 0, []
                        for a, z in merged([(x["a"], x["b"] + window - 1) for x in gone]):
                            kept += words[at:a]
                            at = z
                        words = kept + words[at:]
                        n = total - len(words)
                    for to, x in zip(out, (i, b" ".join(words).decode(), total, n), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
        trim()

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 10, room: int = 1 << 17, batch: int = 1 << 20) -> DataFrame:
    """(doc_id, text, n_words, n_removed) for every row of docs: its words joined by a space, without those of
    windows that also start in a document of smaller id.

    Nulls: a null or empty text has no words; a null id is neither smaller than another nor are others smaller
    than it. Rows that share an id don't remove from each other. Very long texts are read in stretches, whole. Other
    columns are ignored, whatever their names. An empty table gives no rows. gram: the shortest prefix, in words;
    room: the bytes of a group beyond which its prefixes grow.
    """
    base = keyed(docs, id_col, text_col)
    named = base.where("doc_id is not null")
    gone = removed(named, word_runs, words_slice(window), _search(window), window, gram, True, room, batch)
    return cut(base, gone, _cut(window), "doc_id long, text string, n_words long, n_removed long")
