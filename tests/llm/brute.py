"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

import xxhash


def simhash(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(prints, most=2):
    """Component of each index, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def substring_dedup(rows, window):
    """(doc_id, text) rows -> [(doc_id, n_words, kept words)]."""
    first = {}
    split = [(i, (t or "").encode()) for i, t in rows]
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", t)) for i, t in split]
    for i, words in split:
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if i is not None and first[w] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(words), b" ".join(w for k, w in enumerate(words) if k not in gone).decode(), len(gone)))
    return out


def suffix_dedup(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = defaultdict(int)
    for _, t in texts:
        for p in range(len(t) - window + 1):
            count[t[p : p + window]] += 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if count[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, bytes(c for c, g in zip(t, gone, strict=True) if not g), len(t), sum(gone), spans))
    return out
