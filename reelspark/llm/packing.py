"""Best-fit packing by a grouping genetic algorithm, on islands with elite migration.

A chromosome is a packing: a list of bins, each a set of pieces. Crossover injects whole well-filled bins of
one parent into the other, drops the other's bins that hold any of the same pieces, and puts the pieces this
displaces back by best fit. Islands hold a bounded shard of the pieces; several islands work on a shard from
different beginnings, and after each epoch every island's elite moves to the next. What the shards leave in
poorly filled bins is pooled and dealt to islands again.
"""

from __future__ import annotations

import codecs
import json
import os
import random
import re
import sys
from array import array
from bisect import bisect_left, insort
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ship, stash, trim

ship(__name__)

#: Pieces of a shard on average; shards hold a hashed share, so their size is close to this at any input.
SHARD = 3000
MEMO_WORDS = 150_000
#: Texts that take the whole tokenizer: beyond the Latin letters, and at U+0130, lower case and normal form aren't
#: the same everywhere; U+001C to U+001F are white space to some only. So do texts with "<|", which begins added tokens.
ODD = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> str:
    """How byte-level vocabularies write the 256 bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = count(0x100)
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class TokenCounter:
    """Ids of texts, word by word: the tokenizer's splits never cross white space, so every white-space run's
    ids are those it has alone. A bounded memo keeps those of words seen. New plain words are split by the
    tokenizer's own pattern and handed to its model; all others go through the whole tokenizer. Words are plain
    below U+0250: there, a lower-case text is in normal form, and Python's lower case is the tokenizer's."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of a stage share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.splits = self._pattern(json.loads(self.tokenizer.to_str()))
        self.forget()

    @staticmethod
    def _pattern(spec: dict):
        """The pattern of splits of a tokenizer of the kind that the plain way is right for, else None."""
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in cuts]
        if steps != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"] or spec["model"]["type"] != "BPE":
            return None
        first, second = cuts
        if not first["invert"] or first["behavior"] != "Removed" or second["use_regex"] or second["add_prefix_space"]:
            return None
        return regex.compile(first["pattern"]["Regex"])

    @staticmethod
    def of_process(path: str) -> TokenCounter:
        """This worker process's counter: the vocabulary is loaded once. It begins with an empty memo."""
        held = sys.__dict__.setdefault("_reelspark_counters", {})  # outlives the module, which tasks unpickle anew
        if path not in held:
            held[path] = TokenCounter(path)
        held[path].forget()
        return held[path]

    def forget(self) -> None:
        self.plain, self.odd, self.signs = Memo(self.plain_ids), Memo(self.odd_ids), Memo(self.split_ids)

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if self.splits is not None and "<|" not in text and not ODD.search(text):
            self.plain = memo = self.plain.renewed()
            words = text.lower().split()  # as the tokenizer would; fewer different words
        else:
            self.odd = memo = self.odd.renewed()
            # str.split() also splits at U+001C to U+001F, which the tokenizer takes for letters of no kind
            words = text.split(" ") if SEPARATORS.search(text) else text.split()
        return b"".join(map(memo.__getitem__, words))

    def plain_ids(self, word: str) -> bytes:
        """The ids of a lower-case word below U+0250, by the tokenizer's pattern, its spelling of bytes and its model. Most words
        are letters, or letters and one sign, which the pattern always parts from them; the sign's ids are remembered."""
        head = word if word.isalpha() else word[:-1]
        if not head.isalpha():
            return self.split_ids(word)
        ids = array("I", [t.id for t in self.model.tokenize(head if head.isascii() else self.spelled(head))]).tobytes()
        return ids if head is word else ids + self.signs[word[-1]]

    def split_ids(self, word: str) -> bytes:
        parts = (x if x.isascii() and x.isprintable() else self.spelled(x) for x in self.splits.findall(word))
        return array("I", [t.id for x in parts for t in self.model.tokenize(x)]).tobytes()

    def spelled(self, word: str) -> str:
        return codecs.charmap_decode(word.encode(), "strict", self.letters)[0]

    def odd_ids(self, word: str) -> bytes:
        """The ids of any word, by the whole tokenizer."""
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


class Memo(dict):
    """Words' ids, made when first asked for. Once MEMO_WORDS are held, a new memo begins that takes back from this one
    the words that go on turning up; so at most twice as many are held."""

    def __init__(self, make, older: dict | None = None):
        super().__init__()
        self.make, self.older = make, older or {}

    def __missing__(self, word: str) -> bytes:
        held = self.older.get(word)
        self[word] = held = self.make(word) if held is None else held
        return held

    def renewed(self) -> Memo:
        if len(self) <= MEMO_WORDS:
            return self
        self.older = {}
        return Memo(self.make, self)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids with ``end`` after them, cut at size."""

    def run(batches):
        counter, tail = TokenCounter.of_process(tokenizer), np.array([end], "<u4").tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = counter.ids(text.as_py() or "") + tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for to, x in zip(out, (i, k, at // 4, len(part) // 4, crc32(part)), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
        counter.forget()
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], order, bins: list[list[int]], fills: list[int], size: int) -> None:
    """Put the pieces of ``order`` into bins, each into the fullest that has room; opens bins as needed."""
    room = sorted((size - f, k) for k, f in enumerate(fills))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            fills[k] += sizes[i]
            left -= sizes[i]
        else:
            k, left = len(bins), size - sizes[i]
            bins.append([i])
            fills.append(sizes[i])
        if left:
            insort(room, (left, k))


def fresh(sizes: list[int], size: int, noise: float, rng: random.Random) -> list[list[int]]:
    """A packing by best fit, pieces taken by falling size; noise mixes the order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
    bins: list[list[int]] = []
    best_fit(sizes, order, bins, [], size)
    return bins


def fitness(sizes: list[int], bins: list[list[int]], size: int) -> tuple[int, float]:
    """Fewer bins first; of as many, the more uneven fills, which leave one bin close to empty."""
    return -len(bins), sum((sum(sizes[i] for i in b) / size) ** 2 for b in bins)


def crossover(sizes: list[int], one: list[list[int]], two: list[list[int]], size: int, rng: random.Random) -> list[list[int]]:
    """Well-filled bins of ``two`` injected into ``one``; what its duplicates displace is best-fitted again."""
    fill = lambda b: sum(sizes[i] for i in b)
    full = [b for b in two if fill(b) >= 0.98 * size]
    inject = [b for b in full if rng.random() < 0.5] or full[:1]
    taken = {i for b in inject for i in b}
    clean = [b for b in one if taken.isdisjoint(b)]
    placed = taken.union(*clean) if clean else taken
    bins = [list(b) for b in inject + clean]
    displaced = sorted((i for i in range(len(sizes)) if i not in placed), key=lambda i: -sizes[i])
    best_fit(sizes, displaced, bins, [fill(b) for b in bins], size)
    return bins


def mutate(sizes: list[int], bins: list[list[int]], size: int, rng: random.Random) -> list[list[int]]:
    """Empty the least filled bin and a few others, and best-fit their pieces again."""
    ranked = sorted(bins, key=lambda b: sum(sizes[i] for i in b))
    cut = max(2, len(ranked) // 10)
    out = ranked[:1] + rng.sample(ranked[1:], min(cut, len(ranked) - 1))
    gone = {id(b) for b in out}
    keep = [list(b) for b in ranked if id(b) not in gone]
    loose = sorted((i for b in out for i in b), key=lambda i: -sizes[i] * (1 + 0.2 * rng.random()))
    best_fit(sizes, loose, keep, [sum(sizes[i] for i in b) for b in keep], size)
    return keep


def evolve(sizes: list[int], elite: list[list[int]] | None, size: int, seed: int, people: int = 3, generations: int = 4) -> list[list[int]]:
    """The best packing that an island finds. Its people begin apart: the elite that came in, if any, a best fit by
    falling size, and best fits of orders ever more mixed. Each generation crosses the best with another and mutates;
    after the first, the island rests once no packing can have fewer bins."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // size)
    ranked = lambda b: (fitness(sizes, b, size), b)
    rank = lambda x: x[0]
    crowd = [ranked(elite)] if elite else []
    while len(crowd) < people:
        crowd.append(ranked(fresh(sizes, size, 0.3 * len(crowd) * (seed % 7 + 1) / 7, rng)))
    for _ in range(generations):
        crowd.sort(key=rank, reverse=True)
        child = ranked(crossover(sizes, crowd[0][1], rng.choice(crowd[1:])[1], size, rng))
        crowd[-1] = max(child, ranked(mutate(sizes, child[1], size, rng)), key=rank)
        if -max(map(rank, crowd))[0] <= least:
            break
        crowd[-2] = ranked(mutate(sizes, crowd[0][1], size, rng)) if people > 2 else crowd[-2]
    return max(crowd, key=rank)[1]


def _islands(shards: DataFrame, size: int, islands: int, epochs: int) -> DataFrame:
    """(key, length, shard, bin), written: each shard's best packing. shards: (key, length, shard)."""

    def live(epoch: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key"], kind="stable").reset_index(drop=True)
            sizes = pdf["length"].tolist()
            elite = None
            if epoch:
                bins = pdf["bin"].to_numpy()
                order = np.argsort(bins, kind="stable")
                elite = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)]
            island, shard = int(pdf["island"].iloc[0]), int(pdf["shard"].iloc[0])
            bins = evolve(sizes, elite, size, shard * 1009 + island * 101 + epoch)
            at = np.empty(len(pdf), np.int64)
            for k, b in enumerate(bins):
                at[b] = k
            score = fitness(sizes, bins, size)
            pdf["bin"], pdf["bins"], pdf["score"] = at, -score[0], score[1]
            return pdf[["key", "length", "shard", "island", "bin", "bins", "score"]]

        return run

    shape = "key long, length long, shard long, island int, bin long, bins long, score double"
    state = shards.select("key", "length", "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0).cast("long").alias("bin"))
    held = []
    for epoch in range(epochs):
        state = stash(state.groupBy("shard", "island").applyInPandas(live(epoch), shape), "island")
        discard(*held)
        held = [state]
        best = state.groupBy("shard").agg(F.min(F.struct("bins", -F.col("score"), "island")).alias("b"))
        best = best.select(F.col("shard").alias("_shard"), F.col("b.island").alias("elite"))
        state = state.join(best, state["shard"] == best["_shard"])
        if epoch + 1 < epochs:  # the elite moves on: each island goes on from its neighbour's packing
            state = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
    packed = stash(state.where(F.col("island") == F.col("elite")).select("key", "length", "shard", "bin"), "packed")
    discard(*held)
    return packed


def pack(cut: DataFrame, size: int = 4096, shard: int = SHARD, islands: int = 2, epochs: int = 2, pools: int = 3, good: float = 0.995) -> DataFrame:
    """cut (of pieces()) with (sequence_id, offset): pieces packed into sequences of at most ``size`` ids.

    A piece of full size is a sequence of its own. After each pool but the last, bins filled under ``good``
    are opened and their pieces dealt anew, until they fit one shard. An empty table gives no rows.
    """
    cut = stash(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")
    lone = cut.where(F.col("length") >= size).select("key", F.lit(-1).cast("long").alias("pool"), F.lit(-1).cast("long").alias("shard"), F.col("key").alias("bin"))
    loose, done = cut.where(F.col("length") < size).select("key", "length"), lone
    for pool in range(pools):
        count = loose.count()
        if not count:
            break
        shards = -(-count // shard)
        dealt = loose.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(pool)), F.lit(shards)))
        packed = _islands(dealt, size, islands, epochs)
        last = shards == 1 or pool == pools - 1
        fills = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill")).where(F.lit(last) | (F.col("fill") >= good * size))
        held = stash(packed.join(fills, ["shard", "bin"]).select("key", F.lit(pool).cast("long").alias("pool"), "shard", "bin"), "done")
        done = done.union(held)
        if not last:
            used = loose if pool else None
            loose = stash(packed.join(fills, ["shard", "bin"], "left_anti").select("key", "length"), "loose")
            if used is not None:
                discard(used)
        discard(packed)
        if last:
            break
    placed = cut.join(done, "key")
    here = Window.partitionBy("pool", "shard", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    name = F.min("key").over(Window.partitionBy("pool", "shard", "bin"))
    rows = placed.withColumn("offset", F.coalesce(F.sum("length").over(here), F.lit(0))).withColumn("sequence_id", name)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end: int = 1) -> DataFrame:
    """All rows of docs packed: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) a piece.

    A null or empty text is the end id alone. Null ids and repeated rows are packed row by row. A text of any length
    is encoded whole and cut at ``size`` ids. Other columns are ignored, whatever their names. An empty table gives no
    rows.
    """
    return pack(pieces(docs, tokenizer, id_col, text_col, size, end), size)
