"""A stored inverted index: posting lists in segments, searched without looking at the texts.

A segment holds the words of some files, cut into shards of about SHARD files by a hash of their ids. Within a shard files have
ordinals, and each of its tokens has one row with the sorted list of its occurrences, one number each: ordinal, then
field, then position. Rows lie sorted by token in small row groups, so a search reads those of its own tokens. All a file's
words are in one segment, so a query is decided shard by shard, by intersecting sorted lists: the shorter list
gallops through the longer; a phrase is the intersection of its words' lists, each moved back by its place.

Changed files go to a new segment, and a tombstone each says that older segments don't count for them. Segments of like
size are merged, as many at a time as FAN, so there are about FAN times the logarithm of all files.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INDEXED
from ..session import checkpointed
from ..sources.store import Snapshot, Transaction
from .fulltext import MARKED, PLAIN, Parser, Phrase, QuerySyntaxError, phrases_of, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Files of a shard, about, and bytes of their texts; segments of like size that are merged; bytes of a row group; bytes of
#: lists that a task of a merge holds before it gives them on as blocks.
SHARD, SHARD_BYTES, FAN, ROW_GROUP, BLOCK = 4096, 32 << 20, 4, 4 << 20, 16 << 20
#: Bits of a position, and of position and field together.
POS, PLACE = 32, 40
POSTINGS = "segment int, shard int, token string, places array<long>"
FILES = "segment int, shard int, files array<string>"
DEAD = "file_id string, segment int"
LISTS = "shard int, token string, places array<long>"
FOLD = str.maketrans(MARKED, PLAIN)


class TextIndex:
    """The index's tables in a store: postings, the files of each shard, and tombstones, in parts by segment."""

    def __init__(self, name: str = "fts"):
        self.postings, self.files, self.dead = name, f"{name}_files", f"{name}_dead"

    # ---- upkeep

    def add(self, t: Transaction, videos: DataFrame) -> int:
        """A new segment with the words of videos, whole rows; what older segments hold of these files is dead. Its number."""
        segment = max(t.parts(self.files), default=0) + 1
        columns = [c for c in INDEXED if c in videos.columns]
        size = reduce(Column.__add__, (F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in columns))
        ids = videos.where("file_id is not null").groupBy("file_id").agg(F.sum(size).alias("size"))
        ids = checkpointed(ids)
        n, size = ids.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        shard = F.pmod(F.xxhash64("file_id"), F.lit(max(1, -(-n // SHARD), -(-size // SHARD_BYTES)))).cast("int")
        listed = checkpointed(ids.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list("file_id")).alias("files")))
        # whole texts are dealt once; words are only lists within a shard, never rows
        dealt = videos.where("file_id is not null").select(shard.alias("shard"), "file_id", *columns).repartition("shard").sortWithinPartitions("shard")
        rows = dealt.select("shard", "file_id", *(words_of(F.col(c)).alias(c) for c in columns)).groupBy("shard").applyInArrow(postings_of, LISTS)
        return self._put(t, segment, listed, rows, ids.select("file_id", F.lit(segment - 1).alias("segment")) if segment > 1 else None)

    def _put(self, t: Transaction, segment: int, listed: DataFrame, rows: DataFrame, dead: DataFrame | None) -> int:
        """rows: (shard, token, places). A task's shards lie together, sorted by token, so pages that lack a token are skipped."""
        options = {"parquet.block.size": ROW_GROUP, "parquet.page.size": ROW_GROUP // 64, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
        rows = rows.sortWithinPartitions("token", "shard")
        t.put_part(self.postings, segment, rows.select(F.lit(segment).alias("segment"), "shard", "token", "places"), **options)
        t.put_part(self.files, segment, listed.select(F.lit(segment).alias("segment"), "shard", "files"))
        if dead is not None:
            t.put_part(self.dead, segment, dead)
        return segment

    def remove(self, t: Transaction, ids: DataFrame) -> None:
        """Tombstones for files (file_id), in all segments there are."""
        last = max(t.parts(self.files), default=0)
        if last:
            spark = ids.sparkSession
            t.put_part(self.files, last + 1, spark.createDataFrame([], FILES))
            t.put_part(self.postings, last + 1, spark.createDataFrame([], POSTINGS))
            t.put_part(self.dead, last + 1, ids.select("file_id", F.lit(last).alias("segment")))

    def backfill(self, t: Transaction, videos: DataFrame) -> int:
        """A segment of the files that no segment holds; how many there were."""
        held = self._live(t).select("file_id")
        lack = checkpointed(videos.join(held, "file_id", "left_anti").select("file_id"))
        n = lack.count()
        if n:
            self.add(t, videos.join(lack, "file_id", "left_semi"))
        return n

    def settle(self, t: Transaction, fan: int = FAN) -> int:
        """Merge segments of like size until there are less than ``fan`` of any size; how many merges."""
        merges = 0
        while True:
            sizes = {s: 0 for s in t.parts(self.files)}
            listed = t.read(self.files, T.StructType.fromDDL(FILES))
            sizes |= {r.segment: r.n for r in listed.groupBy("segment").agg(F.sum(F.size("files")).alias("n")).collect()}  # a row a segment
            tiers: dict[int, list[int]] = {}
            for s, n in sizes.items():
                tiers.setdefault(max(n, 1).bit_length() // fan.bit_length(), []).append(s)
            some = next((x for _, x in sorted(tiers.items()) if len(x) >= fan), None)
            if some is None:
                return merges
            # a tombstone counts for all segments up to its own, so a merge takes neighbours in age along
            self.merge(t, [s for s in sizes if min(some) <= s <= max(some)])
            merges += 1

    def merge(self, t: Transaction, segments: list[int]) -> None:
        """One segment, in place of the newest, of the live words of neighbouring segments. Old shards are put together whole,
        so lists are appended to each other and never taken apart into words."""
        last = max(segments)
        held = t.read(self.files, T.StructType.fromDDL(FILES), segments).select("segment", "shard", F.size("files").alias("held"))
        live = checkpointed(self._live(t, segments).groupBy("segment", "shard").agg(F.sort_array(F.collect_list("ordinal")).alias("live"), F.count("*").alias("n")))
        # a new shard is a few of them: about SHARD live files, of four times as many at most, and SHARD_BYTES of lists
        sizes = held.join(live.select("segment", "shard", "n"), ["segment", "shard"])
        counts = sizes.agg(F.sum("n"), F.sum("held"), F.count("*")).first()
        shards = min(counts[2], max(1, -(-(counts[0] or 0) // SHARD), -(-(counts[1] or 0) // (4 * SHARD)), -(-t.size(self.postings, segments) // SHARD_BYTES)))
        order = Window.orderBy(F.desc("n"), "segment", "shard")  # a row a shard, not a file
        to = (F.row_number().over(order) - 1) % F.lit(max(1, shards))
        placed = checkpointed(sizes.select("segment", "shard", to.cast("int").alias("to")))
        named = t.read(self.files, T.StructType.fromDDL(FILES), segments).join(live, ["segment", "shard"]).join(placed, ["segment", "shard"])
        parts = named.groupBy("to").agg(F.sort_array(F.collect_list(F.struct("segment", "shard", "live", F.transform("live", lambda i: F.get("files", i)).alias("files")))).alias("parts"))
        parts = checkpointed(parts)
        listed = parts.select(F.col("to").alias("shard"), F.flatten("parts.files").alias("files"))
        moves = parts.select("to", F.explode("parts").alias("p")).select("to", "p.segment", "p.shard", "p.live")
        lists = t.read(self.postings, T.StructType.fromDDL(POSTINGS), segments).join(F.broadcast(placed), ["segment", "shard"]).select("to", "segment", "shard", "token", "places")
        blocks = lists.mapInArrow(blocked, "to int, block binary")  # most lists have one place, so rows of their own would be shuffled at several times their size
        rows = blocks.groupBy("to").cogroup(moves.groupBy("to")).applyInArrow(appended, LISTS)
        older = [s for s in t.parts(self.files) if s < min(segments)]
        dead = None
        if older and self.dead in t.tables:  # tombstones that older segments still need
            dead = checkpointed(t.read(self.dead, buckets=segments).groupBy("file_id").agg(F.max("segment").alias("segment")))
            dead = dead.select("file_id", F.least("segment", F.lit(max(older))).alias("segment"))
        listed = checkpointed(listed)
        for name in (self.postings, self.files, self.dead):
            if name in t.tables:
                t.drop_parts(name, segments)
        self._put(t, last, listed, rows, dead)

    # ---- search

    def _live(self, t: Snapshot, segments: list[int] | None = None) -> DataFrame:
        """(file_id, segment, shard, ordinal) of the files that segments hold and no tombstone covers."""
        listed = t.read(self.files, T.StructType.fromDDL(FILES), segments)
        rows = listed.select("segment", "shard", F.posexplode("files").alias("ordinal", "file_id"))
        return self._without_dead(t, rows)

    def _without_dead(self, t: Snapshot, rows: DataFrame) -> DataFrame:
        if self.dead not in t.tables:
            return rows
        dead = t.read(self.dead).groupBy("file_id").agg(F.max("segment").alias("until"))
        kept = rows.join(dead, "file_id", "left").where(F.col("until").isNull() | (F.col("segment") > F.col("until")))
        return kept.select(*rows.columns)

    def tokens(self, t: Snapshot) -> DataFrame:
        """(token, n, files): occurrences of every token in live files, and how many hold it. A file is live in one shard, so
        the shards' counts add up."""
        lists = t.read(self.postings, T.StructType.fromDDL(POSTINGS))
        if self.dead in t.tables:
            listed = t.read(self.files, T.StructType.fromDDL(FILES)).select("segment", "shard", F.size("files").alias("held"))
            live = self._live(t).groupBy("segment", "shard").agg(F.collect_list("ordinal").alias("live"))
            some = listed.join(live, ["segment", "shard"], "left").where("live is null or size(live) < held")
            bits = some.select("segment", "shard", "held", F.coalesce("live", F.array().cast("array<int>")).alias("live")).mapInArrow(bitmaps, "segment int, shard int, live binary")
            lists = lists.join(F.broadcast(bits), ["segment", "shard"], "left")  # a bit a file
        else:
            lists = lists.withColumn("live", F.lit(None).cast("binary"))
        counts = lists.select("token", "places", "live").mapInArrow(counted, "token string, n long, files long")
        return counts.where("n > 0").groupBy("token").agg(F.sum("n").alias("n"), F.sum("files").alias("files"))

    def search(self, t: Snapshot, query: str) -> DataFrame:
        """(file_id) of the live files that a query finds; QuerySyntaxError for one that can't be read."""
        if not query.strip():
            raise QuerySyntaxError("an empty query")
        tree = Parser(query).parse()
        wanted, begins = set(), set()
        for p in phrases_of(tree, []):
            for k, w in enumerate(p.words):
                (begins if p.prefix and k == len(p.words) - 1 else wanted).add(w)
        tests: list[Column] = [F.col("token").isin(sorted(wanted))] if wanted else []
        tests += [F.col("token").startswith(w) for w in sorted(begins)]
        rows = t.read(self.postings, T.StructType.fromDDL(POSTINGS)).where(reduce(Column.__or__, tests, F.lit(False)))

        def decide(table: pa.Table) -> pa.Table:
            lists = {w: np.asarray(x.values) for w, x in zip(table.column("token").to_pylist(), table.column("places").combine_chunks(), strict=True)}
            hits = decided(tree, lists)
            key = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("segment", "shard")}
            return pa.table(key | {"hits": pa.array([hits.tolist()], pa.list_(pa.int32()))})

        hits = rows.groupBy("segment", "shard").applyInArrow(decide, "segment int, shard int, hits array<int>")
        listed = t.read(self.files, T.StructType.fromDDL(FILES)).join(hits, ["segment", "shard"])
        found = listed.select("segment", F.explode(F.transform("hits", lambda i: F.get("files", i))).alias("file_id"))
        return self._without_dead(t, found).select("file_id")


def folded_lists(shards: pa.Array | int, tokens: list[str], codes: np.ndarray, places: np.ndarray) -> pa.Table:
    """(shard, token, places): the places of each token, rising; codes: the token of each place."""
    order = np.lexsort((places, codes))
    codes, places = codes[order], places[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    ends = np.append(starts, len(codes)).astype(np.int32)
    names = pa.array([tokens[c] for c in codes[starts].tolist()], pa.string())
    return pa.table([pa.array(np.full(len(starts), shards, np.int32)), names, pa.ListArray.from_arrays(pa.array(ends), pa.array(places))], names=["shard", "token", "places"])


def coded(words: pa.ChunkedArray | pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct tokens and the place among them of each; accents are folded here, once a distinct word."""
    held = words.combine_chunks().dictionary_encode() if isinstance(words, pa.ChunkedArray) else words.dictionary_encode()
    held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    known: dict[str, int] = {}
    to = np.array([known.setdefault(w.translate(FOLD), len(known)) for w in held.dictionary.to_pylist()], np.int64)
    return list(known), to[held.indices.to_numpy(zero_copy_only=False)] if len(to) else np.zeros(0, np.int64)


def postings_of(table: pa.Table) -> pa.Table:
    """A shard's lists. table: (shard, file_id, and the words of each column, with empty ones); ordinals are places among the
    file ids, sorted."""
    shard = table.column("shard")[0].as_py()
    ids = table.column("file_id").to_pylist()
    ordinal = {x: i for i, x in enumerate(sorted(set(ids), key=str.encode))}
    ordinals = np.array([ordinal[x] for x in ids], np.int64)
    texts, places = [], []
    for c in table.column_names[2:]:
        column = table.column(c)
        if column.null_count == len(column):
            continue
        sizes = np.nan_to_num(pc.list_value_length(column).to_numpy().astype(float)).astype(np.int64)
        words = pc.list_flatten(column)
        full = pc.not_equal(words, "").to_numpy().astype(bool)
        row = np.repeat(np.arange(len(sizes)), sizes)[full]
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        pos = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        texts += words.filter(pa.array(full)).chunks
        places.append((ordinals[row] << PLACE) + (INDEXED.index(c) << POS) + pos)
    tokens, codes = coded(pa.chunked_array(texts, pa.string()))
    return folded_lists(shard, tokens, codes, np.concatenate([np.zeros(0, np.int64), *places]))


def blocked(batches):
    """(to, segment, shard, token, places) -> (to, block): the lists of a task that go to the same new shard as compressed Arrow
    tables, places as differences; BLOCK bytes or a batch of them at a time."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def given(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("to")  # stable, so tokens stay in order
        to = table.column("to").to_numpy()
        edges = [*np.flatnonzero(np.diff(to, prepend=-1)).tolist(), len(to)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            some = table.slice(a, b - a).combine_chunks()
            places = pc.list_flatten(some.column("places")).to_numpy()
            counts = pc.list_value_length(some.column("places"))
            sink = pa.BufferOutputStream()
            for part in (some.select(["segment", "shard", "token"]).append_column("n", counts), pa.table({"step": np.diff(places, prepend=0)})):
                with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                    stream.write_table(part)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(to[edges[:-1]], pa.int32()), pa.array(out, pa.binary())], names=["to", "block"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BLOCK:
            yield given(held)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield given(held)


def unblocked(blocks: pa.ChunkedArray) -> tuple[pa.Table, np.ndarray]:
    """What blocked() made into blocks: (segment, shard, token, n) of each list, and the places of all, one list after another."""
    lists, places = [], [np.zeros(0, np.int64)]
    for block in blocks:
        source = pa.BufferReader(block.as_buffer())
        lists.append(pa.ipc.open_stream(source).read_all())
        places.append(np.cumsum(pa.ipc.open_stream(source).read_all().column("step").to_numpy()))
    empty = pa.table({"segment": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "token": pa.array([], pa.string()), "n": pa.array([], pa.int32())})
    return pa.concat_tables([x.cast(empty.schema) for x in lists] or [empty]), np.concatenate(places)


def appended(blocks: pa.Table, moves: pa.Table) -> pa.Table:
    """A new shard's lists, of (to, block) with the live ordinals of each old shard in moves, whose order is that of the
    files."""
    lists, places = unblocked(blocks.column("block"))
    row = np.repeat(np.arange(lists.num_rows), lists.column("n").to_numpy())
    olds = sorted((m["segment"], m["shard"], m["live"]) for m in moves.select(["segment", "shard", "live"]).to_pylist())
    number, now, at, base = {}, [], 0, 0
    for k, (segment, shard, live) in enumerate(olds):
        to = np.full(max(live) + 2, -1, np.int64)
        to[live] = base + np.arange(len(live))
        number[segment, shard] = (at, len(to) - 1)
        now.append(to)
        at, base = at + len(to), base + len(live)
    now = np.concatenate([np.full(1, -1, np.int64), *now])
    known = [number.get(x, (-1, 0)) for x in zip(lists.column("segment").to_pylist(), lists.column("shard").to_pylist(), strict=True)]
    known = np.array(known, np.int64).reshape(-1, 2)[row]
    moved = now[1 + known[:, 0] + np.minimum(places >> PLACE, known[:, 1])]
    tokens, codes = coded(lists.column("token"))
    keep = moved >= 0
    to = moves.column("to")[0].as_py() if moves.num_rows else 0
    return folded_lists(to, tokens, codes[row][keep], (moved[keep] << PLACE) + places[keep] % (1 << PLACE))


def bitmaps(batches):
    """(segment, shard, held, live ordinals) -> a bit a file."""
    for b in batches:
        bits = []
        for held, live in zip(b.column(2).to_pylist(), b.column(3), strict=True):
            on = np.zeros(held, np.uint8)
            on[live.values.to_numpy()] = 1
            bits.append(np.packbits(on, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], names=["segment", "shard", "live"])


def counted(batches):
    """(token, places, live bitmap or null: all) -> how many places are in live files, and in how many of these."""
    for b in batches:
        lists = b.column(1)
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        ordinal = lists.flatten().to_numpy() >> PLACE
        first = (np.diff(row, prepend=-1) != 0) | (np.diff(ordinal, prepend=-1) != 0)
        maps = b.column(2)
        if maps.null_count < len(maps):
            sizes = np.array([len(x) if x is not None else 0 for x in maps.to_pylist()], np.int64)
            held = np.frombuffer(b"".join(x for x in maps.to_pylist() if x), np.uint8)
            starts = (np.cumsum(sizes) - sizes)[row]
            at = np.minimum(starts + (ordinal >> 3), max(len(held) - 1, 0))
            live = (sizes[row] == 0) | (held[at] >> (ordinal & 7) & 1 == 1)
            row, first = row[live], first[live]
        n, files = np.bincount(row, minlength=b.num_rows), np.bincount(row[first], minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(files.astype(np.int64))], names=["token", "n", "files"])


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What two rising lists share: each of the shorter one is sought in the longer one."""
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    if not len(few):
        return few
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    return few[many[at] == few]


def places_of(p: Phrase, lists: dict[str, np.ndarray]) -> np.ndarray:
    """Where a phrase begins, rising."""
    none = np.zeros(0, np.int64)
    parts = []
    for k, w in enumerate(p.words):
        if p.prefix and k == len(p.words) - 1:
            some = [x for token, x in lists.items() if token.startswith(w)]
            held = np.sort(np.concatenate(some)) if some else none
        else:
            held = lists.get(w, none)
        parts.append(held - k)
    if not parts:
        return none
    parts.sort(key=len)  # the rarest word leads
    out = reduce(common, parts)
    if p.column:
        out = out[(out >> POS) % (1 << PLACE - POS) == INDEXED.index(p.column)]
    return out[out % (1 << POS) == 0] if p.first else out


def near_places(near: Phrase, lists: dict[str, np.ndarray]) -> np.ndarray:
    """Places from which each part of a NEAR follows in the same field, with at most ``near.near`` words between."""
    starts = [places_of(p, lists) for p in near.parts]
    if any(not len(s) for s in starts):
        return np.zeros(0, np.int64)
    out = []
    for mine, part in zip(starts, near.parts, strict=True):
        furthest, ok = mine.copy(), np.ones(len(mine), bool)
        for theirs in starts:
            at = np.searchsorted(theirs, mine)
            ok &= at < len(theirs)
            ahead = theirs[np.minimum(at, len(theirs) - 1)]
            ok &= ahead >> POS == mine >> POS
            furthest = np.maximum(furthest, ahead)
        out.append(mine[ok & (furthest - (mine + len(part.words)) <= near.near)])
    return np.sort(np.concatenate(out))


def decided(node, lists: dict[str, np.ndarray]) -> np.ndarray:
    """The ordinals that a query finds in a shard, given its tokens' lists; rising."""
    if isinstance(node, Phrase):
        found = places_of(node, lists) if node.near is None else near_places(node, lists)
        return np.unique(found >> PLACE)
    kind, a, b = node
    left, right = decided(a, lists), decided(b, lists)
    if kind == "or":
        return np.union1d(left, right)
    return common(left, right) if kind == "and" else left[~np.isin(left, right, assume_unique=True)]
