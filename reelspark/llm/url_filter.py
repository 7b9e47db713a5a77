"""URL filters: a blocked Bloom filter of the listed rules lets possible hits through to an exact hash join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ship, stash

ship(__name__)

#: (host, path, verdict) of the contract's rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, in ASCII lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class BlockedBloom:
    """A Bloom filter of 64-bit blocks: a key sets four bits of one block. The size is fixed by ``bits``
    (2^23, one megabyte, at most), however many keys it takes; more keys only mean more possible hits."""

    def __init__(self, keys: int, most: int = 1 << 23, words: np.ndarray | None = None):
        self.words = np.zeros(max(1, min(most, 1 << max(6, (16 * keys - 1).bit_length())) >> 6), np.uint64) if words is None else words

    def _at(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(key)
        return (h >> 24) % len(self.words), 1 << (h & 63) | 1 << (h >> 6 & 63) | 1 << (h >> 12 & 63) | 1 << (h >> 18 & 63)

    def add(self, key: bytes) -> None:
        block, mask = self._at(key)
        self.words[block] |= np.uint64(mask)

    def __contains__(self, key: bytes) -> bool:
        block, mask = self._at(key)
        return int(self.words[block]) & mask == mask


def rule_key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode()


def _build(rules: DataFrame):
    """The filter and the path lengths that rules have, made on the executors part by part and OR-ed together."""
    n = rules.count()

    def part(batches):
        bloom, sizes = BlockedBloom(n), set()
        for b in batches:
            for host, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bloom.add(rule_key(host, path))
                sizes.add(len(path))
        yield pa.RecordBatch.from_arrays([pa.array([bloom.words.tobytes()]), pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["words", "sizes"])

    bloom, sizes = BlockedBloom(n), set()
    few = rules.select("host", "path").coalesce(8)  # eight parts of a megabyte at most
    for row in few.mapInArrow(part, "words binary, sizes array<int>").collect():
        bloom.words |= np.frombuffer(bytes(row.words), np.uint64)
        sizes |= set(row.sizes)
    return bloom, sorted(sizes)


def possible(urls: DataFrame, bloom, sizes) -> DataFrame:
    """(host, path, rule_host, rule_path): for each (host, path) the rule keys that the filter lets through."""
    held = urls.sparkSession.sparkContext.broadcast((bloom.words, sizes))  # plain arrays: executors have no copy of the package

    def run(batches):
        words, sizes = held.value
        bloom = BlockedBloom(0, words=words)
        for b in batches:
            out: list[list[str]] = [[], [], [], []]
            for host, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                labels = host.split(".")
                for i in range(len(labels)):
                    tail = ".".join(labels[i:])
                    for n in sizes:
                        if n > len(path):
                            break
                        if rule_key(tail, path[:n]) in bloom:
                            for to, x in zip(out, (host, path, tail, path[:n]), strict=True):
                                to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["host", "path", "rule_host", "rule_path"])

    return urls.mapInArrow(run, "host string, path string, rule_host string, rule_path string")


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest host and path win.
    Null urls and urls without :// have an empty host and path, fit no rule and get the default. Only distinct
    (host, path) go through filter and join, so a url that a third of all rows hold costs one. Repeated rows
    each give a row; other columns are ignored. rules: (host, path, verdict); repeated (host, path): the least
    verdict holds.
    """
    spark = pages.sparkSession
    rules = rules if rules is not None else spark.createDataFrame(RULES, "host string, path string, verdict string")
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rules = stash(rules, "rules")
    hits = possible(rows.groupBy("host", "path").agg(F.count("*").alias("n")).select("host", "path"), *_build(rules))
    exact = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("found"))
    matched = hits.join(exact, ["rule_host", "rule_path"])
    size = F.length("rule_host") + F.length("rule_path")
    best = matched.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "found"), F.struct(size, F.length("rule_host"))).alias("best")
    )
    best = stash(best, "matches").hint("merge")  # grows with the pages, and its files' size says little of its size in memory
    joined = rows.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.found", F.lit(default)).alias("verdict"))
