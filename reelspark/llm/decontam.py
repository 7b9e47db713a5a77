"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Only DataFrame functions. Every item's sketch is its bottom-k MinHash: the k smallest of its shingles' hashes.
Items are partitioned by size (powers of two of their shingle count); a partition's largest size gives the
number of shingles a document may miss at the threshold, and k is that plus ``spare``. A document that holds
the wanted share of an item therefore holds at least k minus its misses of the sketch, whichever they are: the
documents' whole shingle sets probe the sketches, so short items are found in documents of any length and no
match is lost. An item of fewer words than a shingle has is a shingle of its own width, and documents are probed
with each width that items have. Candidates are then decided on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Sketch rows up to which the sketches are broadcast (24 bytes each: 6 MB); beyond, the join shuffles.
BROADCAST_ROWS = 250_000
WORD_GAP = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def _runs(words: str | Column, width: int, of) -> Column:
    """Distinct ``of`` of every run of ``width`` neighbours in an array column; none, if it is shorter."""
    w = F.col(words) if isinstance(words, str) else words
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: of(*(F.get(w, i + k) for k in range(width))))
    return F.when(n >= width, F.array_distinct(runs))


def run_hashes(hashes: str, width: int) -> Column:
    """Distinct hashes of the runs of ``width`` neighbours in a column of word hashes."""
    return F.coalesce(_runs(hashes, width, F.xxhash64), F.array().cast("array<long>"))


def by_width(width_column: str, widths: list[int], made) -> Column:
    """made(width) for the width that each row states."""
    out = F.when(F.col(width_column) == widths[0], made(widths[0]))
    for w in widths[1:]:
        out = out.when(F.col(width_column) == w, made(w))
    return out


def sketches(items: DataFrame, width: int, percent: int, spare: int) -> DataFrame:
    """(item_key, width, hash, need): the bottom-k sketch of every item, and how many of its entries a match must
    hold; the width is that of its shingles."""
    rows = items.select("item_key", F.transform(words_of(F.col("item_text")), lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.select("item_key", "h", F.least(F.lit(width), F.size("h")).alias("width")).where("width > 0")
    rows = rows.select("item_key", "width", F.array_sort(by_width("width", [*range(1, width + 1)], lambda w: run_hashes("h", w))).alias("s"))
    n = F.size("s")
    part = F.floor(F.log2(n.cast("double")) + 1e-9)
    largest = F.pow(F.lit(2), part + 1).cast("int") - 1
    misses = lambda size: F.floor(size * (100 - percent) / 100).cast("int")
    k = F.least(n, misses(largest) + spare)
    return rows.select("item_key", "width", F.explode(F.slice("s", 1, k)).alias("hash"), (k - misses(n)).alias("need"))


def contained(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", width: int = 5, percent: int = 80, spare: int = 3,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): every document row and item with at least ``percent`` of the
    item's distinct word shingles in the document.

    Null or empty texts hold no words: such items match nothing, such documents hold nothing. An item of fewer
    than ``width`` words is one shingle of all its words, held by every document with this run of words, however
    long. Repeated rows of either table each give rows; null ids are kept. Empty tables give no rows. Other columns
    are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text"))
    named = items.where("item_text is not null").groupBy("item_text").agg(F.count("*").alias("n"))
    named = named.select(F.sha2("item_text", 256).alias("item_key"), "item_text")
    small = stash(sketches(named, width, percent, spare), "sketches")
    widths = sorted(r.width for r in small.select("width").distinct().collect()) or [width]  # ``width`` rows at most
    probe = small.select("item_key", "width", F.col("hash").alias("s"), "need")
    probe = F.broadcast(probe) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else probe
    hashed = docs.select("doc_id", F.transform(words_of(F.col("doc_text")), lambda w: F.xxhash64(w)).alias("h"))
    shown = run_hashes("h", widths[0]) if len(widths) == 1 else F.concat(*(run_hashes("h", w) for w in widths))
    probes = hashed.select("doc_id", F.explode(shown).alias("s"))
    hits = probes.join(probe, "s").groupBy("doc_id", "item_key", "width").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    found = stash(hits.where("n >= need").select(F.col("doc_id").alias("found_in"), "item_key", "width"), "candidates")
    exact = named.select(F.col("item_key").alias("wanted_key"), "item_text").join(found.select(F.col("item_key").alias("wanted_key"), "width").distinct(), "wanted_key")
    exact = exact.select("wanted_key", shingles_of("item_text", "width", widths).alias("wanted"))
    texts = docs.join(found, docs["doc_id"].eqNullSafe(found["found_in"])).select("doc_id", "item_key", shingles_of("doc_text", "width", widths).alias("held"))
    both = texts.join(exact, F.col("item_key") == F.col("wanted_key")).select(
        "doc_id", "item_key", F.size("wanted").alias("n_shingles"), F.size(F.array_intersect("held", "wanted")).alias("n_found")
    )
    sure = both.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
    ids = items.select("item_id", F.sha2("item_text", 256).alias("item_key"))
    return sure.join(ids, "item_key").select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"))


def shingles_of(text: str, width_column: str, widths: list[int]) -> Column:
    """The distinct shingles of a text column, of the width that the row states; the words are made once, as an
    array's only element."""
    spelled = lambda *words: F.concat_ws(" ", *words)
    one = F.transform(F.array(words_of(F.col(text))), lambda w: by_width(width_column, widths, lambda n: _runs(w, n, spelled)))
    return F.element_at(one, 1)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text contains an item; all columns stay, whatever their names. Rows are told apart
    by id and a hash of the text, so rows that share an id, or have none, are judged each by its own text; rows that
    repeat throughout go or stay together. Null and empty texts contain nothing and stay, as does every row where
    there are no items."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    key = F.struct("id", F.xxhash64("text").alias("k"))
    leaks = contained(rows.select(key.alias("key"), "text"), items, "key", "text", **options)
    leaks = stash(leaks.select(F.col("doc_id.id").alias("leak"), F.col("doc_id.k").alias("leak_k")).distinct(), "leaks")
    kept = rows.join(leaks, F.col("id").eqNullSafe(F.col("leak")) & (F.xxhash64("text") == F.col("leak_k")), "left_anti")
    return kept.select("row.*")
