"""From raw documents to packed sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of documents, and carry further columns along whatever their names. In every stage a null text counts as one
without words, texts of any length are read whole, rows that repeat or share an id are judged each by its own text
unless the stage says otherwise, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontam, line_dedup, near_copies, packing, toxicity
from reelspark.llm.common import discard, stash
from reelspark.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it is fitted on labelled ones of docs, never on fold 0. Without
    labels all stay. Null and empty texts stay as long as the model doesn't call a text without words toxic."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share, but for the largest id's; n_chars follows the text. A
    null text stays null, a text whose lines all go becomes empty; rows without an id count as one document."""
    out = line_dedup.clean(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies: five-word shingles, Jaccard 0.8 or more, found by
    SimHash and verified, the links that fingerprints miss by the exact join. Null and empty texts are copies of each other; of rows that share the smallest id one stays; rows without an id stay."""
    return near_copies.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, short ones included. Items that are null or empty are held by none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and places there; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier is learned, so SQL can't express the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage has read goes once it is through."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        after = stash(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
