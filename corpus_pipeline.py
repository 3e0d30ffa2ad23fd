"""The corpus pipeline: documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows may be
written and read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm import exact_dedup, mixing, packing, simhash, toxicity
from kinloom.llm._spark import table, unused_names
from kinloom.sources.tables import delete_path, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Handling of odd input, in all stages: columns beside doc_id, text and source pass through as they
# are, whatever their names; null, empty and very long texts are handled whole, as each operator's
# docstring states; an empty table gives an empty table.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (a score of 0.5 too).

    Null and empty texts are scored like texts without n-grams; repeated rows are judged alike.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside) stays: the longest, then the smallest doc_id.

    Null and empty texts are one group; of rows that repeat doc_id and text any one stays.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays: the smallest doc_id, a null one last.

    Similar are texts that have at least 0.8 of their five-word shingles in common.  Texts without
    words are one group; of rows that repeat a doc_id within a group one stays.
    """
    return simhash.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (or left out) towards temperature weights of their sources.

    A null source is a source; rows that repeat a doc_id are repeated equally often.
    """
    (extra,) = unused_names(docs, "mixed")
    return mixing.mix(docs, into=extra).drop(extra)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mixed documents, one row per piece.

    Null and empty texts are the end token alone; rows that repeat a doc_id are packed each.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: A learned classifier and fingerprints of word hashes cannot be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage keeps is written as Parquet in the shared folder and read again, so a lost
    executor costs no earlier stage, and a later stage reads only the columns it needs.  A stage's
    input is deleted once its output is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
