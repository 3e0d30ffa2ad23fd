"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.operators.skew import checkpointed, lookup, quoted, unused_names
from kinloom.sources.tables import scratch_path

__all__ = ["checkpointed", "held_out", "learning_rows", "lookup", "quoted", "table", "unused_names", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a checkpoint for large tables, column by column and compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id) -> F.Column:
    """True for the rows that no model learns from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y) of about ``limit`` labelled documents that are not held out, as a checkpoint.

    The documents are picked by a hash of their id, so the choice is the same at any partitioning.
    A document labelled more than once counts with its largest label; null labels count as none.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    )
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < 1_000_000 * limit // n)
    # at most about `limit` small rows: a proven bound, so they may be broadcast
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return checkpointed(picked.select("text", "y").repartition(12))
