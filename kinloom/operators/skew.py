"""Rows put aside in the shared folder, and joins in which no single key meets in one task."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key is heavy from 1/HEAVY_SHARE of all rows on, so at most HEAVY_SHARE keys are.
HEAVY_SHARE = 1024
HEAVY_LEAST = 200


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error,
    since executors could not read each other's local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-kinloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Folders of ``cut_lineage`` that are still there: application, folder, and a weak reference to what the plans that read it share.
_HELD: list[tuple[str, str, JavaObject]] = []
#: Rows in memory take about so many times their bytes in a written folder; what is broadcast is decided by that.
IN_MEMORY = 8
_READERS: dict[str, SparkSession] = {}


def _reader(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose plans know that files are compressed, in sizes and in what a task reads; the settings of ``spark`` stay as they are."""
    application = spark.sparkContext.applicationId
    if application not in _READERS:
        _READERS[application] = spark.newSession()
        for key, value in (("spark.sql.sources.fileCompressionFactor", IN_MEMORY), ("spark.sql.files.maxPartitionBytes", "16m"), ("spark.sql.files.openCostInBytes", "512k")):
            _READERS[application].conf.set(key, value)
    return _READERS[application]


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder as compressed Parquet and read from there.

    Order and partitions are not kept.  A folder is deleted when no plan reads it any more, and
    shuffles that only went into a written folder go with it, so that a loop holds the disk of a few
    rounds and not of all.  Rows that Parquet cannot hold (a column without a type) are checkpointed.
    """
    if any(f.dataType.typeName() == "void" for f in df.schema):
        return checkpointed(df)
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/kinloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(folder, compression="zstd")
    plan = _reader(spark).read.schema(df.schema).parquet(folder)._jdf.queryExecution().analyzed()
    location = plan.relation().location()
    rows = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
    _HELD.append((spark.sparkContext.applicationId, folder, spark._jvm.java.lang.ref.WeakReference(location)))
    del location, plan
    release(spark)
    return rows


def release(spark: SparkSession) -> None:
    """Delete what no plan reads any more: folders of ``cut_lineage``, and by Spark's cleaner shuffles and broadcasts."""
    gc.collect(0)
    spark._jvm.System.gc()
    kept = []
    for entry in _HELD:
        application, folder, read_by = entry
        if application != spark.sparkContext.applicationId:
            continue
        if read_by.get() is not None:
            kept.append(entry)
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _HELD[:] = kept


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores behind them as keep them apart from the columns of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it literally, dots included."""
    return "`" + name.replace("`", "``") + "`"


def lookup(rows: DataFrame, entries: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``entries``, which has one row per key, without one key meeting in one task.

    ``entries[weight]`` is the number of ``rows`` with that key.  Keys that hold 1/1024 of all
    rows or more (1024 keys at most, by arithmetic) are broadcast; all others go through an
    ordinary shuffled join, where no key holds more than that share.  ``rows`` is read twice, so
    callers hand in a checkpoint or something as cheap.  Keys must not be null in ``entries``.
    """
    total, most = entries.agg(F.sum(weight), F.max(weight)).first()
    limit = max(HEAVY_LEAST, -(-(total or 0) // HEAVY_SHARE))
    if (most or 0) < limit:
        return rows.join(entries, keys, how)
    heavy = entries.where(F.col(weight) >= limit)
    ids = heavy.select(*keys)
    hot = rows.join(F.broadcast(heavy), keys, "inner")
    rest = rows.join(F.broadcast(ids), keys, "left_anti").join(entries.where(F.col(weight) < limit), keys, how)
    return hot.unionByName(rest)


class Spread:
    """Edges to be joined by ``key`` more than once, with the edges of hubs dealt into parts.

    A hub has 1/1024 of all edges or more (at least 200), so there are at most 1024 hubs with at
    most 2048 parts together: that table may be broadcast.  ``join`` repeats the few rows that
    meet a hub once for each of its parts.
    """

    def __init__(self, edges: DataFrame, key: str):
        self.key = key
        counted = cut_lineage(edges.groupBy(key).agg(F.count("*").alias("n_")))
        total, most = counted.agg(F.sum("n_"), F.max("n_")).first()
        limit = max(HEAVY_LEAST, -(-(total or 0) // HEAVY_SHARE))
        self.hubs = None
        self.edges = edges
        if (most or 0) >= limit:
            self.hubs = F.broadcast(counted.where(F.col("n_") >= limit).select(key, F.ceil(F.col("n_") / limit).cast("int").alias("parts_")))
            others = [c for c in edges.columns if c != key]
            dealt = F.pmod(F.xxhash64(*others), F.coalesce("parts_", F.lit(1))).cast("int")
            self.edges = edges.join(self.hubs, key, "left").withColumn("part_", dealt).drop("parts_")

    def join(self, rows: DataFrame) -> DataFrame:
        """The inner join of ``rows`` and the edges by the key."""
        if self.hubs is None:
            return rows.join(self.edges, self.key)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))
        repeated = rows.join(self.hubs, self.key, "left").withColumn("part_", copies).drop("parts_")
        return repeated.join(self.edges, [self.key, "part_"]).drop("part_")


#: Pairs of rows of one key that one task forms, and rows of a side in a tile of a heavier key.
TILE_PAIRS = 1 << 20
TILE_ROWS = 1024


def tiled_join(left: DataFrame, right: DataFrame, key: str, pairs: int = TILE_PAIRS, rows: int = TILE_ROWS) -> DataFrame:
    """The inner join of two sides that both may have many rows of one key, in which no key meets in one task.

    Keys with at most ``pairs`` pairs of rows go through an ordinary join.  Of a heavier one both
    sides are dealt into tiles of about ``rows`` rows and each tile of the left meets each of the right.
    Both sides are read more than once, so callers hand in checkpoints or something as cheap.
    """
    n, m = left.groupBy(key).agg(F.count("*").alias("n_")), right.groupBy(key).agg(F.count("*").alias("m_"))
    heavy = cut_lineage(n.join(m, key).where(F.col("n_") * F.col("m_") > pairs))
    if heavy.isEmpty():
        return left.join(right, key)
    ids = heavy.select(key, F.ceil(F.col("n_") / rows).cast("int").alias("parts_"), F.ceil(F.col("m_") / rows).cast("int").alias("others_"), "n_", "m_")

    def dealt(side: DataFrame, weight: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        columns = [quoted(c) for c in side.columns]
        found = lookup(side, ids.select(key, F.col(own).alias("own_"), F.col(other).alias("other_"), weight), [key], weight, "left")
        place = F.pmod(F.xxhash64(*columns), F.coalesce("own_", F.lit(1))).cast("int")
        return found.select(*columns, place.alias(mine), F.explode(F.sequence(F.lit(0), F.coalesce("other_", F.lit(1)) - 1)).alias(theirs))

    return dealt(left, "n_", "parts_", "others_", "left_", "right_").join(dealt(right, "m_", "others_", "parts_", "right_", "left_"), [key, "left_", "right_"]).drop("left_", "right_")
