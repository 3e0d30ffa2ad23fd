"""Readers, loaders and writers of node and edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.operators.skew import shared_folder

NODE_DEFAULTS = ("label", "entity_type")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/kinloom-{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table's folder, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_source(spark: SparkSession, source: str | DataFrame, columns: list[str] | None = None, format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Selected columns (all by default) of a path, a table (format 'table'), a JDBC source or a DataFrame.

    For JDBC give url, dbtable, and partitionColumn, lowerBound, upperBound, numPartitions for a parallel read.
    """
    if isinstance(source, DataFrame):
        df = source
    elif format == "table":
        df = spark.table(source)
    else:
        reader = spark.read.format(format).options(**options)
        reader = reader.schema(schema) if schema else reader
        df = reader.load() if format == "jdbc" else reader.load(source)
    return df.select(*columns) if columns else df


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case without double quotes."""
    return df.toDF(*[c.lower().replace('"', "") for c in df.columns])


def load_nodes(df: DataFrame) -> DataFrame:
    """id, label, entity_type as strings; absent label or entity_type become ''; rows without id go."""
    require_columns(df, ["id"])
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in NODE_DEFAULTS]
    return df.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), *rest)


def clean_weight(weight: Column) -> Column:
    """As double; what is null, NaN or no number counts as 1."""
    return F.coalesce(F.nanvl(weight.try_cast("double"), F.lit(1.0)), F.lit(1.0))


def load_edges(df: DataFrame) -> DataFrame:
    """source, target, weight; rows without an end and self-loops go, equal rows are kept once."""
    require_columns(df, ["source", "target"])
    weight = clean_weight(F.col("weight")) if "weight" in df.columns else F.lit(1.0)
    ends = df.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), weight.alias("weight"))
    return ends.where("source is not null and target is not null and source <> target").dropDuplicates()


def load_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """The requested columns, an error if one is missing; white space in id, source and target becomes '_'."""
    require_columns(df, columns)
    tidy = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\s+", "_").alias(c)
    return df.select(*[tidy(c) if c in ("id", "source", "target") else F.col(c) for c in columns])


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of one column, as strings named id."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("id")).distinct()


def read_edge_csv(spark: SparkSession, path: str, schema: str = "source string, target string, weight double", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header)


def write_outputs(tables: dict[str, tuple[DataFrame, str]], folder: str) -> dict[str, str]:
    """Write each (DataFrame, format) under ``folder``; the paths by name.  Formats: csv, json, parquet."""
    paths = {}
    for name, (df, format) in tables.items():
        paths[name] = f"{folder}/{name}"
        writer = df.write.option("header", True) if format == "csv" else df.write
        writer.format(format).save(paths[name])
    return paths


def run_metric(spark: SparkSession, sql: str, run_date: str, **tables: DataFrame) -> DataFrame:
    """A metric's rows; the SQL refers to ``:run_date`` and to tables as ``{name}``."""
    return spark.sql(sql, args={"run_date": run_date}, **tables)


def run_metrics(spark: SparkSession, metrics: dict[str, str], run_date: str, **tables: DataFrame) -> DataFrame:
    """(metric, run_date, value) of every named SQL text, in one job.

    Each text is written as for ``run_metric`` and names its result ``value``; of several rows the
    first counts, and a text without rows gives a null value.
    """
    if not metrics:
        return spark.createDataFrame([], "metric string, run_date string, value double")
    out = None
    for name, sql in metrics.items():
        first = run_metric(spark, sql, run_date, **tables).limit(1).agg(F.first("value").cast("double").alias("value"))
        one = first.select(F.lit(name).alias("metric"), F.lit(run_date).alias("run_date"), "value")
        out = one if out is None else out.unionByName(one)
    return out
