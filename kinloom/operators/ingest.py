"""Daily ingestion checks over dossier, mapping and unified client tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

STAGES = ("Ingested", "Mapped", "Deduped", "Filtered", "Loaded")


def _on(df: DataFrame, run_date: str | None) -> DataFrame:
    return df if run_date is None else df.where(F.col("run_date") == run_date)


def ingestion_count(dossier: DataFrame, run_date: str | None = None) -> DataFrame:
    """(run_date, n) of dossier rows."""
    return _on(dossier, run_date).groupBy("run_date").agg(F.count("*").alias("n"))


def raw_mapping_count(mapping: DataFrame, run_date: str | None = None) -> DataFrame:
    return _on(mapping, run_date).where("source_table = 'dossier'").groupBy("run_date").agg(F.count("*").alias("n"))


def duplicate_mapping_count(mapping: DataFrame, run_date: str | None = None) -> DataFrame:
    """(run_date, n) of dossiers mapped to more than one client."""
    per = _on(mapping, run_date).groupBy("run_date", "dossier_id").agg(F.count_distinct("internal_client_id").alias("clients"))
    return per.where("clients > 1").groupBy("run_date").agg(F.count("*").alias("n"))


def filtered_count(dossier: DataFrame, mapping: DataFrame, run_date: str | None = None) -> DataFrame:
    """(run_date, n) of joined rows of current dossiers and mappings of the same date; a dossier mapped twice counts twice."""
    current = _on(dossier, run_date).where("is_current = 'Y'")
    return current.join(_on(mapping, run_date), ["run_date", "dossier_id"]).groupBy("run_date").agg(F.count("*").alias("n"))


def loaded_count(unified: DataFrame, run_date: str | None = None, source: str = "WX") -> DataFrame:
    return _on(unified, run_date).where(F.col("source") == source).groupBy("run_date").agg(F.count("*").alias("n"))


def ingestion_funnel(dossier: DataFrame, mapping: DataFrame, unified: DataFrame) -> DataFrame:
    """(run_date, step, stage, n, percent) for all dates in one job; percent is of the first stage, null if that is 0."""
    parts = [
        ingestion_count(dossier).withColumnRenamed("n", "ingested"), raw_mapping_count(mapping).withColumnRenamed("n", "mapped"), duplicate_mapping_count(mapping).withColumnRenamed("n", "dup"),
        filtered_count(dossier, mapping).withColumnRenamed("n", "filtered"), loaded_count(unified).withColumnRenamed("n", "loaded"),
    ]
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.join(p, "run_date", "full")
    wide = wide.na.fill(0).withColumn("deduped", F.col("mapped") - F.col("dup"))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s.lower()).alias("n")) for i, s in enumerate(STAGES)])
    rows = wide.select("run_date", "ingested", F.explode(steps).alias("s"))
    return rows.select("run_date", "s.step", "s.stage", "s.n", F.when(F.col("ingested") > 0, F.round(100.0 * F.col("s.n") / F.col("ingested"), 4)).alias("percent"))


def duplicate_mappings(mapping: DataFrame, run_date: str | None = None, top: int = 50) -> DataFrame:
    """(run_date, dossier_id, clients): the dossiers mapped to the most clients, a top-k report."""
    per = _on(mapping, run_date).groupBy("run_date", "dossier_id").agg(F.count_distinct("internal_client_id").alias("clients"))
    return per.where("clients > 1").orderBy(F.desc("clients"), "dossier_id", "run_date").limit(top)
