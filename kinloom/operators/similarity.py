"""Vectors and cosine search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.operators.skew import cut_lineage, unused_names

#: Vectors of one side of a tile; two sides and their products bound a task's memory.
TILE = 4096


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit vectors; a zero vector stays as it is."""
    (size,) = unused_names(df, "size")
    unit = F.transform(column, lambda x: x.cast("double") / F.when(F.col(size) > 0, F.col(size)).otherwise(1.0))
    return df.withColumn(size, norm(column)).withColumn(column, unit).drop(size)


def client_vectors(vectors: DataFrame, clients: DataFrame) -> DataFrame:
    return normalize_vectors(vectors.join(clients.select("id").distinct(), "id", "left_semi"))


def nearest_long(vectors: DataFrame, targets: DataFrame, n: int, exclude_self: bool, tile: int = TILE) -> DataFrame:
    """(id, other, score, place): the n targets with the largest cosine for each vector, ties to the smaller id.

    Both sides are dealt into tiles by a hash of the id; a task multiplies one tile by another and
    keeps n per row, and the tiles' winners are ranked.  A zero vector scores 0 with everything.
    """
    unit_v, unit_t = (normalize_vectors(d.select("id", "embedding")) for d in (vectors, targets))
    blocks = [max(1, -(-d.count() // tile)) for d in (vectors, targets)]
    keyed = lambda d, k: d.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(k)))
    left = keyed(unit_v, blocks[0]).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks[1] - 1)), lambda j: F.col("block") * blocks[1] + j))).select("tile", "id", "embedding")
    right = keyed(unit_t, blocks[1]).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks[0] - 1)), lambda i: i.cast("long") * blocks[1] + F.col("block"))))
    # other names than the left side's, which may come from the same table
    right = right.select(F.col("tile").alias("tile_"), F.col("id").alias("other"), F.col("embedding").alias("vector"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, others = np.array(a["id"].to_pylist(), object), np.array(sorted(zip(b["other"].to_pylist(), range(b.num_rows), strict=True)), object).reshape(-1, 2)
        out: list[list] = [[], [], []]
        if len(ids) and len(others):
            x = np.array(a["embedding"].to_pylist(), float)
            y = np.array(b["vector"].to_pylist(), float)[others[:, 1].astype(int)]
            names = others[:, 0]
            for i in range(0, len(x), 512):
                scores = np.round(x[i : i + 512] @ y.T, 9)
                if exclude_self:
                    scores[ids[i : i + 512, None] == names[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                for r, row in enumerate(best):
                    for c in row:
                        if scores[r, c] != -np.inf:
                            for k, v in enumerate((ids[i + r], names[c], scores[r, c])):
                                out[k].append(v)
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["id", "other", "score"])

    pairs = left.groupBy("tile").cogroup(right.groupBy("tile_")).applyInArrow(search, "id string, other string, score double")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def top1_client(vectors: DataFrame, clients: DataFrame) -> DataFrame:
    """(id, best_client, similarity): the nearest client by cosine, itself included; ('', 0.0) without clients."""
    best = nearest_long(vectors, clients, 1, exclude_self=False)
    return vectors.select("id").join(best, "id", "left").select("id", F.coalesce("other", F.lit("")).alias("best_client"), F.coalesce("score", F.lit(0.0)).alias("similarity"))


def nearest_neighbors(vectors: DataFrame, n: int = 5) -> DataFrame:
    """node_id, top1_id, top1_score, ..: the n nearest others; missing places are null."""
    return wide_places(vectors, nearest_long(vectors, vectors, n, exclude_self=True), n)


def wide_places(vectors: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """A row for each vector, and a column for each place of what was ``found`` (id, other, score, place)."""
    wide = [x for k in range(1, n + 1) for x in (F.max(F.when(F.col("place") == k, F.col("other"))).alias(f"top{k}_id"), F.max(F.when(F.col("place") == k, F.col("score"))).alias(f"top{k}_score"))]
    return vectors.select("id").join(found.groupBy("id").agg(*wide), "id", "left").withColumnRenamed("id", "node_id")


def annotate_best_clients(rows: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 6, weighted: bool = False) -> DataFrame:
    """``rows`` (column id) with best_client_id, similarity and path_to_best_client (JSON); '', 0.0 and '[]' without a vector."""
    from kinloom.operators.paths import bfs_paths, path_payload, weighted_paths

    clients = vectors.join(nodes.where(F.lower("entity_type") == "client").select("id"), "id", "left_semi")
    wanted = vectors.join(rows.select("id").distinct(), "id", "left_semi")
    best = cut_lineage(top1_client(wanted, clients))
    pairs = best.where("best_client <> ''").select(F.col("id").alias("src"), F.col("best_client").alias("dst"))
    paths = (weighted_paths(edges, pairs) if weighted else bfs_paths(edges, pairs, max_hops)).select("src", "dst", "path")
    payload = path_payload(cut_lineage(paths), nodes, edges).select(F.col("src").alias("id"), "payload")
    joined = rows.join(best, "id", "left").join(payload, "id", "left")
    return joined.select(*rows.columns, F.coalesce("best_client", F.lit("")).alias("best_client_id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("payload", F.lit("[]")).alias("path_to_best_client"))


def edge_scores(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, score: the dot product of the ends' vectors."""
    a = vectors.select(F.col("id").alias("source"), F.col("embedding").alias("va"))
    b = vectors.select(F.col("id").alias("target"), F.col("embedding").alias("vb"))
    return edges.select("source", "target").join(a, "source").join(b, "target").select("source", "target", dot("va", "vb").alias("score"))


def embedding_distance(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, distance: L2 distance of two nodes' vectors."""
    left = vectors.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    right = vectors.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    gap = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.sqrt(gap).alias("distance"))


def pca_2d(vectors: DataFrame) -> DataFrame:
    """(id, x, y): two principal components of the centred vectors; each component's largest loading is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    raw = vectors.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="v", withMean=True, withStd=False).fit(raw).transform(raw)
    model = PCA(k=2, inputCol="v", outputCol="out").fit(centred)
    loadings = model.pc.toArray()
    sign = [1.0 if loadings[np.abs(loadings[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    out = model.transform(centred).select("id", vector_to_array("out").alias("o"))
    return out.select("id", (F.col("o")[0] * sign[0]).alias("x"), (F.col("o")[1] * sign[1]).alias("y"))

