"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinloom.operators.skew import cut_lineage, lookup


#: Edges that a task contracts at a time.
BLOCK = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n-1 the smallest one in reach by the edges a-b."""
    parent = np.arange(n)
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low < high
        if not open_.any():
            return parent
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


def contracted(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what ``pairs`` (a, b) connect, at most one for each node of a block.

    A task hangs the nodes of ``block`` edges at a time to one node of their component within the
    block; nothing is shuffled.
    """

    def stars(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        coded = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
        place = coded.indices.to_numpy()
        root = _roots(place[: table.num_rows], place[table.num_rows :], len(coded.dictionary))
        hung = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(hung)), coded.dictionary.take(pa.array(root[hung]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return pairs.select("a", "b").mapInArrow(run, T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")]))


def _with_minimum(rows: DataFrame) -> DataFrame:
    """Add m, the smallest of u and its v's, to rows (u, v), without one hub's rows meeting in one task."""
    least = cut_lineage(rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
    return lookup(rows, least, ["u"], "n", "inner").select("u", "v", "m")


def connected_components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node in reach.

    Edges are contracted within tasks first, so that the shuffled rounds see one edge for each node of
    a task's block.  Rounds end when a round changes no row, told by row count and a sum of hashes.  Self-loops
    make a node known but link nothing.  Rows with a null end are dropped.
    """
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = cut_lineage(contracted(pairs.where("a <> b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour is hung to the smallest neighbour
        large = cut_lineage(_with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: smaller neighbours, and the node itself, are hung to the smallest
        small = _with_minimum(large)
        linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(linked.union(small.select("u", F.col("m").alias("v")).distinct()).where("u <> v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
