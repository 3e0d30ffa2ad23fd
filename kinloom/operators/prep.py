"""Graph preparation: directions, duplicates, subsets and typed indexes of edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.operators.components import connected_components
from kinloom.operators.skew import Spread, cut_lineage, lookup, unused_names

FORMS = {"prospect": ("p", "prospect"), "organization": ("o", "org", "organisation", "organization"), "client": ("c", "client")}


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Edges and their reversals, without self-loops; repeated edges stay repeated."""
    turned = edges.withColumns({"source": F.col("target"), "target": F.col("source")})
    return edges.unionByName(turned).where("source <> target")


def _pair() -> tuple[Column, Column]:
    return F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")


def collapse_edges(edges: DataFrame, directed: bool = False, use_weights: bool = True) -> DataFrame:
    """One row per unordered (or ordered) pair with the sum of its weights (1 per row without weights)."""
    ends = ("source", "target") if directed else _pair()
    return edges.select(*ends, (F.col("weight") if use_weights else F.lit(1.0)).alias("weight")).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def latest_edges(edges: DataFrame) -> DataFrame:
    """One row per unordered pair with the attributes of its last row (largest edge_seq)."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select(*_pair(), *rest).groupBy("source", "target").agg(F.max_by(F.struct(*rest), "edge_seq").alias("last")).select("source", "target", "last.*")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with both ends in ``nodes``, once each; self-loops stay."""
    known = nodes.select("id")
    held = edges.join(known, edges["source"] == known["id"], "left_semi")
    return held.join(known, held["target"] == known["id"], "left_semi").select(*_pair()).distinct()


def standardize_edges(edges: DataFrame) -> DataFrame:
    """One direction per pair (smaller id first), equal rows once."""
    return edges.select(*_pair(), "weight").dropDuplicates()


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes.id``."""
    known = nodes.select("id").distinct()
    held = edges.join(known, edges["source"] == known["id"], "left_semi")
    return held.join(known, held["target"] == known["id"], "left_semi")


def first_rows(df: DataFrame, bucket: Column, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` without sorting all of them in one task.

    ``bucket`` is a whole number below 65,536 that rises with the order.  Counts per bucket tell
    which one holds the n-th row; only that one is sorted.
    """
    (name,) = unused_names(df, "bucket")
    keyed = cut_lineage(df.withColumn(name, bucket.cast("int")))
    total, last = 0, None
    for b, rows in sorted(keyed.groupBy(name).count().collect()):  # 65,536 rows at most
        if total + rows >= n:
            last = b
            break
        total += rows
    if last is None:
        return keyed.drop(name)
    rest = keyed.where(F.col(name) == last).orderBy(*order).limit(n - total)
    return keyed.where(F.col(name) < last).unionByName(rest).drop(name)


def subset_random(nodes: DataFrame, edges: DataFrame, size: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``size`` nodes picked by a hash of seed and id, and the edges between them."""
    (name,) = unused_names(nodes, "draw")
    drawn = nodes.withColumn(name, F.md5(F.concat(F.lit(f"{seed}|"), "id")))
    picked = first_rows(drawn, F.conv(F.substring(name, 1, 4), 16, 10), [name, "id"], size).drop(name)
    return picked, induced_edges(edges, picked)


def subset_by_table(nodes: DataFrame, edges: DataFrame, table: DataFrame, column: str, form: str = "%s", prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes whose id is listed in another table, after its values are put into ``form`` and filtered by prefix."""
    listed = table.select(F.format_string(form, F.col(column).cast("string")).alias("id")).where(F.col("id").startswith(prefix)).distinct()
    picked = nodes.join(listed, "id", "left_semi")
    return picked, induced_edges(edges, picked)


def subset_by_component(edges: DataFrame, seeds: DataFrame | None = None, min_size: int = 1) -> DataFrame:
    """The edges of whole components that hold one of ``seeds.id`` and have at least ``min_size`` nodes."""
    member = cut_lineage(connected_components(edges))
    kept = member.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    if seeds is not None:
        hit = member.join(seeds.select(F.col("id").alias("node")), "node", "left_semi").select("component").distinct()
        kept = kept.join(hit, "component", "left_semi")
    inside = lookup(member, cut_lineage(kept), ["component"], "n", "inner").select(F.col("node").alias("source"))
    return edges.join(inside, "source", "left_semi")


def k_hop_nodes(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(id, hops) of the nodes within k hops of ``seeds.id``."""
    sym = undirected_edges(edges.select("source", "target")).distinct()
    reached = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    front, links = reached, Spread(cut_lineage(sym), "source")
    for hop in range(1, k + 1):
        step = links.join(front.select(F.col("id").alias("source"))).select(F.col("target").alias("id")).distinct()
        front = cut_lineage(step.join(reached, "id", "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(front)
    return reached


def k_hop_subset(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The edges between nodes within k hops of the seeds."""
    return induced_edges(edges, k_hop_nodes(edges, seeds, k))


def _kind() -> Column:
    low = F.lower("entity_type")
    out = F.lit(None).cast("string")
    for kind, names in FORMS.items():
        out = F.when(low.isin(*names), kind).otherwise(out)
    return out


def build_typed_index(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """po(p, o), oc(o, c) distinct; org_w(o, w); edge_info(source, target, edge_detail) with the last row of a pair.

    An organisation's weight is its node's, else that of its first edge to a prospect or client,
    else 1; NaN counts as 1 and an early NaN edge is not passed over.
    """
    typed = nodes.select("id", _kind().alias("kind")).where("kind is not null")
    both = undirected_edges(edges.select("source", "target", "weight", "edge_detail", "edge_seq"))
    left = both.join(typed.select(F.col("id").alias("source"), F.col("kind").alias("source_kind")), "source")
    pairs = left.join(typed.select(F.col("id").alias("target"), F.col("kind").alias("target_kind")), "target").where("target_kind = 'organization' and source_kind <> 'organization'")
    first = pairs.groupBy(F.col("target").alias("o")).agg(F.min_by(F.struct("weight"), "edge_seq").alias("w"))
    own = nodes.where(_kind() == "organization").select(F.col("id").alias("o"), F.col("weight").alias("own") if "weight" in nodes.columns else F.lit(None).cast("double").alias("own"))
    weight = F.coalesce(F.nanvl(F.coalesce("own", "w.weight"), F.lit(1.0)), F.lit(1.0))
    return {
        "po": pairs.where("source_kind = 'prospect'").select(F.col("source").alias("p"), F.col("target").alias("o")).distinct(),
        "oc": pairs.where("source_kind = 'client'").select(F.col("target").alias("o"), F.col("source").alias("c")).distinct(),
        "org_w": own.join(first, "o", "left").select("o", weight.alias("w")),
        "edge_info": latest_edges(pairs.select("source", "target", "edge_detail", "edge_seq")).select("source", "target", "edge_detail"),
    }


def orgs_with_clients(index: dict[str, DataFrame]) -> DataFrame:
    return index["po"].select("o").distinct().join(index["oc"], "o", "left_semi")


def orgs_without_clients(index: dict[str, DataFrame]) -> DataFrame:
    return index["po"].select("o").distinct().join(index["oc"], "o", "left_anti")


def isolated_prospects(nodes: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Prospects without an organisation that has a client."""
    prospects = nodes.where(_kind() == "prospect").select(F.col("id").alias("p"))
    return prospects.join(index["po"].join(index["oc"], "o", "left_semi"), "p", "left_anti")


def node_index(edges: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, index) with 0..n-1 in string order, and the edges in both directions between indexes.

    Places are counted within ranges of the id's order (as many as the session's shuffles have) and added up over ranges, so no
    task sees all ids.
    """
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    ranges = ranges or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(ids.repartitionByRange(ranges, "id").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("part").orderBy("id")
    indexed = placed.join(F.broadcast(before), "part").select("id", (F.row_number().over(order) - 1 + F.coalesce("before", F.lit(0))).alias("index"))
    indexed = cut_lineage(indexed)
    ends = [indexed.select(F.col("id").alias(c), F.col("index").alias(f"{c}_index")) for c in ("source", "target")]
    renamed = edges.join(ends[0], "source").join(ends[1], "target").select(F.col("source_index").alias("source"), F.col("target_index").alias("target"))
    return indexed, undirected_edges(renamed)


def entity_ids(nodes: DataFrame, entity_type: str, exact: bool = True) -> DataFrame:
    kind = F.col("entity_type") == entity_type if exact else F.lower("entity_type") == entity_type.lower()
    return nodes.where(kind).select("id").distinct()
