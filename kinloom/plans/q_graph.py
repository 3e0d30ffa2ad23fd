"""Queries of graph preparation, profiles and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.operators import components, prep, profile
from kinloom.plans import graph_view as view
from kinloom.plans.graph_view import PURCHASES_SQL, TERRITORY_SQL, read
from kinloom.plans.registry import query

DENSE = "WITH RECURSIVE " + view.view_sql("dense")
WEEKLY = "WITH RECURSIVE " + view.view_sql("weekly")
BOUGHT = "WITH " + PURCHASES_SQL
SHARED = "WITH RECURSIVE " + view.shared_sql("dense")
SHARED_WEEKLY = "WITH RECURSIVE " + view.shared_sql("weekly")
TYPED = """,
typed AS (SELECT CASE WHEN substr(source, 1, 1) = 'o' THEN target ELSE source END AS x, CASE WHEN substr(source, 1, 1) = 'o' THEN source ELSE target END AS o, weight, edge_detail, edge_seq
          FROM edges WHERE source[1] = 'o' OR target[1] = 'o'),
po AS (SELECT DISTINCT x AS p, o FROM typed WHERE x[1] = 'p'),
oc AS (SELECT DISTINCT o, x AS c FROM typed WHERE x[1] = 'c'),
org_w AS (SELECT n.id AS o, coalesce(first_w, 1.0) AS w FROM nodes n LEFT JOIN (SELECT o, arg_min(weight, edge_seq) AS first_w FROM typed GROUP BY 1) f ON n.id = f.o WHERE entity_type = 'Organization')"""


@query(f"{DENSE} SELECT source, target, weight, edge_detail, edge_seq FROM sym WHERE source <> target")
def b1_undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.undirected_edges(view.edges(spark, sf_dir))


@query(f"{BOUGHT} SELECT least(source, target) AS source, greatest(source, target) AS target, sum(weight) AS weight FROM purchases GROUP BY 1, 2")
def b2_collapse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.collapse_edges(view.purchases(spark, sf_dir))


@query(f"{BOUGHT} SELECT source, target, count(*)::DOUBLE AS weight FROM purchases GROUP BY 1, 2")
def b2_collapse_directed_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.collapse_edges(view.purchases(spark, sf_dir), directed=True, use_weights=False)


@query(f"""{BOUGHT} SELECT least(source, target) AS source, greatest(source, target) AS target, arg_max(weight, edge_seq) AS weight, arg_max(edge_detail, edge_seq) AS edge_detail, max(edge_seq) AS edge_seq
FROM purchases GROUP BY 1, 2""")
def b3_latest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.latest_edges(view.purchases(spark, sf_dir))


@query(f"""{DENSE}, known AS (SELECT id FROM nodes WHERE entity_type <> 'Advisor')
SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target FROM edges WHERE source IN (SELECT id FROM known) AND target IN (SELECT id FROM known)""")
def b4_valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.valid_edges(view.edges(spark, sf_dir), view.nodes(spark, sf_dir).where("entity_type <> 'Advisor'"))


@query(f"{BOUGHT} SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target, weight FROM purchases")
def b5_standardize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.standardize_edges(view.purchases(spark, sf_dir))


@query(f"""{DENSE}, picked AS (SELECT id FROM nodes ORDER BY md5('7|' || id), id LIMIT 900)
SELECT source, target, weight FROM edges WHERE source IN (SELECT id FROM picked) AND target IN (SELECT id FROM picked)""")
def b6_subset_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.subset_random(view.nodes(spark, sf_dir), view.edges(spark, sf_dir), 900, seed=7)[1].select("source", "target", "weight")


@query(f"""{DENSE}, listed AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND starts_with('c' || c_custkey, 'c1'))
SELECT id, label, entity_type FROM nodes WHERE id IN (SELECT id FROM listed)""")
def b7_subset_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return prep.subset_by_table(view.nodes(spark, sf_dir), view.edges(spark, sf_dir), table, "c_custkey", form="c%s", prefix="c1")[0].select("id", "label", "entity_type")


@query(f"""{SHARED}, kept AS (SELECT component FROM component GROUP BY 1 HAVING count(*) >= 4 AND count_if(node[1] = 'p') > 0)
SELECT source, target FROM pairs JOIN component ON node = source WHERE component IN (SELECT component FROM kept)""")
def b8_subset_by_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    prospects = view.nodes(spark, sf_dir).where("entity_type = 'Prospect'")
    return prep.subset_by_component(view.shared_edges(spark, sf_dir), prospects, min_size=4).select("source", "target")


@query(f"""{DENSE}, h0 AS (SELECT id FROM nodes WHERE networth < -950), h1 AS (SELECT id FROM h0 UNION SELECT target FROM sym JOIN h0 ON source = id), h2 AS (SELECT id FROM h1 UNION SELECT target FROM sym JOIN h1 ON source = id)
SELECT source, target, weight FROM edges WHERE source IN (SELECT id FROM h2) AND target IN (SELECT id FROM h2)""")
def b9_k_hop_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.k_hop_subset(view.edges(spark, sf_dir), view.nodes(spark, sf_dir).where("networth < -950"), 2).select("source", "target", "weight")


@query(f"""{WEEKLY}{TYPED} SELECT 'po' AS part, p AS a, o AS b, NULL::DOUBLE AS w, NULL AS detail FROM po UNION ALL SELECT 'oc', o, c, NULL, NULL FROM oc UNION ALL SELECT 'org_w', o, NULL, w, NULL FROM org_w
UNION ALL SELECT 'info', least(x, o), greatest(x, o), NULL, arg_max(edge_detail, edge_seq) FROM typed WHERE x[1] IN ('p', 'c') GROUP BY 2, 3""")
def b10_build_typed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = prep.build_typed_index(view.nodes(spark, sf_dir, "weekly"), view.edges(spark, sf_dir, "weekly"))
    row = lambda df, part, a, b, w="cast(null as double)", detail="cast(null as string)": df.selectExpr(f"'{part}' as part", f"{a} as a", f"{b} as b", f"{w} as w", f"{detail} as detail")
    out = row(index["po"], "po", "p", "o").unionByName(row(index["oc"], "oc", "o", "c")).unionByName(row(index["org_w"], "org_w", "o", "cast(null as string)", "w"))
    return out.unionByName(row(index["edge_info"], "info", "source", "target", detail="edge_detail"))


@query(f"""{DENSE}{TYPED} SELECT 'with' AS kind, o AS id FROM (SELECT DISTINCT o FROM po) WHERE o IN (SELECT o FROM oc)
UNION ALL SELECT 'without', o FROM (SELECT DISTINCT o FROM po) WHERE o NOT IN (SELECT o FROM oc)
UNION ALL SELECT 'isolated', id FROM nodes WHERE entity_type = 'Prospect' AND id NOT IN (SELECT p FROM po WHERE o IN (SELECT o FROM oc))""")
def b11_org_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view.nodes(spark, sf_dir)
    index = prep.build_typed_index(nodes, view.edges(spark, sf_dir))
    name = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return name(prep.orgs_with_clients(index), "with", "o").unionByName(name(prep.orgs_without_clients(index), "without", "o")).unionByName(name(prep.isolated_prospects(nodes, index), "isolated", "p"))


IDS = ", ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM (SELECT DISTINCT source AS id FROM sym))"
INDEXED = DENSE + IDS


@query(f"{WEEKLY}{IDS} SELECT id, index FROM ids")
def b12_node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.node_index(view.edges(spark, sf_dir, "weekly").select("source", "target"))[0]


@query(f"{INDEXED} SELECT a.index AS source, b.index AS target FROM sym JOIN ids a ON source = a.id JOIN ids b ON target = b.id")
def b12_indexed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.node_index(view.edges(spark, sf_dir).select("source", "target"))[1]


@query(f"{DENSE} SELECT id FROM nodes WHERE lower(entity_type) = 'client'")
def b13_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.entity_ids(view.nodes(spark, sf_dir), "client", exact=False)


def _profile_sql() -> str:
    line = "SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls, {z} AS zeros, {e} AS empty, count(*) AS n_rows, 5 AS n_columns FROM customer"
    kinds = {"c_custkey": 1, "c_name": 0, "c_nationkey": 1, "c_acctbal": 1, "c_mktsegment": 0}
    return " UNION ALL ".join(line.format(c=c, z=f"count_if({c} = 0)::BIGINT" if n else "0", e="0" if n else f"count_if({c} = '')::BIGINT") for c, n in kinds.items())


@query(_profile_sql())
def c1_profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(read(spark, sf_dir, "customer"))


@query("SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def c2_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(read(spark, sf_dir, "part"), "p_type")


@query(f"""{SHARED_WEEKLY} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM pairs) AS n_edges, (SELECT count(*) FROM nodes WHERE entity_type = 'Prospect') AS n_prospects,
(SELECT count(*) FROM nodes WHERE entity_type = 'Client') AS n_clients, (SELECT count(DISTINCT component) FROM component) + (SELECT count(*) FROM nodes) - (SELECT count(*) FROM component) AS n_components""")
def c3_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.graph_summary(view.nodes(spark, sf_dir, "weekly"), view.shared_edges(spark, sf_dir, "weekly"))


@query(f"{DENSE}, d AS (SELECT source, count(*) AS degree FROM sym GROUP BY 1) SELECT count(*) AS n_nodes, quantile_cont(degree, 0.5) AS median_degree, min(degree) AS least, max(degree) AS most FROM d")
def c4_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.degree_stats(view.edges(spark, sf_dir))[0]


@query(f"""{DENSE}, d AS (SELECT source, count(*) AS degree FROM sym GROUP BY 1), s AS (SELECT min(degree) AS lo, (max(degree) - min(degree)) / 50.0::DOUBLE AS width FROM d)
SELECT least(floor((degree - lo) / width), 49)::INT AS bin, lo + least(floor((degree - lo) / width), 49) * width AS low, count(*) AS n FROM d, s GROUP BY ALL""")
def c4_degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.degree_stats(view.edges(spark, sf_dir))[1]


@query(f"{SHARED_WEEKLY} SELECT node, component FROM component")
def c5_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(view.shared_edges(spark, sf_dir, "weekly"))


@query(f"{SHARED}, k AS (SELECT component, node FROM component WHERE node[1] = 'c') SELECT DISTINCT a.component, k.node AS client FROM component a LEFT JOIN k USING (component)")
def c6_component_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.component_clients(view.nodes(spark, sf_dir), view.shared_edges(spark, sf_dir))


@query(f"{SHARED_WEEKLY}, s AS (SELECT component, count(*) AS size FROM component GROUP BY 1) SELECT node, component, size, size >= 6 AS is_large FROM component JOIN s USING (component)")
def c7_split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.split_components(view.shared_edges(spark, sf_dir, "weekly"), 6)


PATHS = "WITH RECURSIVE " + TERRITORY_SQL


@query(f"{PATHS} SELECT component, size, diameter, round(avg_path, 6) AS avg_path FROM lengths")
def c8_path_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.path_length_stats(view.territory_edges(spark, sf_dir)).withColumn("avg_path", F.round("avg_path", 6))


@query(f"""{PATHS}, l AS (SELECT least(floor(2 * quantile_cont(avg_path, 0.5)), 80)::BIGINT AS walk_length, sum(size)::BIGINT AS n FROM lengths WHERE size >= 6)
SELECT walk_length::INT AS walk_length, greatest(10, 10000000 // (n * walk_length)) AS num_walks FROM l""")
def c9_recommend_walk_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.recommend_walk_params(view.territory_edges(spark, sf_dir), 6)


@query()
def c8_sketched_path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sketched_path_lengths(view.shared_edges(spark, sf_dir)).withColumn("avg_path", F.round("avg_path", 6))


@query()
def c9_sketched_walk_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.recommend_walk_params(view.shared_edges(spark, sf_dir), 6, sketched=True)
