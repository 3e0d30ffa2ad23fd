"""Queries of path scoring, path search and layered scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.operators import multihop, paths, prep
from kinloom.operators.skew import cut_lineage
from kinloom.plans import graph_view as view
from kinloom.plans.registry import query

DENSE = "WITH RECURSIVE " + view.view_sql("dense")
LAYERED = "WITH RECURSIVE " + view.view_sql("layered")
YEARLY = "WITH RECURSIVE " + view.view_sql("yearly")


def map_text(c: str) -> Column:
    """A map as sorted 'key=value' entries, which any engine can compare."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _graph(spark: SparkSession, sf_dir: str, variant: str) -> tuple[DataFrame, DataFrame]:
    return view.nodes(spark, sf_dir, variant), cut_lineage(view.edges(spark, sf_dir, variant))


@query(f"""{YEARLY},
walk(start, last, path, score, details, hop, hit) AS (
  SELECT source, target, [source, target], weight, edge_detail, 0, false FROM sym JOIN nodes ON source = id WHERE entity_type = 'Prospect'
  UNION ALL
  SELECT start, s.target, list_append(path, s.target), score * s.weight, details || '|' || s.edge_detail, hop + 1, s.target[1] = 'c'
  FROM walk JOIN sym s ON last = s.source WHERE hop < 4 AND NOT hit AND NOT list_contains(path, s.target))
SELECT start AS prospect_id, last AS client_id, round(sum(score), 6) AS total_score, count(*) AS n_paths,
       string_agg(array_to_string(path, '→') || '=' || details, ';' ORDER BY array_to_string(path, '→')) AS path_details FROM walk WHERE hit GROUP BY 1, 2""")
def d1_simple_path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.simple_path_scores(*_graph(spark, sf_dir, "yearly"))
    return out.select("prospect_id", "client_id", F.round("total_score", 6).alias("total_score"), F.size("path_details").cast("long").alias("n_paths"), map_text("path_details").alias("path_details"))


def levels_sql(depth: int = 5) -> str:
    """CTEs s1..s<depth>: each prospect's breadth-first levels with sums of products, then winners."""
    out = ["s0 AS (SELECT id AS p, id AS node, 1.0::DOUBLE AS s FROM nodes WHERE entity_type = 'Prospect' AND id IN (SELECT source FROM sym))"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT p, node FROM s{j}" for j in range(k))
        out.append(f"s{k} AS (SELECT a.p, e.target AS node, sum(a.s * e.weight) AS s FROM s{k - 1} a JOIN sym e ON a.node = e.source ANTI JOIN ({seen}) v ON v.p = a.p AND v.node = e.target GROUP BY 1, 2)")
    every = " UNION ALL ".join(f"SELECT p, node, s, {k} AS depth FROM s{k}" for k in range(2, depth + 1))
    out.append(f"hit AS (SELECT * FROM ({every}) WHERE node[1] = 'c')")
    out.append("near AS (SELECT * FROM hit QUALIFY depth = min(depth) OVER (PARTITION BY p))")
    out.append("best AS (SELECT * FROM near QUALIFY s = max(s) OVER (PARTITION BY p))")
    return ", ".join(out)


@query(f"""{LAYERED}, {levels_sql()}, lead AS (SELECT source AS c, string_agg(target, ',' ORDER BY target) AS fa FROM sym WHERE target[1] = 'a' GROUP BY 1)
SELECT p AS prospect_id, node AS client_id, depth, round(s, 6) AS score, coalesce(fa, '') AS lead_fa FROM best LEFT JOIN lead ON c = node""")
def d2_nearest_depth_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.nearest_depth_best_fit(*_graph(spark, sf_dir, "layered"))
    return out.select("prospect_id", "client_id", "depth", F.round("score", 6).alias("score"), F.array_join("lead_fa", ",").alias("lead_fa"))


@query(f"""{LAYERED}, {levels_sql()},
walk(p, node, path, steps, d) AS (SELECT p, node, [p], '', 0 FROM s0 WHERE p IN (SELECT p FROM best)
  UNION ALL SELECT w.p, e.target, list_append(path, e.target), steps || (CASE WHEN d > 0 THEN ', ' ELSE '' END) || w.node || ' -> ' || e.target || ' ' || e.edge_detail, d + 1
  FROM walk w JOIN sym e ON w.node = e.source JOIN (SELECT p AS bp, max(depth) AS depth FROM best GROUP BY 1) b ON bp = w.p WHERE d < b.depth AND NOT list_contains(path, e.target))
SELECT w.p AS prospect_id, w.node AS client_id, count(*) AS n_paths, string_agg(steps, '; ' ORDER BY steps) AS paths FROM walk w JOIN best b ON w.p = b.p AND w.node = b.node AND w.d = b.depth GROUP BY 1, 2""")
def d3_shortest_path_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.shortest_path_relationships(*_graph(spark, sf_dir, "layered"))
    text = F.transform("paths", lambda p: F.array_join(F.transform(p, lambda s: F.concat(s["step"], F.lit(" "), s["edge_detail"])), ", "))
    return out.select("prospect_id", "client_id", F.size("paths").cast("long").alias("n_paths"), F.array_join(F.array_sort(text), "; ").alias("paths"))


@query(f"""{LAYERED}, asked AS (SELECT 'p' || c_custkey AS id FROM customer UNION SELECT org FROM lines UNION SELECT 'o' || p_partkey FROM part), there AS (SELECT DISTINCT source AS id FROM sym)
SELECT a.id, CASE WHEN t.id IS NULL THEN 'unfound' WHEN n.entity_type = 'Prospect' THEN 'found' ELSE 'not a prospect' END AS status FROM asked a LEFT JOIN there t USING (id) LEFT JOIN nodes n USING (id)""")
def d4_unfound_prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view.read(spark, sf_dir, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("id")).unionByName(view.read(spark, sf_dir, "part").select(F.concat(F.lit("o"), "p_partkey").alias("id"))).unionByName(view._lines(spark, sf_dir, "layered").select(F.col("org").alias("id")))
    return paths.unfound_prospects(asked, *_graph(spark, sf_dir, "layered"))


TWO_HOP = f"""{DENSE},
hop AS (SELECT DISTINCT a.source AS start, m.label AS mid_label, m.entity_type AS mid_type, a.weight AS w1, a.edge_detail AS first, b.weight AS w2, b.edge_detail AS second, e.id AS c
        FROM sym a JOIN nodes m ON a.target = m.id JOIN sym b ON b.source = m.id JOIN nodes e ON b.target = e.id JOIN nodes s ON a.source = s.id
        WHERE m.entity_type <> 'Advisor' AND e.entity_type = 'Client' AND s.entity_type = 'Prospect'),
per AS (SELECT start, c, mid_label, sum(w1 * w2) AS score, max(mid_type) AS mid_type, max(first) AS first, max(second) AS second FROM hop GROUP BY 1, 2, 3),
two AS (SELECT start, c AS client_id, round(sum(score), 6) AS score, string_agg(mid_label || '=' || mid_type, ';' ORDER BY mid_label) AS intermediaries,
               string_agg(mid_label || '=' || first, ';' ORDER BY mid_label) AS first_hop, string_agg(mid_label || '=' || second, ';' ORDER BY mid_label) AS second_hop FROM per GROUP BY 1, 2)"""


def _two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, "dense")
    return paths.two_hop_clients(nodes, edges, nodes.where("entity_type = 'Prospect'"))


@query(f"{TWO_HOP} SELECT start, two.client_id, score, networth, intermediaries, first_hop, second_hop FROM two JOIN nodes ON nodes.id = two.client_id")
def d5_two_hop_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _two_hop(spark, sf_dir)
    return out.select("start", "client_id", F.round("score", 6).alias("score"), "networth", *[map_text(c).alias(c) for c in ("intermediaries", "first_hop", "second_hop")])


@query(f"""{DENSE}, near AS (SELECT source AS id, string_agg(target, ',' ORDER BY target) AS advisors, arg_min(label, target) AS first_label FROM sym JOIN nodes ON nodes.id = target AND entity_type = 'Advisor' GROUP BY 1)
SELECT n.id, coalesce(advisors, '') AS advisors, coalesce(first_label, '') AS first_label FROM nodes n LEFT JOIN near USING (id) WHERE entity_type = 'Client'""")
def d6_lead_advisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.lead_advisors(*_graph(spark, sf_dir, "dense")).select("id", F.array_join("advisors", ",").alias("advisors"), "first_label")


@query(f"""{TWO_HOP}, marked AS (SELECT start, client_id, score, (score = max(score) OVER (PARTITION BY start))::INT AS best_fit FROM two)
SELECT start, client_id, score, best_fit, row_number() OVER (PARTITION BY start ORDER BY best_fit DESC, client_id)::INT AS place FROM marked""")
def d7_best_fit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _two_hop(spark, sf_dir).select("start", "client_id", F.round("score", 6).alias("score"))
    return paths.best_fit_rank(scored, order=("client_id",))


def index_sql(variant: str) -> str:
    return f"""WITH RECURSIVE {view.view_sql(variant)},
typed AS (SELECT source AS x, target AS o, weight, edge_seq FROM edges WHERE target[1] = 'o'),
w AS (SELECT o, arg_min(weight, edge_seq) AS w FROM typed GROUP BY 1),
po AS (SELECT DISTINCT x AS p, typed.o, w FROM typed JOIN w USING (o) WHERE x[1] = 'p'),
oc AS (SELECT DISTINCT o, x AS c FROM typed WHERE x[1] = 'c'),
l2 AS (SELECT p, c, sum(w * w) AS score FROM po JOIN oc USING (o) GROUP BY 1, 2),
alpha AS (SELECT a.p, b.p AS q, sum(a.w * a.w) AS alpha FROM po a JOIN po b ON a.o = b.o AND a.p <> b.p GROUP BY 1, 2),
l4 AS (SELECT a.p, c, sum(alpha * score) AS score FROM alpha a JOIN l2 ON q = l2.p WHERE a.p NOT IN (SELECT p FROM l2) GROUP BY 1, 2),
l6 AS (SELECT a.p, c, sum(alpha * score) AS score FROM alpha a JOIN l4 ON q = l4.p WHERE a.p NOT IN (SELECT p FROM l2 UNION SELECT p FROM l4) GROUP BY 1, 2),
layers AS (SELECT *, 2 AS layer FROM l2 UNION ALL SELECT *, 4 FROM l4 UNION ALL SELECT *, 6 FROM l6)"""


INDEX, TERRITORIES = index_sql("layered"), index_sql("territorial")



def _index(spark: SparkSession, sf_dir: str, variant: str = "layered") -> dict[str, DataFrame]:
    nodes, edges = _graph(spark, sf_dir, variant)
    return {k: cut_lineage(df) for k, df in prep.build_typed_index(nodes, edges).items()}


@query(f"{INDEX} SELECT p, c, round(score, 6) AS score FROM l2")
def d8_two_hop_org_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihop.two_hop_org_scores(_index(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"{TERRITORIES} SELECT p, c, round(score, 6) AS score FROM l2")
def d8_scores_over_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihop.two_hop_org_scores(_index(spark, sf_dir, "territorial")).withColumn("score", F.round("score", 6))


@query(f"{TERRITORIES} SELECT p, q, round(alpha, 6) AS alpha FROM alpha")
def d9_bridges_over_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihop.bridge_factor(_index(spark, sf_dir, "territorial")).withColumn("alpha", F.round("alpha", 6))


@query(f"{INDEX} SELECT p, q, round(alpha, 6) AS alpha FROM alpha")
def d9_bridge_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihop.bridge_factor(_index(spark, sf_dir)).withColumn("alpha", F.round("alpha", 6))


@query(f"{INDEX} SELECT p, c, round(score, 6) AS score, layer FROM layers")
def d10_multi_hop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihop.multi_hop_scores(_index(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""{INDEX},
w2 AS (SELECT p, c, [p, o, c] AS path FROM (SELECT *, row_number() OVER (PARTITION BY p, c ORDER BY w * w DESC, o) AS r FROM po JOIN oc USING (o)) WHERE r = 1),
w4 AS (SELECT p, c, list_concat([p, o], path) AS path FROM (SELECT a.p, a.o, t.c, t.path, row_number() OVER (PARTITION BY a.p, t.c ORDER BY a.w * a.w DESC, a.o, t.p) AS r
       FROM po a JOIN po b ON a.o = b.o JOIN w2 t ON t.p = b.p WHERE a.p IN (SELECT p FROM l4)) WHERE r = 1),
w6 AS (SELECT p, c, list_concat([p, o], path) AS path FROM (SELECT a.p, a.o, t.c, t.path, row_number() OVER (PARTITION BY a.p, t.c ORDER BY a.w * a.w DESC, a.o, t.p) AS r
       FROM po a JOIN po b ON a.o = b.o JOIN w4 t ON t.p = b.p WHERE a.p IN (SELECT p FROM l6)) WHERE r = 1)
SELECT p, c, array_to_string(path, ',') AS path FROM (SELECT * FROM w2 UNION ALL SELECT * FROM w4 UNION ALL SELECT * FROM w6)""")
def d11_witness_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return multihop.witness_paths(index, multihop.multi_hop_scores(index)).select("p", "c", F.array_join("path", ",").alias("path"))


@query(f"""{INDEX} SELECT p AS prospect_id, coalesce(a.label, p) AS prospect_label, c AS client_id, coalesce(b.label, c) AS client_label, round(score, 6) AS score, layer, score = max(score) OVER (PARTITION BY p) AS is_best_fit
FROM layers LEFT JOIN nodes a ON a.id = p LEFT JOIN nodes b ON b.id = c""")
def d12_best_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = multihop.multi_hop_scores(_index(spark, sf_dir))
    return multihop.best_clients(scores, view.nodes(spark, sf_dir, "layered")).withColumn("score", F.round("score", 6))


@query(f"""{INDEX}, w2 AS (SELECT p, c, o FROM (SELECT *, row_number() OVER (PARTITION BY p, c ORDER BY w * w DESC, o) AS r FROM po JOIN oc USING (o)) WHERE r = 1)
SELECT p, c, a.label || ' -> ' || m.label || ' -> ' || b.label AS text FROM w2 JOIN nodes a ON a.id = p JOIN nodes m ON m.id = o JOIN nodes b ON b.id = c""")
def d13_readable_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    two = multihop.two_hop_org_scores(index).withColumn("layer", F.lit(2))
    return paths.readable_path(multihop.witness_paths(index, two), view.nodes(spark, sf_dir, "layered"), ("p", "c"))


PAIRS_SQL = "pairs AS (SELECT a.id AS src, min(b.id) AS dst FROM people a JOIN people b ON a.c_nationkey = b.c_nationkey AND b.id[1] = 'c' WHERE a.id[1] = 'p' GROUP BY 1)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prospect with the first client of its nation."""
    people = view._customers(spark, sf_dir, "dense")
    first = people.where("entity_type = 'Client'").groupBy("c_nationkey").agg(F.min("id").alias("dst"))
    return people.where("entity_type = 'Prospect'").join(first, "c_nationkey").select(F.col("id").alias("src"), "dst")


def bfs_sql(depth: int = 6) -> str:
    """CTEs b0..b<depth> of first-met nodes with their paths, then found(src, dst, path); needs pairs(src, dst)."""
    out = ["b0 AS (SELECT DISTINCT src, src AS node, [src] AS path FROM pairs)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT src, node FROM b{j}" for j in range(k))
        out.append(f"b{k} AS (SELECT a.src, e.target AS node, list_append(arg_min(a.path, a.node), e.target) AS path FROM b{k - 1} a JOIN (SELECT DISTINCT source, target FROM sym) e ON a.node = e.source ANTI JOIN ({seen}) v ON v.src = a.src AND v.node = e.target GROUP BY a.src, e.target)")
    every = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(depth + 1))
    out.append(f"found AS (SELECT pairs.src, pairs.dst, coalesce(path, []) AS path FROM pairs LEFT JOIN ({every}) a ON a.src = pairs.src AND a.node = pairs.dst)")
    return ", ".join(out)


PAYLOAD_SQL = """steps AS (SELECT src, dst, unnest(path) AS id, generate_subscripts(path, 1) AS pos, path FROM found),
texts AS (SELECT src, dst, pos, '{"id":"' || s.id || '","label":"' || n.label || '","type":"' || n.entity_type || '"}' || CASE WHEN pos < len(path) THEN ',{"label":"' || e.edge_detail || '","weight":' || e.weight::VARCHAR || '}' ELSE '' END AS t
          FROM steps s JOIN nodes n ON n.id = s.id LEFT JOIN sym e ON e.source = s.id AND e.target = path[pos + 1]),
payloads AS (SELECT f.src, f.dst, '[' || coalesce(string_agg(t, ',' ORDER BY pos), '') || ']' AS payload FROM found f LEFT JOIN texts USING (src, dst) GROUP BY 1, 2)"""


@query(f"{DENSE}, {PAIRS_SQL}, {bfs_sql()} SELECT src, dst, array_to_string(path, ',') AS path FROM found")
def d14_bfs_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.bfs_paths(_graph(spark, sf_dir, "dense")[1], pairs(spark, sf_dir)).select("src", "dst", F.array_join("path", ",").alias("path"))


#: Costs and numbers of edges until nothing changes, then the smallest of the best paths; a node with one link is on no path but at its ends.
CHEAPEST_SQL = """ends AS (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs), inner_ AS (SELECT source AS id FROM sym GROUP BY 1 HAVING count(DISTINCT target) > 1 UNION SELECT id FROM ends),
core AS (SELECT source, target, min(weight) AS weight FROM sym WHERE source IN (SELECT id FROM inner_) AND target IN (SELECT id FROM inner_) GROUP BY 1, 2),
best(src, node, cost, hops) USING KEY (src, node) AS (SELECT DISTINCT src, src, 0.0::DOUBLE, 0 FROM pairs
  UNION SELECT src, node, n.cost, n.hops FROM (
    SELECT a.src, e.target AS node, min(struct_pack(cost := a.cost + e.weight, hops := a.hops + 1)) AS n FROM best a JOIN core e ON a.node = e.source GROUP BY 1, 2) o
  LEFT JOIN recurring.best b USING (src, node) WHERE b.cost IS NULL OR n.cost < b.cost OR (n.cost = b.cost AND n.hops < b.hops)),
back(src, dst, node) AS (SELECT DISTINCT p.src, p.dst, p.dst FROM pairs p JOIN best b ON b.src = p.src AND b.node = p.dst
  UNION SELECT k.src, k.dst, u.node FROM back k JOIN best v ON v.src = k.src AND v.node = k.node JOIN core e ON e.target = k.node JOIN best u ON u.src = k.src AND u.node = e.source AND u.cost + e.weight = v.cost AND u.hops + 1 = v.hops),
ahead(src, dst, node, path) AS (SELECT DISTINCT src, dst, src, [src] FROM back
  UNION ALL SELECT src, dst, node, list_append(path, node) FROM (
    SELECT w.src, w.dst, w.path, min(k.node) AS node FROM ahead w JOIN best u ON u.src = w.src AND u.node = w.node JOIN core e ON e.source = w.node JOIN best v ON v.src = w.src AND v.node = e.target AND u.cost + e.weight = v.cost AND u.hops + 1 = v.hops
    JOIN back k ON k.src = w.src AND k.dst = w.dst AND k.node = e.target WHERE w.node <> w.dst GROUP BY 1, 2, 3))"""


@query(f"""{DENSE}, {PAIRS_SQL}, {CHEAPEST_SQL} SELECT p.src, p.dst, b.cost, coalesce(array_to_string(a.path, ','), '') AS path
FROM pairs p LEFT JOIN best b ON b.src = p.src AND b.node = p.dst LEFT JOIN ahead a ON a.src = p.src AND a.dst = p.dst AND a.node = p.dst""")
def d15_weighted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.weighted_paths(_graph(spark, sf_dir, "dense")[1], pairs(spark, sf_dir)).select("src", "dst", "cost", F.array_join("path", ",").alias("path"))


@query(f"{DENSE}, {PAIRS_SQL}, {bfs_sql()}, {PAYLOAD_SQL} SELECT src, dst, payload FROM payloads")
def d16_path_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, "dense")
    return paths.path_payload(cut_lineage(paths.bfs_paths(edges, pairs(spark, sf_dir))), nodes, edges)
