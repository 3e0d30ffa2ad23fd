"""A relationship graph over the given tables: customers and suppliers as people and advisors.

Every order line links its customer to an organisation, so customers who got the same part share
one.  Variants:

* *dense*: organisations are parts, customers with a negative balance are prospects.
* *yearly*: the same prospects, an organisation is a part's deliveries of one year; for the listing of
  paths, whose number grows with the square of an organisation's customers.
* *layered*: organisations as in *yearly*, nearly all customers are prospects, so clients are several
  hops away from many of them.
* *territorial*: as *yearly*, and a customer's nation is an organisation, too: one that all prospects
  and clients of a nation share.
* *weekly*: prospects as in *dense*, an organisation is a part's deliveries of one week, so there are
  nearly as many as order lines and several components. Lines without a date, and parts without lines,
  have the part itself as organisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Which customers are prospects, whether organisations are parts' years or weeks, and whether nations are organisations.
VARIANTS = {
    "dense": ("c_acctbal < 0", None, False),
    "yearly": ("c_acctbal < 0", "year", False),
    "layered": ("c_acctbal <= 9800", "year", False),
    "territorial": ("c_acctbal < 0", "year", True),
    "weekly": ("c_acctbal < 0", "week", False),
}
#: Weeks are counted from here.
FIRST_DAY = "1992-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    prospect = F.expr(VARIANTS[variant][0])
    return read(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_name", F.concat(F.when(prospect, "p").otherwise("c"), "c_custkey").alias("id"),
        F.when(prospect, "Prospect").otherwise("Client").alias("entity_type"), F.col("c_acctbal").alias("networth"),
    )


def _lines(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    """Order lines with org, their organisation's id."""
    part = F.concat(F.lit("o"), "l_partkey")
    week = F.floor(F.datediff("l_shipdate", F.lit(FIRST_DAY).cast("date")) / 7)
    org = {None: part, "year": F.concat(part, F.lit("y"), F.year("l_shipdate")), "week": F.concat(part, F.coalesce(F.concat(F.lit("w"), week), F.lit("")))}
    return read(spark, sf_dir, "lineitem").withColumn("org", org[VARIANTS[variant][1]])


def nodes(spark: SparkSession, sf_dir: str, variant: str = "dense") -> DataFrame:
    """id, label, entity_type, networth."""
    people = _customers(spark, sf_dir, variant).select("id", F.col("c_name").alias("label"), "entity_type", "networth")
    none = F.lit(None).cast("double").alias("networth")
    orgs, org, how = _lines(spark, sf_dir, variant).select("org", "l_partkey").distinct(), F.col("org"), "inner"
    if VARIANTS[variant][1] == "week":
        orgs, org, how = orgs.where("org is not null"), F.coalesce("org", F.concat(F.lit("o"), "p_partkey")), "full"
    parts = orgs.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), how).select(org.alias("id"), F.col("p_name").alias("label"), F.lit("Organization").alias("entity_type"), none)
    if VARIANTS[variant][2]:
        parts = parts.unionByName(read(spark, sf_dir, "nation").select(F.concat(F.lit("on"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("Organization").alias("entity_type"), none))
    advisors = read(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("Advisor").alias("entity_type"), none)
    return people.unionByName(parts).unionByName(advisors)


def edges(spark: SparkSession, sf_dir: str, variant: str = "dense") -> DataFrame:
    """source, target, weight, edge_detail, edge_seq: one row per pair, weights in quarters."""
    people = _customers(spark, sf_dir, variant)
    bought = (
        _lines(spark, sf_dir, variant).join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "org")
        .agg(F.max(F.ceil(F.col("l_quantity") / 12.5) / 4).alias("weight"), F.min("o_orderpriority").alias("edge_detail"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_seq"))
    )
    held = bought.join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("id").alias("source"), F.col("org").alias("target"), "weight", "edge_detail", "edge_seq")
    if VARIANTS[variant][2]:
        held = held.unionByName(people.select(F.col("id").alias("source"), F.concat(F.lit("on"), "c_nationkey").alias("target"), F.lit(0.5).alias("weight"), F.lit("lives in").alias("edge_detail"), (F.col("c_custkey") + 2_000_000_000_000).alias("edge_seq")))
    first = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s"))
    advised = people.where("entity_type = 'Client'").join(first, F.col("c_nationkey") == F.col("s_nationkey"))
    return held.unionByName(
        advised.select(F.col("id").alias("source"), F.concat(F.lit("a"), "s").alias("target"), F.lit(1.0).alias("weight"), F.lit("advised by").alias("edge_detail"), (F.col("c_custkey") + 1_000_000_000_000).alias("edge_seq"))
    )


def view_sql(variant: str = "dense") -> str:
    """CTEs people, nodes, edges and sym (both directions) of the same graph, without WITH."""
    prospect, period, territorial = VARIANTS[variant]
    week = f"floor(date_diff('day', DATE '{FIRST_DAY}', l_shipdate::DATE) / 7)::BIGINT"
    org = "'o' || l_partkey" + {None: "", "year": " || 'y' || year(l_shipdate::DATE)", "week": f" || coalesce('w' || {week}, '')"}[period]
    parts = "SELECT org, p_name, 'Organization', NULL FROM (SELECT DISTINCT org, l_partkey FROM lines) JOIN part ON l_partkey = p_partkey"
    if period == "week":
        parts = "SELECT coalesce(org, 'o' || p_partkey), p_name, 'Organization', NULL FROM (SELECT DISTINCT org, l_partkey FROM lines WHERE org IS NOT NULL) FULL JOIN part ON l_partkey = p_partkey"
    nations = "UNION ALL SELECT 'on' || n_nationkey, n_name, 'Organization', NULL FROM nation" if territorial else ""
    living = "UNION ALL SELECT id, 'on' || c_nationkey, 0.5, 'lives in', c_custkey + 2000000000000 FROM people" if territorial else ""
    return f"""
lines AS (SELECT *, {org} AS org FROM lineitem),
people AS (SELECT c_custkey, c_nationkey, c_name, CASE WHEN {prospect} THEN 'p' ELSE 'c' END || c_custkey AS id,
                  CASE WHEN {prospect} THEN 'Prospect' ELSE 'Client' END AS entity_type, c_acctbal AS networth FROM customer),
nodes AS (SELECT id, c_name AS label, entity_type, networth FROM people
          UNION ALL {parts} {nations}
          UNION ALL SELECT 'a' || s_suppkey, s_name, 'Advisor', NULL FROM supplier),
bought AS (SELECT o_custkey, org, max(ceil(l_quantity / 12.5) / 4) AS weight, min(o_orderpriority) AS edge_detail,
                  min(l_orderkey * 10 + l_linenumber) AS edge_seq
           FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
edges AS (SELECT id AS source, org AS target, weight, edge_detail, edge_seq FROM bought JOIN people ON o_custkey = c_custkey {living}
          UNION ALL
          SELECT id, 'a' || s, 1.0, 'advised by', c_custkey + 1000000000000
          FROM people JOIN (SELECT s_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY 1) f ON c_nationkey = s_nationkey
          WHERE entity_type = 'Client'),
sym AS (SELECT source, target, weight, edge_detail, edge_seq FROM edges UNION ALL SELECT target, source, weight, edge_detail, edge_seq FROM edges)"""


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (customer, part, order line) as an edge; those of returned lines run from part to customer."""
    people = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.expr(VARIANTS["dense"][0]), "p").otherwise("c"), "c_custkey").alias("id"))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.groupBy("o_custkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_seq")).agg(F.max(F.ceil(F.col("l_quantity") / 12.5) / 4).alias("weight"), F.min("l_returnflag").alias("edge_detail"))
    part, back = F.concat(F.lit("o"), "l_partkey"), F.col("edge_detail") == "R"
    return rows.join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.when(back, part).otherwise(F.col("id")).alias("source"), F.when(back, F.col("id")).otherwise(part).alias("target"), "weight", "edge_detail", "edge_seq")


PURCHASES_SQL = """
bought AS (SELECT o_custkey, l_partkey, l_orderkey * 10 + l_linenumber AS edge_seq, max(ceil(l_quantity / 12.5) / 4) AS weight, min(l_returnflag) AS edge_detail
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
named AS (SELECT CASE WHEN c_acctbal < 0 THEN 'p' ELSE 'c' END || c_custkey AS id, 'o' || l_partkey AS part, weight, edge_detail, edge_seq FROM bought JOIN customer ON o_custkey = c_custkey),
purchases AS (SELECT CASE WHEN edge_detail = 'R' THEN part ELSE id END AS source, CASE WHEN edge_detail = 'R' THEN id ELSE part END AS target, weight, edge_detail, edge_seq FROM named)"""


def shared_edges(spark: SparkSession, sf_dir: str, variant: str = "dense") -> DataFrame:
    """Customer-organisation pairs of all order lines: one component in *dense*; in *weekly* one holds most customers, others are alone with their organisations."""
    return edges(spark, sf_dir, variant).where(F.col("target").startswith("o")).select("source", "target", F.lit(1.0).alias("weight"))


def shared_sql(variant: str = "dense") -> str:
    """CTEs of the view, pairs, links and component by label propagation: a node's label is the smallest one met so far."""
    return f"""
{view_sql(variant)},
pairs AS (SELECT source, target FROM edges WHERE target[1] = 'o'),
links AS (SELECT source, target FROM pairs UNION ALL SELECT target, source FROM pairs),
label(node, component) USING KEY (node) AS (
  SELECT DISTINCT source, source FROM links
  UNION SELECT l.target, min(a.component) FROM label a JOIN links l ON a.node = l.source JOIN recurring.label b ON b.node = l.target WHERE a.component < b.component GROUP BY 1),
component AS (SELECT node, component FROM label)"""


def territory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers to their nations, nations to their regions: a component per region, with hubs."""
    rows = [("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    out = None
    for table, a, source, b, target in rows:
        df = read(spark, sf_dir, table).select(F.concat(F.lit(a), source).alias("source"), F.concat(F.lit(b), target).alias("target"), F.lit(1.0).alias("weight"))
        out = df if out is None else out.unionByName(df)
    return out


#: nearest holds the distance of all pairs in one component.
TERRITORY_SQL = """
pairs AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
links AS (SELECT source, target FROM pairs UNION ALL SELECT target, source FROM pairs),
hops(start, node, d) USING KEY (start, node) AS (SELECT DISTINCT source, source, 0 FROM links
  UNION SELECT a.start, l.target, min(a.d + 1) FROM hops a JOIN links l ON a.node = l.source LEFT JOIN recurring.hops b ON b.start = a.start AND b.node = l.target WHERE b.d IS NULL GROUP BY 1, 2),
reached AS (SELECT start, min(node) AS component, count(*) AS size, max(d) AS far, sum(d) AS total FROM hops GROUP BY 1),
lengths AS (SELECT component, max(size) AS size, max(far) AS diameter, sum(total)::DOUBLE / (max(size) * (max(size) - 1)) AS avg_path FROM reached GROUP BY 1)"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (client, prospect, organisation of both): the connections report's input."""
    people = _customers(spark, sf_dir, "dense").select("id", "c_custkey", "c_nationkey", "c_name", "networth")
    held = edges(spark, sf_dir).where(F.col("target").startswith("o"))
    client = held.join(people, F.col("source") == F.col("id")).where(F.col("id").startswith("c")).select(F.col("id").alias("client_id"), F.col("c_custkey").alias("ck"), F.col("c_name").alias("client_name"), F.when(F.col("c_nationkey") < 5, 1).otherwise(0).alias("client_is_fav"), F.col("networth").alias("client_est_nw"), "target", F.col("weight").alias("cw"), F.col("edge_detail").alias("client_org_relation"))
    other = held.join(people, F.col("source") == F.col("id")).where(F.col("id").startswith("p")).select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("connection_name"), F.when(F.col("networth") > -900, F.col("networth")).alias("connection_est_nw"), "target", F.col("weight").alias("pw"), F.col("edge_detail").alias("conn_org_relation"))
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("o"), "p_partkey").alias("target"), F.concat("p_name", F.lit(" "), "p_partkey").alias("organization"), F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("org_type"))
    both = client.join(other, "target").join(parts, "target")
    return both.select(
        "client_id", "client_name", "client_is_fav", F.concat(F.lit("ace "), F.col("ck") % 7).alias("primary_ace"), (F.col("client_est_nw") * 10).alias("est_aum"), "client_est_nw", "connection_name", "connection_est_nw",
        "organization", "org_type", (F.col("cw") * F.col("pw")).alias("score"), "client_org_relation", "conn_org_relation", F.concat_ws("|", F.lpad(F.col("ck").cast("string"), 12, "0"), F.lpad(F.col("pk").cast("string"), 12, "0"), "target").alias("seq"),
    )


CONNECTIONS_SQL = f"""
{view_sql("dense")},
connections AS (
  SELECT c.id AS client_id, c.c_name AS client_name, CASE WHEN c.c_nationkey < 5 THEN 1 ELSE 0 END AS client_is_fav, 'ace ' || (c.c_custkey % 7) AS primary_ace,
         c.networth * 10 AS est_aum, c.networth AS client_est_nw, p.c_name AS connection_name, CASE WHEN p.networth > -900 THEN p.networth END AS connection_est_nw,
         p_name || ' ' || p_partkey AS organization, CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS org_type, e.weight * f.weight AS score,
         e.edge_detail AS client_org_relation, f.edge_detail AS conn_org_relation, lpad(c.c_custkey::VARCHAR, 12, '0') || '|' || lpad(p.c_custkey::VARCHAR, 12, '0') || '|' || e.target AS seq
  FROM edges e JOIN people c ON e.source = c.id AND c.id[1] = 'c' JOIN edges f ON e.target = f.target JOIN people p ON f.source = p.id AND p.id[1] = 'p'
  JOIN part ON e.target = 'o' || p_partkey)"""
