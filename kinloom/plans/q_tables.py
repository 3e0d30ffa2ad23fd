"""Queries of sources, sinks, ingestion checks and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.functions import masking
from kinloom.operators import ingest
from kinloom.plans import graph_view
from kinloom.plans.graph_view import read
from kinloom.plans.registry import query
from kinloom.sources import tables

VIEW = graph_view.view_sql("dense")
WEEKLY = graph_view.view_sql("weekly")


@query("SELECT c_custkey, c_name FROM customer")
def a1_read_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_source(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a2_normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return tables.normalize_columns(nation.toDF(*[f'"{c.upper()}"' for c in nation.columns]))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS label, '' AS entity_type FROM part")
def a3_load_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_nodes(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))


@query("""
SELECT DISTINCT l_suppkey::VARCHAR AS source, l_partkey::VARCHAR AS target,
       CASE WHEN l_returnflag IN ('A', 'R') OR l_linenumber = 7 THEN 1.0 ELSE l_quantity END AS weight
FROM lineitem WHERE l_suppkey <> l_partkey
""")
def a4_load_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    dirty = F.when(flag == "A", "no number").when(flag == "R", "NaN").when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity").cast("string"))
    return tables.load_edges(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), dirty.alias("weight")))


@query(r"SELECT regexp_replace(p_name, '\s+', '_', 'g') AS id, p_type FROM part")
def a5_load_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_strict(read(spark, sf_dir, "part").withColumnRenamed("p_name", "id"), ["id", "p_type"])


@query("SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_custkey IS NOT NULL")
def a6_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.distinct_ids(read(spark, sf_dir, "orders"), "o_custkey")


@query(f"WITH {VIEW} SELECT source, target, weight FROM edges")
def a7_read_edge_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tables.write_outputs({"edges": (graph_view.edges(spark, sf_dir).select("source", "target", "weight"), "csv")}, tables.scratch_path(spark, "csv"))
    return tables.read_edge_csv(spark, paths["edges"])


@query(f"""
WITH {WEEKLY} SELECT 'nodes' AS output, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'stats', count(DISTINCT entity_type) FROM nodes UNION ALL SELECT 'vectors', count(*) FROM embeddings
""")
def a8_write_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_view.nodes(spark, sf_dir, "weekly")
    made = {
        "nodes": (nodes, "csv"), "edges": (graph_view.edges(spark, sf_dir, "weekly"), "csv"), "stats": (nodes.groupBy("entity_type").count(), "json"), "vectors": (read(spark, sf_dir, "embeddings"), "parquet"),
    }
    paths = tables.write_outputs(made, tables.scratch_path(spark, "out"))
    out = None
    for name, (_, format) in made.items():
        reader = spark.read.option("header", True) if format == "csv" else spark.read
        one = reader.format(format).load(paths[name]).agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {VIEW} SELECT format, id, label, entity_type FROM nodes, (VALUES ('csv'), ('json'), ('parquet')) AS f(format)")
def a8_written_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers find in the written files, by format."""
    nodes = graph_view.nodes(spark, sf_dir).select("id", "label", "entity_type")
    formats = ("csv", "json", "parquet")
    paths = tables.write_outputs({f: (nodes, f) for f in formats}, tables.scratch_path(spark, "rows"))
    out = None
    for f in formats:
        options = {"header": "true"} if f == "csv" else {}
        one = tables.read_source(spark, paths[f], ["id", "label", "entity_type"], f, "id string, label string, entity_type string", **options)
        one = one.select(F.lit(f).alias("format"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'orders' AS metric, count(*) AS value FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') = '1996-01-02'")
def a9_run_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = read(spark, sf_dir, "orders").withColumn("run_date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tables.run_metric(spark, "SELECT 'orders' AS metric, count(*) AS value FROM {orders} WHERE run_date = :run_date", "1996-01-02", orders=dated)


# ingestion checks: orders are dossiers, their lines are mappings to suppliers


def _ingestion(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders").withColumn("run_date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    dossier = orders.select(F.col("o_orderkey").alias("dossier_id"), "run_date", F.when(F.col("o_orderstatus") == "O", "Y").otherwise("N").alias("is_current"))
    lines = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    mapping = lines.select(F.col("l_orderkey").alias("dossier_id"), F.col("l_suppkey").alias("internal_client_id"), F.when(F.col("l_returnflag") == "A", "other").otherwise("dossier").alias("source_table"), "run_date")
    unified = orders.select(F.when(F.col("o_orderstatus") == "F", "WX").otherwise("XX").alias("source"), "run_date")
    return dossier, mapping, unified


INGESTION = """
WITH dated AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS run_date FROM orders),
dossier AS (SELECT o_orderkey AS dossier_id, run_date, CASE WHEN o_orderstatus = 'O' THEN 'Y' ELSE 'N' END AS is_current FROM dated),
mapping AS (SELECT l_orderkey AS dossier_id, l_suppkey AS internal_client_id, CASE WHEN l_returnflag = 'A' THEN 'other' ELSE 'dossier' END AS source_table, run_date
            FROM lineitem JOIN dated ON l_orderkey = o_orderkey),
unified AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'WX' ELSE 'XX' END AS source, run_date FROM dated),
g1 AS (SELECT run_date, count(*) AS n FROM dossier GROUP BY 1),
g2 AS (SELECT run_date, count(*) AS n FROM mapping WHERE source_table = 'dossier' GROUP BY 1),
clients AS (SELECT run_date, dossier_id, count(DISTINCT internal_client_id) AS clients FROM mapping GROUP BY 1, 2 HAVING count(DISTINCT internal_client_id) > 1),
g3 AS (SELECT run_date, count(*) AS n FROM clients GROUP BY 1),
g4 AS (SELECT d.run_date, count(*) AS n FROM dossier d JOIN mapping m ON d.dossier_id = m.dossier_id AND d.run_date = m.run_date WHERE is_current = 'Y' GROUP BY 1),
g5 AS (SELECT run_date, count(*) AS n FROM unified WHERE source = 'WX' GROUP BY 1)"""


@query(INGESTION + " SELECT * FROM g1")
def g1_ingestion_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingestion_count(_ingestion(spark, sf_dir)[0])


@query(INGESTION + " SELECT * FROM g2")
def g2_raw_mapping_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.raw_mapping_count(_ingestion(spark, sf_dir)[1])


@query(INGESTION + " SELECT * FROM g3")
def g3_duplicate_mapping_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.duplicate_mapping_count(_ingestion(spark, sf_dir)[1])


@query(INGESTION + " SELECT * FROM g4")
def g4_filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.filtered_count(*_ingestion(spark, sf_dir)[:2])


@query(INGESTION + " SELECT * FROM g5")
def g5_loaded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.loaded_count(_ingestion(spark, sf_dir)[2])


@query(
    INGESTION
    + """, days AS (SELECT run_date FROM g1 UNION SELECT run_date FROM g2 UNION SELECT run_date FROM g5),
wide AS (SELECT run_date, coalesce(g1.n, 0) AS a, coalesce(g2.n, 0) AS b, coalesce(g2.n, 0) - coalesce(g3.n, 0) AS c, coalesce(g4.n, 0) AS d, coalesce(g5.n, 0) AS e
         FROM days LEFT JOIN g1 USING (run_date) LEFT JOIN g2 USING (run_date) LEFT JOIN g3 USING (run_date) LEFT JOIN g4 USING (run_date) LEFT JOIN g5 USING (run_date)),
long AS (SELECT run_date, a, 0 AS step, 'Ingested' AS stage, a AS n FROM wide UNION ALL SELECT run_date, a, 1, 'Mapped', b FROM wide UNION ALL SELECT run_date, a, 2, 'Deduped', c FROM wide
         UNION ALL SELECT run_date, a, 3, 'Filtered', d FROM wide UNION ALL SELECT run_date, a, 4, 'Loaded', e FROM wide)
SELECT run_date, step, stage, n, CASE WHEN a > 0 THEN round(100.0::DOUBLE * n / a, 4) END AS percent FROM long"""
)
def g6_ingestion_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingestion_funnel(*_ingestion(spark, sf_dir))


#: The named metrics of one day's ingestion, as a configuration states them.
DAY_METRICS = {
    "ingestion_count": "SELECT count(*) AS value FROM {dossier} WHERE run_date = :run_date",
    "raw_mapping_count": "SELECT count(*) AS value FROM {mapping} WHERE source_table = 'dossier' AND run_date = :run_date",
    "duplicate_mapping_count": """SELECT count(*) AS value FROM (
        SELECT dossier_id FROM {mapping} WHERE run_date = :run_date GROUP BY dossier_id HAVING count(DISTINCT internal_client_id) > 1)""",
    "filtered_count": "SELECT count(*) AS value FROM {dossier} JOIN {mapping} USING (dossier_id, run_date) WHERE is_current = 'Y' AND run_date = :run_date",
    "loaded_count": "SELECT count(*) AS value FROM {unified} WHERE source = 'WX' AND run_date = :run_date",
}
DAY = "1996-01-02"


@query(
    INGESTION
    + f""", named AS (SELECT 'ingestion_count' AS metric, * FROM g1 UNION ALL SELECT 'raw_mapping_count', * FROM g2 UNION ALL SELECT 'duplicate_mapping_count', * FROM g3
UNION ALL SELECT 'filtered_count', * FROM g4 UNION ALL SELECT 'loaded_count', * FROM g5)
SELECT metric, '{DAY}' AS run_date, coalesce(sum(n) FILTER (WHERE run_date = '{DAY}'), 0)::DOUBLE AS value FROM named GROUP BY 1"""
)
def a9_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    dossier, mapping, unified = _ingestion(spark, sf_dir)
    return tables.run_metrics(spark, DAY_METRICS, DAY, dossier=dossier, mapping=mapping, unified=unified)


@query(INGESTION + " SELECT * FROM clients ORDER BY clients DESC, dossier_id, run_date LIMIT 50")
def g7_duplicate_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.duplicate_mappings(_ingestion(spark, sf_dir)[1])


# masking: profiles assembled from customers and their orders


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested profile per customer, with nulls, empty texts, lists and maps among them."""
    vs = lambda value, source: F.struct(value.cast("string").alias("value"), source.alias("source"))
    c, word = F.col("c_custkey"), F.lit("crm")
    some = lambda k, x: F.when(c % k == 0, F.lit("")).when(c % k == 1, F.lit(None)).otherwise(x.cast("string"))
    items = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("items"))
    base = read(spark, sf_dir, "customer").join(items, c == F.col("o_custkey"), "left")
    listed = F.coalesce("items", F.array().cast("array<struct<o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string>>"))
    status = lambda x: F.when(x["o_orderstatus"] == "P", "").otherwise(x["o_orderstatus"])
    connection = F.transform(listed, lambda x: F.struct(F.concat(F.lit("n"), x["o_orderkey"]).alias("name"), x["o_orderpriority"].alias("group"), status(x).alias("relationship_type"), word.alias("source")))
    worth = F.create_map(F.lit("cash"), F.transform(listed, lambda x: vs(x["o_orderkey"], word)), F.lit("art"), F.array().cast("array<struct<value:string,source:string>>"))
    return base.select(
        c.alias("id"), (c * 7).alias("fa_id"), F.lit("2020-01-01").alias("added_on"), some(5, F.col("c_mktsegment")).alias("fa_name"), some(4, F.col("c_name")).alias("name"), some(3, word).alias("name_source"),
        (F.col("c_acctbal") / 10000).alias("completeness_score"), (F.col("c_acctbal") > 0).alias("is_favourite"),
        F.struct(vs(F.col("c_name"), word).alias("name"), vs(some(3, F.col("c_mktsegment")), word).alias("industry"), F.struct(some(6, word).alias("city"), F.lit("x").alias("state"), word.alias("source")).alias("address"), F.lit("12 Road").alias("business_address"), vs(F.lit("5"), word).alias("annual_revenue")).alias("business_information"),
        F.struct(F.transform(listed, lambda x: F.struct(x["o_orderpriority"].alias("type"), F.lit("f").alias("company"), word.alias("source"))).alias("career_history"), vs(F.col("c_mktsegment"), word).alias("career_highlights")).alias("career"),
        F.struct(F.create_map(F.lit("gives"), F.col("c_acctbal") > 0, F.lit("leads"), F.when(c % 3 > 0, False)).alias("charitable_giving_checklist"), vs(some(2, word), word).alias("philanthropy_profile")).alias("charitable_activity"),
        connection.alias("connections"), worth.alias("net_worth"),
        F.transform(listed, lambda x: F.struct(x["o_orderpriority"].alias("institution"), status(x).alias("qualification"), F.lit("2001-09-01").alias("start_date"), word.alias("source"))).alias("education"),
        F.struct(F.transform(listed, lambda x: F.struct(F.concat(F.lit("m"), x["o_orderkey"]).alias("name"), F.lit("44").alias("age"), status(x).alias("relationship"), word.alias("source"))).alias("members")).alias("family_details"),
        F.struct(word.alias("source"), F.transform(listed, lambda x: F.struct(x["o_orderpriority"].alias("name"), F.lit("aunt").alias("relationship"), word.alias("source"))).alias("value")).alias("family_office"),
        F.struct(word.alias("source"), F.transform(listed, lambda x: F.struct(F.lit("9").alias("total_assets"), status(x).alias("phone"), F.lit("1999").alias("year"))).alias("value")).alias("private_foundation"),
        F.struct(F.transform(listed, lambda x: vs(x["o_orderpriority"], word)).alias("interests"), vs(some(4, F.col("c_name")), word).alias("interests_remarks")).alias("interests"),
        F.struct(vs(F.lit("40"), word).alias("age"), vs(some(4, F.col("c_name")), word).alias("bio"), vs(F.lit("12 Road"), word).alias("location"), vs(some(6, word), word).alias("marital_status")).alias("personal_details"),
        F.transform(listed, lambda x: F.struct(F.lit("3").alias("taxes"), status(x).alias("property_type"), x["o_orderpriority"].alias("mortgage_lender"), F.lit("8").alias("est_market_value"))).alias("real_estate"),
    )


def number_sql(key: str, salt: str, low: int, high: int) -> str:
    return f"(('0x' || substr(md5({key} || '|{salt}'), 1, 8))::UBIGINT::BIGINT % {high - low + 1} + {low})"


def pick_sql(key: str, salt: str, pool: list[str]) -> str:
    return f"(['{"', '".join(pool)}'])[{number_sql(key, salt, 0, len(pool) - 1)} + 1]"


def fake_sql(kind: str, key: str) -> str:
    """The same made-up value in SQL, for the kinds that the checks use."""
    name, *bounds = kind.split(":")
    m, word = masking, pick_sql(key, "w", masking.WORDS)
    cap = lambda x: f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"
    span = number_sql(key, "n", *map(int, bounds)) if bounds else ""
    return {
        "name": lambda: f"{pick_sql(key, 'first', m.FIRST)} || ' ' || {pick_sql(key, 'last', m.LAST)}", "word": lambda: word, "company": lambda: f"{cap(word)} || ' ' || {pick_sql(key, 'firm', m.FIRMS)}",
        "university": lambda: f"{cap(word)} || ' ' || {pick_sql(key, 'firm', m.FIRMS)} || ' University'",
        "city": lambda: pick_sql(key, "city", m.CITIES), "state": lambda: pick_sql(key, "state", m.STATES), "country": lambda: pick_sql(key, "country", m.COUNTRIES), "postcode": lambda: f"lpad({number_sql(key, 'zip', 0, 99999)}::VARCHAR, 5, '0')",
        "address": lambda: f"{number_sql(key, 'no', 1, 999)} || ' ' || {cap(word)} || ' Street, ' || {pick_sql(key, 'city', m.CITIES)}", "job": lambda: pick_sql(key, "job", m.JOBS),
        "date": lambda: f"strftime(DATE '1970-01-01' + {number_sql(key, 'day', 0, 19000)}::INT, '%Y-%m-%d')", "year": lambda: f"{number_sql(key, 'year', 1970, 2024)}::VARCHAR",
        "sentence": lambda: f"{cap(pick_sql(key, 'a', m.WORDS))} || ' ' || {pick_sql(key, 'b', m.WORDS)} || ' ' || {pick_sql(key, 'c', m.WORDS)} || '.'", "phone": lambda: f"'555-' || lpad({number_sql(key, 'tel', 0, 9999)}::VARCHAR, 4, '0')",
        "degree": lambda: pick_sql(key, "degree", m.DEGREES), "industry": lambda: pick_sql(key, "industry", m.INDUSTRIES), "relation": lambda: pick_sql(key, "relation", m.RELATIONS), "marital": lambda: pick_sql(key, "marital", m.MARITAL),
        "range": lambda: f"{span}::VARCHAR", "millions": lambda: f"'$' || {span} || 'M'", "thousands": lambda: f"'$' || {span} || 'K'", "hundred_thousands": lambda: f"'$' || {span} || '00K'",
        "id10": lambda: f"{number_sql(key, 'head', 1, 9)} || lpad({number_sql(key, 'tail', 0, 999999999)}::VARCHAR, 9, '0')", "id6": lambda: f"{number_sql(key, 'n', 0, 999999)}::VARCHAR",
        "flag": lambda: f"({number_sql(key, 'n', 0, 1)} = 1)",
    }[name]()


def kept_or(original: str, new: str) -> str:
    return f"CASE WHEN {original} IS NULL OR {original} = '' THEN {original} ELSE {new} END"


KINDS = ["name", "word", "company", "city", "state", "country", "postcode", "address", "job", "date", "year", "sentence", "phone", "degree", "industry", "relation", "marital", "range:18:80", "millions:1:50", "thousands:1:5", "hundred_thousands:1:5", "id10", "id6"]

PROFILE_SQL = """
WITH p AS (SELECT c_custkey AS id, '0|' || c_custkey AS k, c_name, c_mktsegment, c_acctbal,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_mktsegment END AS fa_name,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS name,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'crm' END AS name_source,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_mktsegment END AS industry,
  CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'crm' END AS city,
  CASE WHEN c_custkey % 3 > 0 THEN false END AS leads FROM customer),
o AS (SELECT p.*, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY id ORDER BY o_orderkey, o_orderpriority, o_orderstatus) - 1 AS pos
      FROM p JOIN orders ON o_custkey = id)"""


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE 'new' END AS text_out, CASE WHEN p_size % 5 > 0 THEN '-1' ELSE 'none' END AS number_out,
       CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS list_size FROM part
""")
def h1_replace_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    part = read(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_name"))
    listed = F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", "p_type"))
    whole = F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 5 - 1)  # zero is replaced
    return part.select(
        "p_partkey", masking.replace_if(text, F.lit("new"), T.StringType()).alias("text_out"), F.coalesce(masking.replace_if(whole, F.lit(-1), T.IntegerType()).cast("string"), F.lit("none")).alias("number_out"),
        F.size(masking.replace_if(listed, F.array(F.lit("one")), T.ArrayType(T.StringType()))).alias("list_size"),
    )


@query("SELECT c_custkey, " + ", ".join(f"{fake_sql(kind, "('0|' || c_custkey)")} AS {kind.split(':')[0]}_" for kind in KINDS) + " FROM customer")
def h2_fake_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.lit("0"), F.col("c_custkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", *[masking.fake_value(kind, key).alias(kind.split(":")[0] + "_") for kind in KINDS])


@query(f"""{PROFILE_SQL} SELECT ({fake_sql("id10", "(k || '|id')")})::BIGINT AS id, ({fake_sql("id6", "(k || '|fa_id')")})::BIGINT AS fa_id, {fake_sql("date", "(k || '|added_on')")} AS added_on,
{kept_or("fa_name", fake_sql("name", "(k || '|fa_name')"))} AS fa_name, {fake_sql("flag", "(k || '|is_favourite')")} AS is_favourite FROM p""")
def h3_mask_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_profiles(profiles(spark, sf_dir)).select("id", "fa_id", "added_on", "fa_name", "is_favourite")


@query(f"""{PROFILE_SQL} SELECT id, {kept_or("name", fake_sql("name", "(k || '|name.value')"))} AS value, {kept_or("coalesce(name_source, '')", fake_sql("word", "(k || '|name.source')"))} AS source FROM p""")
def h4_mask_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.lit("0"), F.col("id").cast("string"))
    return profiles(spark, sf_dir).select("id", masking.mask_name(F.col("name"), F.col("name_source"), key).alias("n")).select("id", "n.value", "n.source")


@query(f"""{PROFILE_SQL} SELECT id, {fake_sql("company", "(k || '|business_information.name.value')")} AS company, {kept_or("industry", fake_sql("industry", "(k || '|business_information.industry.value')"))} AS industry,
{kept_or("city", fake_sql("city", "(k || '|business_information.address.city')"))} AS city, {fake_sql("address", "(k || '|business_information.business_address')")} AS business_address,
{fake_sql("millions:1:50", "(k || '|business_information.annual_revenue.value')")} AS revenue, {fake_sql("word", "(k || '|business_information.name.source')")} AS source FROM p""")
def h5_mask_struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_columns(profiles(spark, sf_dir), {"business_information": masking.PROFILE["business_information"]})
    b = "business_information"
    return out.select("id", F.col(f"{b}.name.value").alias("company"), F.col(f"{b}.industry.value").alias("industry"), F.col(f"{b}.address.city").alias("city"), f"{b}.business_address", F.col(f"{b}.annual_revenue.value").alias("revenue"), F.col(f"{b}.name.source").alias("source"))


@query(f"""{PROFILE_SQL}, q AS (SELECT *, k || '|' || pos AS kp FROM o) SELECT id, pos::INT AS pos, {fake_sql("name", "(kp || '|connections.name')")} AS name, {fake_sql("word", "(kp || '|connections.group')")} AS "group",
CASE WHEN o_orderstatus = 'P' THEN '' ELSE {fake_sql("word", "(kp || '|connections.relationship_type')")} END AS relationship_type, {fake_sql("job", "(kp || '|career.career_history.type')")} AS job, 'crm' AS career_source FROM q""")
def h6_mask_array_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_columns(profiles(spark, sf_dir), {c: masking.PROFILE[c] for c in ("connections", "career")})
    both = F.arrays_zip("connections", F.col("career.career_history").alias("history"))
    return out.select("id", F.posexplode(both).alias("pos", "x")).select("id", "pos", "x.connections.name", "x.connections.group", "x.connections.relationship_type", F.col("x.history.type").alias("job"), F.col("x.history.source").alias("career_source"))


def _listed(out: DataFrame, *columns: F.Column) -> DataFrame:
    """id, pos and x: one row per place of the lists, side by side as x.l0, x.l1, .."""
    both = F.arrays_zip(*[c.alias(f"l{k}") for k, c in enumerate(columns)])
    return out.select("id", F.posexplode(both).alias("pos", "x"))


STATUS = "CASE WHEN o_orderstatus = 'P' THEN '' ELSE {} END"


@query(f"""{PROFILE_SQL}, q AS (SELECT *, k || '|' || pos AS kp FROM o) SELECT id, pos::INT AS pos, {fake_sql("university", "(kp || '|education.institution')")} AS institution,
{STATUS.format(fake_sql("degree", "(kp || '|education.qualification')"))} AS qualification, {fake_sql("date", "(kp || '|education.start_date')")} AS start_date, {fake_sql("thousands:1:5", "(kp || '|real_estate.taxes')")} AS taxes,
{STATUS.format(fake_sql("word", "(kp || '|real_estate.property_type')"))} AS property_type, {fake_sql("company", "(kp || '|real_estate.mortgage_lender')")} AS lender, {fake_sql("thousands:200:1000", "(kp || '|real_estate.est_market_value')")} AS market_value FROM q""")
def h6_mask_education_and_estate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_columns(profiles(spark, sf_dir), {c: masking.PROFILE[c] for c in ("education", "real_estate")})
    x = _listed(out, F.col("education"), F.col("real_estate"))
    return x.select("id", "pos", "x.l0.institution", "x.l0.qualification", "x.l0.start_date", "x.l1.taxes", "x.l1.property_type", F.col("x.l1.mortgage_lender").alias("lender"), F.col("x.l1.est_market_value").alias("market_value"))


@query(f"""{PROFILE_SQL}, q AS (SELECT *, k || '|' || pos AS kp FROM o) SELECT id, pos::INT AS pos, {fake_sql("name", "(kp || '|family_details.members.name')")} AS member, {fake_sql("range:0:100", "(kp || '|family_details.members.age')")} AS age,
{STATUS.format(fake_sql("relation", "(kp || '|family_details.members.relationship')"))} AS relationship, {fake_sql("name", "(kp || '|family_office.value.name')")} AS officer, {fake_sql("millions:1:50", "(kp || '|private_foundation.value.total_assets')")} AS assets,
{STATUS.format(fake_sql("phone", "(kp || '|private_foundation.value.phone')"))} AS phone, {fake_sql("word", "(kp || '|interests.interests.value')")} AS interest FROM q""")
def h6_mask_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_columns(profiles(spark, sf_dir), {c: masking.PROFILE[c] for c in ("family_details", "family_office", "private_foundation", "interests")})
    x = _listed(out, F.col("family_details.members"), F.col("family_office.value"), F.col("private_foundation.value"), F.col("interests.interests"))
    return x.select("id", "pos", F.col("x.l0.name").alias("member"), "x.l0.age", "x.l0.relationship", F.col("x.l1.name").alias("officer"), F.col("x.l2.total_assets").alias("assets"), "x.l2.phone", F.col("x.l3.value").alias("interest"))


@query(f"""{PROFILE_SQL} SELECT id, {fake_sql("range:18:80", "(k || '|personal_details.age.value')")} AS age, {kept_or("name", fake_sql("sentence", "(k || '|personal_details.bio.value')"))} AS bio, {fake_sql("address", "(k || '|personal_details.location.value')")} AS location,
{kept_or("city", fake_sql("marital", "(k || '|personal_details.marital_status.value')"))} AS marital_status, {kept_or("name", fake_sql("sentence", "(k || '|interests.interests_remarks.value')"))} AS remarks FROM p""")
def h5_mask_personal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_columns(profiles(spark, sf_dir), {c: masking.PROFILE[c] for c in ("personal_details", "interests")})
    return out.select("id", *[F.col(f"personal_details.{c}.value").alias(c) for c in ("age", "bio", "location", "marital_status")], F.col("interests.interests_remarks.value").alias("remarks"))


@query(f"""{PROFILE_SQL}, q AS (SELECT *, k || '|cash|' || pos AS kp FROM o) SELECT id, 'cash' AS section, pos::INT AS pos, {fake_sql("millions:1:20", "(kp || '|net_worth.value')")} AS value, {fake_sql("word", "(kp || '|net_worth.source')")} AS source FROM q""")
def h7_mask_map_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_columns(profiles(spark, sf_dir), {"net_worth": masking.PROFILE["net_worth"]})
    return out.select("id", F.explode("net_worth").alias("section", "list")).select("id", "section", F.posexplode("list").alias("pos", "x")).select("id", "section", "pos", "x.value", "x.source")


@query(f"""{PROFILE_SQL} SELECT id, {fake_sql("flag", "(k || '|gives|charitable_activity.charitable_giving_checklist')")} AS gives,
CASE WHEN leads IS NOT NULL THEN {fake_sql("flag", "(k || '|leads|charitable_activity.charitable_giving_checklist')")} END AS leads FROM p""")
def h8_mask_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_columns(profiles(spark, sf_dir), {"charitable_activity": masking.PROFILE["charitable_activity"]})
    marks = F.col("charitable_activity.charitable_giving_checklist")
    return out.select("id", marks["gives"].alias("gives"), marks["leads"].alias("leads"))


@query(f"""{PROFILE_SQL}, n AS (SELECT id, count(*) AS n FROM o GROUP BY 1)
SELECT ({fake_sql("id10", "(k || '|id')")})::BIGINT AS id, {kept_or("name", fake_sql("name", "(k || '|name.value')"))} AS name, {fake_sql("company", "(k || '|business_information.name.value')")} AS company,
{fake_sql("sentence", "(k || '|career.career_highlights.value')")} AS highlights, coalesce(n, 0)::INT AS n_connections FROM p LEFT JOIN n USING (id)""")
def h9_mask_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_profiles(profiles(spark, sf_dir))
    return out.select("id", F.col("name.value").alias("name"), F.col("business_information.name.value").alias("company"), F.col("career.career_highlights.value").alias("highlights"), F.size("connections").alias("n_connections"))
