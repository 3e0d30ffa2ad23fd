"""Queries of walks, embeddings, similarity search and message passing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.operators import gin, neighbours, prep, similarity, skipgram, walks
from kinloom.operators.skew import cut_lineage
from kinloom.plans import graph_view as view
from kinloom.plans.q_paths import PAYLOAD_SQL, bfs_sql
from kinloom.plans.registry import query

LAYERED = "WITH RECURSIVE " + view.view_sql("layered")
DENSE = "WITH RECURSIVE " + view.view_sql("dense")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")


VECTORS = """
v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS size, label FROM embeddings),
u AS (SELECT id, label, CASE WHEN size > 0 THEN list_transform(e, lambda x: x / size) ELSE e END AS e FROM v)"""


def walks_sql(steps: int, num_walks: int, seed: int, weighted: bool = True, p: float = 1.0, q: float = 1.0, tries: int = 64, people: bool = False) -> str:
    """CTEs w0..w<steps>: the walks after each step, one CTE a step; a biased step takes the first accepted of ``tries`` proposals."""
    weight, most = "sum(weight)" if weighted else "1.0::DOUBLE", max(1.0, 1 / p, 1 / q)
    out = [f"adj AS (SELECT source, target, {weight} AS weight FROM sym GROUP BY 1, 2)"]
    out.append("cum AS (SELECT source, target, sum(weight) OVER o AS high, sum(weight) OVER o - weight AS low, sum(weight) OVER (PARTITION BY source) AS total FROM adj WINDOW o AS (PARTITION BY source ORDER BY target))")
    out.append(f"w0 AS (SELECT id AS start, walk_no, [id] AS walk, id AS head, NULL AS prev FROM (SELECT DISTINCT source AS id FROM adj{" WHERE source[1] <> 'o'" if people else ""}), range({num_walks}) r(walk_no))")
    luck = lambda k, t, more="": f"((('0x' || substr(md5('{seed}|' || start || '|' || walk_no || '|{k}|' || {t}{more}), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)"
    for k in range(1, steps + 1):
        biased = k > 1 and not p == q == 1.0
        tried = f"(SELECT * FROM w{k - 1}, range(1, {tries + 1}) r(try))" if biased else f"(SELECT *, 1 AS try FROM w{k - 1})"
        out.append(f"o{k} AS (SELECT start, walk_no, walk, head, prev, try, c.target AS next FROM (SELECT *, {luck(k, 'try')} AS u FROM {tried}) w JOIN cum c ON w.head = c.source AND u * total >= low AND u * total < high)")
        if biased:
            bias = f"CASE WHEN next = prev THEN {1 / p} WHEN near.target IS NOT NULL THEN 1.0 ELSE {1 / q} END"
            accept = luck(k, "try", " || '|accept'")
            out.append(f"a{k} AS (SELECT o.* FROM o{k} o LEFT JOIN adj near ON near.source = prev AND near.target = next WHERE {accept} * {most} < {bias} QUALIFY row_number() OVER (PARTITION BY start, walk_no ORDER BY try) = 1)")
        out.append(f"w{k} AS (SELECT start, walk_no, list_append(walk, next) AS walk, next AS head, head AS prev FROM {'a' if biased else 'o'}{k})")
    return ", ".join(out)


def pooled_walks_sql(steps: int, num_walks: int, seed: int, weighted: bool = True) -> str:
    """CTEs ending in w<steps>: walks from every node through pools of one-step segments, one CTE a step."""
    prime = walks.PRIME
    weight = "sum(weight)" if weighted else "1.0::DOUBLE"
    key = lambda i: f"('0x' || substr(md5(source), {i}, 7))::BIGINT"
    out = [f"adj AS MATERIALIZED (SELECT source, target, {weight} AS weight FROM sym GROUP BY 1, 2)"]
    out.append("cum AS MATERIALIZED (SELECT source, target, sum(weight) OVER o AS high, sum(weight) OVER o - weight AS low FROM adj WINDOW o AS (PARTITION BY source ORDER BY target))")
    out.append(f"tot AS MATERIALIZED (SELECT source, sum(weight) AS whole, {key(1)} AS k1, {key(8)} AS k2 FROM adj GROUP BY 1)")
    out.append(f"pool AS MATERIALIZED (SELECT *, greatest(1, ceil((SELECT count(*) FROM tot)::DOUBLE * {num_walks} * whole / (SELECT sum(whole) FROM tot)))::BIGINT AS slots FROM tot)")
    out.append(f"slot AS (SELECT source, k1, k2, whole, step, unnest(range(CASE WHEN step = 0 THEN {num_walks} ELSE slots END)) AS slot FROM pool, range({steps}) s(step))")
    h = f"((k1 + {seed * 7919 + 1}) % {prime})"
    for more in ("k2", "step * 1000003 + slot", "slot + 12345", "step"):
        out.append(f"h{len(out)} AS (SELECT source, k1, k2, whole, step, slot, (h * h + {more}) % {prime} AS h FROM {out[-1].split(' ')[0] if more != 'k2' else f'(SELECT *, {h} AS h FROM slot)'})")
    last = out[-1].split(" ")[0]
    out.append(f"seg AS MATERIALIZED (SELECT step, h.source AS node, slot, target AS next, (h * h + 99991) % {prime} AS more FROM {last} h JOIN cum c ON h.source = c.source AND (h + 0.5) / {prime}.0::DOUBLE * whole >= low AND (h + 0.5) / {prime}.0::DOUBLE * whole < high)")
    out.append(f"w0 AS (SELECT source AS start, n AS walk_no, [source] AS walk, source AS node, n AS slot FROM tot, range({num_walks}) r(n))")
    for k in range(1, steps + 1):
        out.append(f"w{k} AS MATERIALIZED (SELECT start, walk_no, list_append(walk, next) AS walk, next AS node, more % slots AS slot FROM w{k - 1} w JOIN seg s ON s.step = {k - 1} AND s.node = w.node AND s.slot = w.slot JOIN pool p ON p.source = next)")
    return ", ".join(out)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where walks start; they meet organisations on the way."""
    return view.nodes(spark, sf_dir).where("entity_type <> 'Organization'")


@query(f"{DENSE}, {pooled_walks_sql(29, 10, 3)} SELECT start, walk_no, array_to_string(walk, ',') AS walk FROM w29")
def e1_random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walks.random_walks(view.edges(spark, sf_dir), seed=3)
    return out.select("start", "walk_no", F.array_join("walk", ",").alias("walk"))


@query(f"{DENSE}, {walks_sql(9, 2, 6, people=True)} SELECT start, walk_no, array_to_string(walk, ',') AS walk FROM w9")
def e1_walks_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walks.random_walks(view.edges(spark, sf_dir), num_walks=2, walk_length=10, starts=_people(spark, sf_dir), seed=6)
    return out.select("start", "walk_no", F.array_join("walk", ",").alias("walk"))


@query(f"{DENSE}, {walks_sql(3, 1, 4, p=0.5, q=2.0)} SELECT start, walk_no, array_to_string(walk, ',') AS walk FROM w3")
def e1_biased_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walks.random_walks(view.edges(spark, sf_dir), num_walks=1, walk_length=4, p=0.5, q=2.0, seed=4)
    return out.select("start", "walk_no", F.array_join("walk", ",").alias("walk"))


def _coverage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = cut_lineage(view.edges(spark, sf_dir))
    walked = walks.random_walks(edges, seed=5, weighted=False)
    return walks.walk_coverage(walked, edges)


COVERAGE = f"""{DENSE}, {pooled_walks_sql(29, 10, 5, weighted=False)}, visits AS (SELECT start, count(DISTINCT node) AS visited FROM (SELECT start, unnest(walk) AS node FROM w29) GROUP BY 1)"""


@query(f"{COVERAGE} SELECT start, visited, round(visited / (SELECT count(DISTINCT source) FROM sym), 9) AS coverage FROM visits")
def c10_walk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)[0].withColumn("coverage", F.round("coverage", 9))


@query(f"{COVERAGE} SELECT count(*) AS starts, round(avg(visited / (SELECT count(DISTINCT source) FROM sym)), 9) AS mean_coverage FROM visits")
def c10_mean_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)[1].withColumn("mean_coverage", F.round("mean_coverage", 9))


@query(f"""{COVERAGE}, c AS (SELECT visited / (SELECT count(DISTINCT source) FROM sym) AS coverage FROM visits), r AS (SELECT min(coverage) AS low, (max(coverage) - min(coverage)) / 30 AS width FROM c)
SELECT CASE WHEN width > 0 THEN least(floor((coverage - low) / width), 29)::INT ELSE 0 END AS bin, count(*) AS n FROM c, r GROUP BY 1""")
def c10_coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)[2]


@query()
def e2_train_node2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut_lineage(view.edges(spark, sf_dir))
    vectors = cut_lineage(skipgram.train_node2vec(cut_lineage(walks.random_walks(edges, seed=1))))
    # of each node's ten nearest by cosine, those that it has an edge with
    near = neighbours.NeighbourIndex(vectors).search(vectors, 10)
    linked = prep.undirected_edges(edges.select("source", "target")).distinct().select(F.col("source").alias("id"), F.col("target").alias("other"), F.lit(1).alias("edge"))
    overlap = near.join(linked, ["id", "other"], "left").groupBy("id").agg(F.count("*").alias("n_near"), F.count("edge").alias("n_linked"))
    return vectors.select("id", F.size("embedding").alias("dimensions")).join(overlap, "id", "left")


@query(f"WITH {VECTORS} SELECT id, generate_subscripts(e, 1)::INT - 1 AS pos, round(unnest(e), 6) AS value FROM u")
def e3_normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = similarity.normalize_vectors(_vectors(spark, sf_dir))
    return unit.select("id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {VECTORS} SELECT id, generate_subscripts(e, 1)::INT - 1 AS pos, round(unnest(e), 6) AS value FROM u WHERE label = 0")
def e4_client_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    unit = similarity.client_vectors(vectors, vectors.where("label = 0").select("id"))
    return unit.select("id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


NEAR = f"WITH {VECTORS}, s AS (SELECT a.id, b.id AS other, b.label, round(list_dot_product(a.e, b.e), 9) AS score FROM u a, u b)"


@query(f"{NEAR} SELECT id, other AS best_client, round(score, 6) AS similarity FROM s WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) = 1")
def e5_top1_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(_vectors(spark, sf_dir))
    return similarity.top1_client(vectors, vectors.where("label = 0")).withColumn("similarity", F.round("similarity", 6))


@query(f"""{NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS k FROM s WHERE id <> other QUALIFY k <= 3)
SELECT id AS node_id, """ + ", ".join(f"max(CASE WHEN k = {k} THEN other END) AS top{k}_id, round(max(CASE WHEN k = {k} THEN score END), 6) AS top{k}_score" for k in (1, 2, 3)) + " FROM r GROUP BY 1")  # fmt: skip
def e6_nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similarity.nearest_neighbors(cut_lineage(_vectors(spark, sf_dir)), 3)
    return near.withColumns({f"top{k}_score": F.round(f"top{k}_score", 6) for k in (1, 2, 3)})


@query()
def e6_indexed_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.indexed_neighbors(cut_lineage(_vectors(spark, sf_dir)), 3)
    return near.withColumns({f"top{k}_score": F.round(f"top{k}_score", 6) for k in (1, 2, 3)})


@query()
def e6_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(_vectors(spark, sf_dir))
    return neighbours.index_recall(vectors, vectors, 3)


@query()
def e5_indexed_top1_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(_vectors(spark, sf_dir))
    return neighbours.indexed_top1_client(vectors, vectors.where("label = 0")).withColumn("similarity", F.round("similarity", 6))


@query(f"""{DENSE}, {VECTORS}, nv AS (SELECT p.id, e, entity_type FROM people p JOIN u ON u.id = p.c_custkey::VARCHAR),
top AS (SELECT a.id, b.id AS best, round(list_dot_product(a.e, b.e), 9) AS score FROM nv a, nv b WHERE b.entity_type = 'Client' AND a.entity_type = 'Prospect' QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.id) = 1),
pairs AS (SELECT id AS src, best AS dst FROM top), {bfs_sql()}, {PAYLOAD_SQL}
SELECT p.id, coalesce(best, '') AS best_client_id, coalesce(round(score, 6), 0) AS similarity, coalesce(payload, '[]') AS path_to_best_client
FROM people p LEFT JOIN top USING (id) LEFT JOIN payloads ON src = p.id WHERE entity_type = 'Prospect'""")
def e7_annotate_best_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = view.nodes(spark, sf_dir), cut_lineage(view.edges(spark, sf_dir))
    people = view._customers(spark, sf_dir, "dense").select(F.col("c_custkey").cast("string").alias("k"), F.col("id").alias("node"))
    vectors = cut_lineage(_vectors(spark, sf_dir).join(people, F.col("id") == F.col("k")).select(F.col("node").alias("id"), "embedding"))
    rows = nodes.where("entity_type = 'Prospect'").select("id")
    return similarity.annotate_best_clients(rows, vectors, nodes, edges).withColumn("similarity", F.round("similarity", 6))


LAYERS = gin.seeded_layers(2, 3, 2, seed=5)


def gin_sql(layers: gin.Layers, weighted: bool) -> str:
    """CTEs of the forward pass, with the small matrices written out, ending in z(id, x0..)."""
    width = layers[0][0].shape[0]
    weight = "max(weight)" if weighted else "1.0"
    out = [f"adj AS (SELECT source, target, {weight} AS weight FROM sym GROUP BY 1, 2)", "h0 AS (SELECT DISTINCT source AS id, " + ", ".join(f"1.0::DOUBLE AS x{i}" for i in range(width)) + " FROM adj)"]
    times = lambda w, j: "(" + " + ".join(f"x{i} * ({float(w[i, j])!r}::DOUBLE)" for i in range(w.shape[0])) + ")"
    for k, (w1, w2) in enumerate(layers, 1):
        own = "" if weighted else f" UNION ALL SELECT id, {', '.join(f'x{i}' for i in range(width))} FROM h{k - 1}"
        out.append(f"s{k} AS (SELECT id, {', '.join(f'sum(x{i}) AS x{i}' for i in range(width))} FROM (SELECT target AS id, {', '.join(f'x{i} * weight AS x{i}' for i in range(width))} FROM adj JOIN h{k - 1} ON source = id{own}) GROUP BY 1)")
        out.append(f"r{k} AS (SELECT id, {', '.join(f'greatest({times(w1, j)}, 0) AS x{j}' for j in range(w1.shape[1]))} FROM s{k})")
        width = w2.shape[1]
        out.append(f"h{k} AS (SELECT id, {', '.join(f'{times(w2, j)} AS x{j}' for j in range(width))} FROM r{k})")
    size = " + ".join(f"x{i} * x{i}" for i in range(width))
    out.append(f"z AS (SELECT id, {', '.join(f'CASE WHEN size > 0 THEN x{i} / size ELSE x{i} END AS x{i}' for i in range(width))} FROM (SELECT *, sqrt({size}) AS size FROM h{len(layers)}))")
    return ", ".join(out)


SHOWN = ", ".join(f"round(x{i}, 6) + 0.0 AS x{i}" for i in range(3))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", *[(F.round(F.col("embedding")[i], 6) + F.lit(0.0)).alias(f"x{i}") for i in range(3)])


@query(f"{LAYERED}, {gin_sql(LAYERS, False)} SELECT id, {SHOWN} FROM z")
def e8_gin_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(gin.gin_embed(view.edges(spark, sf_dir, "layered"), LAYERS))


@query(f"{LAYERED}, {gin_sql(LAYERS, True)} SELECT id, {SHOWN} FROM z")
def e9_gin_embed_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(gin.gin_embed_weighted(view.edges(spark, sf_dir, "layered"), LAYERS))


SCORE = "a.x0 * b.x0 + a.x1 * b.x1 + a.x2 * b.x2"


@query(f"{LAYERED}, {gin_sql(LAYERS, False)} SELECT source, target, round({SCORE}, 6) AS score FROM edges JOIN z a ON source = a.id JOIN z b ON target = b.id")
def e10_edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut_lineage(view.edges(spark, sf_dir, "layered"))
    return similarity.edge_scores(cut_lineage(gin.gin_embed(edges, LAYERS)), edges).withColumn("score", F.round("score", 6))


def _feistel_sql(seed: int) -> str:
    """CTEs f0..f4 (d, half, l, r): the rounds of the keyed permutation of draws."""
    prime = gin.PRIME
    out = ["f0 AS (SELECT d, half, d >> half AS l, d & ((1::BIGINT << half) - 1) AS r FROM size, range((SELECT least(1::BIGINT << (2 * half), (3 * want * (1::BIGINT << (2 * half)) / pairs)::BIGINT + 256) FROM size)) x(d))"]
    for k in range(1, 5):
        x = f"((r + {seed * 4 + k * 1_000_003}) % {prime})"
        m = f"(({x} * {x} + {99_991 * k}) % {prime})"
        out.append(f"f{k} AS (SELECT d, half, r AS l, xor(l, (({m} * {m} + r) % {prime}) & ((1::BIGINT << half) - 1)) AS r FROM f{k - 1})")
    return ", ".join(out)


NEGATIVE = f"""ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM (SELECT DISTINCT source AS id FROM sym)),
size AS MATERIALIZED (SELECT n, n * (n - 1) // 2 AS pairs, ceil(ceil(log2(n * (n - 1) // 2)) / 2)::INT AS half, (SELECT count(*) FROM edges) AS want FROM (SELECT count(*) AS n FROM ids)), {_feistel_sql(9)},
drawn AS (SELECT d AS draw, y, floor((1 + sqrt(1 + 8.0::DOUBLE * y)) / 2)::BIGINT AS b FROM (SELECT d, (l << half) + r AS y FROM f4), size WHERE y < pairs),
negative AS (SELECT a.id AS source, b.id AS target, draw FROM drawn JOIN ids a ON y - drawn.b * (drawn.b - 1) // 2 = a.index JOIN ids b ON drawn.b = b.index
             WHERE NOT EXISTS (SELECT 1 FROM sym WHERE sym.source = a.id AND sym.target = b.id) ORDER BY draw LIMIT (SELECT count(*) FROM edges))"""


@query(f"{LAYERED}, {NEGATIVE} SELECT source, target FROM negative")
def e11_negative_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gin.negative_edges(cut_lineage(view.edges(spark, sf_dir, "layered")), seed=9)


@query(f"""{LAYERED}, {gin_sql(LAYERS, False)}, {NEGATIVE},
losses AS (SELECT 1 AS y, ln(1 + exp(-({SCORE}))) AS loss FROM edges JOIN z a ON source = a.id JOIN z b ON target = b.id
           UNION ALL SELECT 0, ln(1 + exp({SCORE})) FROM negative JOIN z a ON source = a.id JOIN z b ON target = b.id)
SELECT round(avg(loss), 6) AS bce, round(avg(loss) FILTER (y = 1) + avg(loss) FILTER (y = 0), 6) AS contrastive FROM losses""")
def e12_link_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut_lineage(view.edges(spark, sf_dir, "layered"))
    z = cut_lineage(gin.gin_embed(edges, LAYERS))
    out = gin.link_losses(similarity.edge_scores(z, edges), similarity.edge_scores(z, gin.negative_edges(edges, seed=9)))
    return out.select(F.round("bce", 6).alias("bce"), F.round("contrastive", 6).alias("contrastive"))


@query()
def e13_train_gin(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, losses, _ = gin.train_gin(view.edges(spark, sf_dir, "layered"), gin.seeded_layers(2, 3, 2, seed=5), epochs=2)
    return z.select("id", F.round(similarity.norm("embedding"), 4).alias("size"), F.lit(round(float(np.min(losses)), 4)).alias("best_loss"))


def pca_sql(components: int = 2, squarings: int = 14) -> str:
    """CTEs ending in p1, p2, .. (i, x): principal components of v by squaring the covariance until one direction is left.

    A power of the matrix tends to the outer product of its first component with itself; the column of
    the largest diagonal entry is that component with its largest loading positive.
    """
    out = ["long AS (SELECT id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v)", "centred AS MATERIALIZED (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM long)"]
    out.append("c1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS m FROM centred a JOIN centred b USING (id) GROUP BY 1, 2)")
    scaled = lambda source: f"(SELECT i, j, m / (SELECT sum(m) FROM {source} WHERE i = j) AS m FROM {source})"
    for k in range(1, components + 1):
        out.append(f"s{k}_0 AS MATERIALIZED {scaled(f'c{k}')}")
        for n in range(1, squarings + 1):
            out.append(f"q{k}_{n} AS MATERIALIZED (SELECT a.i, b.j, sum(a.m * b.m) AS m FROM s{k}_{n - 1} a JOIN s{k}_{n - 1} b ON a.j = b.i GROUP BY 1, 2)")
            out.append(f"s{k}_{n} AS MATERIALIZED {scaled(f'q{k}_{n}')}")
        last = f"s{k}_{squarings}"
        out.append(f"p{k} AS MATERIALIZED (SELECT i, m / sqrt(sum(m * m) OVER ()) AS x FROM {last} WHERE j = (SELECT arg_max(i, m) FROM {last} WHERE i = j))")
        out.append(f"l{k} AS (SELECT sum(a.x * m * b.x) AS size FROM c{k} JOIN p{k} a USING (i) JOIN p{k} b ON b.i = j)")
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.i, j, m - size * a.x * b.x AS m FROM l{k}, c{k} JOIN p{k} a USING (i) JOIN p{k} b ON b.i = j)")
    return ", ".join(out)


@query(f"WITH {VECTORS}, {pca_sql()} SELECT id, round(sum(c.x * p1.x), 4) AS x, round(sum(c.x * p2.x), 4) AS y FROM centred c JOIN p1 USING (i) JOIN p2 USING (i) GROUP BY 1")
def e14_pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.pca_2d(_vectors(spark, sf_dir))
    return out.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {VECTORS} SELECT a.id AS a, b.id AS b, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS distance
FROM v a JOIN v b ON b.id::BIGINT = a.id::BIGINT + 1""")
def e15_embedding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(_vectors(spark, sf_dir))
    following = vectors.select(F.col("id").alias("a"), (F.col("id").cast("long") + 1).cast("string").alias("b"))
    return similarity.embedding_distance(vectors, following).withColumn("distance", F.round("distance", 6))
