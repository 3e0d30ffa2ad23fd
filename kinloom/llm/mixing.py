"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

A source that should make up a share ``w`` of ``budget`` documents and has ``n`` documents gets
the repetition rate ``budget * w / n``.  Each document's number of copies is a Poisson variable
with that mean, found by inverting the distribution at a uniform number hashed from seed and
doc_id.  Documents are exploded by their count and dealt out and sorted by a hash, which is a
global shuffle that any run repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinloom.llm._spark import checkpointed, quoted, unused_names

SEED = 17
#: Above this rate a Poisson variable is summed from parts of at most this mean, to keep exp() away from 0.
PART = 16.0
#: Rates are broadcast up to so many sources; beyond, the join is a shuffled one.
BROADCAST_SOURCES = 20_000
NONE = ""


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """Smallest k with P(X <= k) > u for a Poisson X; the mean is at most PART.

    The walk over k is bounded by the last k whose probability a double can tell from 0.
    """
    steps = F.sequence(F.lit(1), (mean * 2 + 40).cast("int"))
    first = F.exp(-mean)
    start = F.struct(F.lit(0).alias("k"), first.alias("p"), first.alias("cdf"))
    walk = F.aggregate(
        steps, start,
        lambda s, i: F.when(s["cdf"] > u, s).otherwise(F.struct(i.alias("k"), (s["p"] * mean / i).alias("p"), (s["cdf"] + s["p"] * mean / i).alias("cdf"))),
        lambda s: s["k"],
    )
    return F.when(mean > 0, walk).otherwise(F.lit(0))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, n_docs): one row per source, null as ''; a checkpoint, as it is read several times."""
    return checkpointed(docs.groupBy(F.coalesce("source", F.lit(NONE)).alias("source")).agg(F.count("*").alias("n_docs")))


def temperature_weights(sizes: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(source, weight) from ``source_sizes``: shares in proportion to n^alpha, which lifts small sources."""
    powers = sizes.select("source", F.pow("n_docs", F.lit(alpha)).alias("p"))
    total = powers.agg(F.sum("p")).first()[0]
    return powers.select("source", (F.col("p") / F.lit(total)).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, budget: float | None = None) -> DataFrame:
    """(source, n_docs, rate) from ``source_sizes``; ``budget`` is the number of documents wanted, as many as there are by default.

    Weights are scaled to sum to 1 over the sources that have documents; a source without a
    weight gets rate 0, and so does one whose weight is negative.
    """
    given = weights.select(F.coalesce("source", F.lit(NONE)).alias("source"), "weight")
    both = sizes.join(given, "source", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    whole = both.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    want = float(whole["n"] or 0) if budget is None else float(budget)
    rate = F.lit(want) * (F.col("weight") / F.lit(whole["w"])) / F.col("n_docs") if whole["w"] else F.lit(0.0)
    return both.select("source", "n_docs", rate.alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: int = SEED, into: str = "mixed") -> DataFrame:
    """Replicate the documents to the target weights (``temperature_weights`` by default) and shuffle them globally.

    Returns the columns of ``docs`` as they are, whatever their names, and one more, a struct
    named ``into`` (which must be no column of ``docs``): copy (1..), copies, rate, place (the
    sort key of the shuffle).  A null source is a source of its own, named ''.  Rows that repeat a
    doc_id get the same count each; a null doc_id hashes as ''.  Null, empty and very long texts
    count like any other.  An empty table gives an empty result.  A rate above 16 is drawn as a
    sum of equal parts of at most 16, so the counts stay Poisson at any rate.
    """
    if unused_names(docs, into) != [into]:
        raise ValueError(f"{into} is a column already")
    key, rate, counted, copy = unused_names(docs, "source_", "rate_", "copies_", "copy_")
    sizes = source_sizes(docs)
    weights = temperature_weights(sizes) if weights is None else weights
    rates = repetition_rates(sizes, weights, budget).select(F.col("source").alias(key), F.col("rate").alias(rate))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    own = [F.col(quoted(c)) for c in docs.columns]
    rated = docs.select(*own, F.coalesce("source", F.lit(NONE)).alias(key)).join(rates, key).select(*own, rate)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    parts = F.greatest(F.lit(1), F.ceil(F.col(rate) / PART)).cast("int")
    draw = lambda j: poisson_inverse(uniform(F.lit(str(seed)), name, j.cast("string")), F.col(rate) / parts)
    count = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda total, j: total + draw(j))
    copies = rated.select(*own, rate, count.alias(counted)).where(F.col(counted) > 0).select(*own, rate, counted, F.explode(F.sequence(F.lit(1), F.col(counted))).alias(copy))
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("place"), name, F.col(copy).cast("string")))
    placed = copies.select(*own, F.struct(F.col(copy).alias("copy"), F.col(counted).alias("copies"), F.col(rate).alias("rate"), place.alias("place")).alias(into))
    return placed.repartition(f"{into}.place").sortWithinPartitions(f"{into}.place")


ORACLE = """
WITH n AS (SELECT coalesce(source, '') AS source, count(*) AS n_docs FROM documents GROUP BY 1),
     w AS (SELECT source, n_docs, pow(n_docs, 0.5) AS p FROM n),
     v AS (SELECT source, n_docs, p / (SELECT sum(p) FROM w) AS weight FROM w),
     r AS (SELECT source, n_docs, (SELECT sum(n_docs) FROM v)::DOUBLE * (weight / (SELECT sum(weight) FROM v)) / n_docs AS rate FROM v),
     d AS (SELECT doc_id, text, d.source, rate, greatest(1, ceil(rate / 16.0))::INT AS parts
           FROM documents d JOIN r ON r.source = coalesce(d.source, '')),
     q AS (SELECT doc_id, text, source, rate, rate / parts AS mean, unnest(range(1, parts + 1)) AS j FROM d),
     u AS (SELECT *, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || j), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u FROM q),
     k AS (SELECT doc_id, text, source, rate,
                  list_sum(list_transform(range(0, (mean * 2 + 40)::INT),
                    lambda m: CASE WHEN exp(-mean) * list_sum(list_transform(range(0, m + 1), lambda i: pow(mean, i) / gamma(i + 1))) <= u THEN 1 ELSE 0 END)) AS one
           FROM u),
     c AS (SELECT doc_id, any_value(text) AS text, any_value(source) AS source, any_value(rate) AS rate, sum(one)::INT AS copies FROM k GROUP BY doc_id),
     x AS (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM c)
SELECT doc_id, source, round(rate, 6) AS rate, copies, copy,
       md5('17|place|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS place, md5(coalesce(text, '')) AS text_md5
FROM x
"""
