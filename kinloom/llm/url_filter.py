"""URL filters: host-suffix and path-prefix expressions against hashed rules (DataFrame operations only).

Each URL is expanded into expressions "host suffix + path prefix".  An expression's SHA-256 is
looked up by its first 32 bits in an equi-join; the full digest, the rest of the rule's path and
the precedence of rules then decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to so many; beyond, the join is a shuffled one.
BROADCAST_RULES = 200_000
#: The rules of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; '' without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _directory(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all subdomains of it if the url's path starts
    with the rule's.  Of several that fit the one with the longest host + path wins, then the
    longer host, then block.  ``rule`` is that string, null where none fits; the verdict is then
    ``default``.  A null url, or one without ``://``, has an empty host and path and fits no rule
    but one with both empty.  Repeated rows are judged alike; an empty table gives an empty
    result; without rules every verdict is the default.  Other columns are not read.
    """
    known = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where("verdict is not null and host is not null and path is not null").distinct()
    size = known.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.size(F.split("path", "/"))).alias("steps")).first()
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # rows that repeat a page's url travel once
    urls = parts.groupBy("page_id", "host", "path").agg(F.count("*").alias("times"))
    # no rule has more labels or steps than these, so longer expressions cannot match
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(size["labels"] or 1))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    steps = F.split("path", "/")
    depth = F.least(F.size(steps) - 1, F.lit((size["steps"] or 1) - 1))
    paths = F.transform(F.sequence(F.lit(0), depth), lambda n: F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.when(n > 0, "/").otherwise("")))
    expressions = urls.withColumn("host_", F.explode(hosts)).withColumn("dir_", F.explode(paths))
    # a path that does not start with a slash has no directory ''/'', so '' and '/' stay apart
    digest = F.sha2(F.concat_ws("\n", "host_", "dir_").cast("binary"), 256)
    expressions = expressions.withColumn("digest", digest).withColumn("prefix", _prefix(F.col("digest"))).drop("host_", "dir_")
    hashed = known.select(
        "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), F.col("path").alias("rule_path"),
        F.sha2(F.concat_ws("\n", "host", _directory(F.col("path"))).cast("binary"), 256).alias("rule_digest"),
    ).withColumn("prefix", _prefix(F.col("rule_digest")))
    hashed = F.broadcast(hashed) if size["n"] <= BROADCAST_RULES else hashed
    fits = (F.col("digest") == F.col("rule_digest")) & F.expr("startswith(path, rule_path)")
    rank = F.struct(F.length("rule").alias("chars"), F.col("host_chars"), (F.col("verdict") == "block").alias("blocks"), F.col("rule"), F.col("verdict"))
    judged = expressions.join(hashed, "prefix", "left").groupBy("page_id", "host", "path").agg(F.max("times").alias("times"), F.max(F.when(fits, rank)).alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")


ORACLE = r"""
WITH h AS (SELECT page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
     m AS (SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
           FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m USING (page_id, host, path)
"""
