"""Exact deduplication by deterministic block naming (DataFrame operations only).

A text without its white space is cut into blocks of a fixed number of bytes.  The distinct
blocks are sorted and named by integers; then adjacent names are paired, the distinct pairs are
sorted and named in turn, and so on until one name is left of each document.  (round, name) is an
identity: two documents share it exactly if their texts are equal.

Blocks are grouped by (hash, content) once, after a map-side combine, which tells how many contents
a hash stands for.  A hash that stands for one content only takes that content's place: hashes are
sorted and named, so the name table carries no contents.  Where a hash stands for several contents,
those blocks are sorted, named and joined by content, so a collision costs time and never merges
two texts.  Repeated rows of one (doc_id, length, SHA-256) are put together before naming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.llm._spark import checkpointed, lookup, quoted, unused_names

BLOCK_BYTES = 4096
#: Names are sorted within this many hash ranges, so no sort holds all blocks.
RANGES = 4096
KEY = ["doc_id", "n_chars", "text_sha256"]
#: Keys of dropped rows (about 100 bytes each) are broadcast up to so many.
BROADCAST_DROPPED = 200_000


def squeezed(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Give each row an integer name by its place in sort order; the same names on every run."""
    spread = F.pmod(F.xxhash64(*order), F.lit(RANGES))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)).cast("long")
    return distinct.withColumn("range_", spread).withColumn("name", place * RANGES + F.col("range_")).drop("range_")


def _blocks(docs: DataFrame, block_bytes: int, hash_bits: int) -> DataFrame:
    """(doc_id, n_chars, text_sha256, blocks: array of (h, block)) of each row."""
    flat = docs.select(
        F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), squeezed(F.col("text")).cast("binary").alias("flat")
    )
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("flat") / F.lit(block_bytes))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("flat"), i * block_bytes + 1, F.lit(block_bytes)))
    digest = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(b)
    return flat.select("doc_id", "n_chars", F.sha2("flat", 256).alias("text_sha256"), F.transform(cut, lambda b: F.struct(digest(b).alias("h"), b.alias("block"))).alias("blocks"))


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which equal text stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, n_chars.  Of equal texts (white space
    aside) the row with the most code points stays, then the smallest doc_id (null last).  Null
    text counts as empty, and empty texts are one group.  Of rows that repeat both doc_id and
    text, one is kept.  An empty table gives an empty result.  Other columns are not read.
    ``hash_bits`` below 64 serves tests of the collision path.
    """
    cut = _blocks(docs, block_bytes, hash_bits)
    # round 0: sort the distinct blocks; a hash with one content is a name's key by itself
    contents = cut.select(F.explode("blocks").alias("b")).groupBy("b.h", "b.block").agg(F.count("*").alias("n"))
    hashes = checkpointed(_named(contents.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("variants")), "h"))
    # one row per distinct (doc_id, length, text), with how often it occurs
    hashed = cut.select(*KEY, F.col("blocks.h").alias("hs"))
    rows = checkpointed(_named(hashed.groupBy(*KEY, "hs").agg(F.count("*").alias("times")), *KEY).withColumnRenamed("name", "rid"))
    most = rows.agg(F.max(F.size("hs"))).first()[0] or 1

    places = rows.select("rid", F.size("hs").alias("left"), F.posexplode("hs").alias("pos", "h"))
    named = lookup(places, hashes, ["h"], "n", "inner")
    level = named.where("variants = 1").select("rid", "left", "pos", "name")
    shared = hashes.where("variants > 1").select("h", "n")
    if not shared.isEmpty():
        level = level.unionByName(_by_content(cut, rows, shared))
    level = checkpointed(level) if most > 1 else level
    done = level.where(F.col("left") == 1).select("rid", F.lit(0).alias("round"), "name")
    rounds = 0
    while most > 1:
        rounds, most = rounds + 1, (most + 1) // 2
        pairs = (
            level.where(F.col("left") > 1)
            .groupBy("rid", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.expr("ceil(left / 2)")).cast("int").alias("left"), F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"))
        )
        pairs = checkpointed(pairs)
        names = checkpointed(_named(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b"))
        level = checkpointed(lookup(pairs, names, ["a", "b"], "n", "inner").select("rid", "left", "pos", "name"))
        done = done.unionByName(level.where(F.col("left") == 1).select("rid", F.lit(rounds).alias("round"), "name"))

    members = checkpointed(rows.drop("hs").join(done, "rid"))
    best = F.min(F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"))).alias("best")
    groups = checkpointed(members.groupBy("round", "name").agg(F.sum("times").alias("group_size"), F.count("*").alias("n"), best))
    # how often the staying row occurs is 1 but for repeated rows, of which the first copy stays
    wins = (F.col("n_chars") == -F.col("best.chars")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    joined = lookup(members, groups, ["round", "name"], "n", "inner")
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", wins.alias("wins"), "text_sha256", "n_chars", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).select(
        "doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chars"
    )


def _by_content(cut: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Names of the blocks whose hash stands for several contents, joined by the contents."""
    blocks = cut.select(*KEY, F.size("blocks").alias("left"), F.posexplode("blocks").alias("pos", "b")).select(*KEY, "left", "pos", "b.h", "b.block")
    blocks = checkpointed(lookup(blocks.dropDuplicates([*KEY, "pos", "h"]), shared, ["h"], "n", "inner").drop("n"))
    # negative names: they never meet those of the other blocks
    names = checkpointed(_named(blocks.groupBy("h", "block").agg(F.count("*").alias("n")), "h", "block").withColumn("name", -F.col("name") - RANGES))
    named = lookup(blocks, names, ["h", "block"], "n", "inner")
    ids = rows.select("rid", *[F.col(c).alias(f"k_{c}") for c in KEY])
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in KEY]
    return named.join(ids, same, "inner").select("rid", "left", "pos", "name")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all columns as they are.

    Extra columns pass through, whatever their names and values; doc_id and text must be there.
    Null texts count as empty, and empty texts are one group; a null doc_id is an id of its own.
    Rows that repeat both doc_id and text differ at most in other columns; any one of them stays.
    Texts of any length are compared whole.  An empty table gives an empty result.  A row is found
    again by (doc_id, length, SHA-256 of the text without white space), not by its name.

    Only the keys of dropped rows travel to the documents while they are few; beyond
    BROADCAST_DROPPED of them the documents are shuffled.
    """
    groups = exact_groups(docs.select("doc_id", "text"))
    key = unused_names(docs, "id_", "chars_", "sha_", "lost_", "also_kept_")
    lost = checkpointed(groups.groupBy(*KEY).agg(F.count_if(~F.col("kept")).alias("lost"), F.count_if("kept").alias("kept")).where("lost > 0"))
    lost = lost.select(*[F.col(c).alias(k) for c, k in zip(KEY, key, strict=False)], F.lit(True).alias(key[3]), (F.col("kept") > 0).alias(key[4]))
    if lost.limit(BROADCAST_DROPPED + 1).count() <= BROADCAST_DROPPED:
        lost = F.broadcast(lost)
    own = [F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long"), F.sha2(squeezed(F.col("text")).cast("binary"), 256)]
    # the documents' key lies in names of its own beside the join, so that no user's column is touched
    mine = unused_names(docs, "own_id_", "own_chars_", "own_sha_")
    tagged = docs.withColumns(dict(zip(mine, own, strict=True)))
    joined = tagged.join(lost, [F.col(m).eqNullSafe(F.col(k)) for m, k in zip(mine, key, strict=False)], "left")
    stay = joined.where(F.col(key[3]).isNull())
    # only rows that repeat (doc_id, text) need another look; the first of them stays
    if not lost.where(key[4]).isEmpty():
        stay = stay.unionByName(joined.where(key[4]).dropDuplicates(mine))
    return stay.select(*map(quoted, docs.columns))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
     n AS (SELECT doc_id, txt, regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g') AS flat FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY flat) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(flat) AS text_sha256
FROM n WINDOW w AS (PARTITION BY flat ORDER BY length(txt) DESC, doc_id)
"""
