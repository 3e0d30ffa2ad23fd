"""How the sources of a language differ in their terms, by a sort of token-start pointers.

Texts are sorted in shards of some MB without being copied: a pointer to the start of each term in the
Arrow buffer, sorted by a multikey quicksort whose characters are eight bytes wide.  Pointers are
sorted by their first eight bytes; runs of equal ones whose terms go on are sorted by the next
eight, and so on.  Each run that is left is one term; its pointers, which keep the order of groups
and texts, give the term's count and its number of documents in each (language, source) of the shard.
Spark adds up the shards' runs.

Every arithmetic step is exact: shares are whole billionths, and numbers that could outgrow 64 bits
are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinloom.llm._pointers import LETTERS, lowered, pieces, pointers
from kinloom.llm._spark import checkpointed, lookup, written
from kinloom.llm._text import slices

MIN_DOCS = 3
TOP = 200
BILLION = 1_000_000_000
#: Bytes of text that are sorted at a time.
SHARD_BYTES = 12 << 20
WIDTH = 8
#: Terms that are equal in so many bytes are sorted as strings.
DEEP = 64
#: Pairs of sources that are worked out at a time, and sources of a term that one row holds on its left.
PAIRS_AT_A_TIME = 1 << 19
TILE = 256
#: Groups of a language that meet in one task.
GROUPS_A_TASK = 64


def _characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each word from ``depth`` on as one number, in the order of bytes; 0 where the word has ended.

    ``data`` has WIDTH bytes to spare behind the last word.  Words hold no zero byte.
    """
    any_place = np.ndarray((len(data) - WIDTH + 1,), "<u8", data.tobytes(), 0, (1,))
    left = np.clip(ends - starts - depth, 0, WIDTH)
    read = any_place[np.minimum(starts + depth, len(any_place) - 1)].byteswap()
    unused = (8 * (WIDTH - left)).astype(np.uint64)
    return np.where(left > 0, read >> unused << unused, 0)


def sorted_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the pointers sorted by their words' bytes, equal ones as they came, and where a new word begins in that order."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    keys = _characters(padded, starts, ends, 0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    longer, depth = (ends - starts)[order], WIDTH
    while True:
        # runs of more than one pointer in which some word goes on
        run = np.cumsum(first) - 1
        open_run = np.zeros(run[-1] + 1, bool)
        open_run[run[longer > depth]] = True
        open_run &= np.bincount(run) > 1
        at = np.flatnonzero(open_run[run])
        if not len(at):
            return order, first
        if depth >= DEEP:
            text = data.tobytes()
            words = [text[a:b] for a, b in zip(starts[order[at]].tolist(), ends[order[at]].tolist(), strict=True)]
            place = np.array(sorted(range(len(at)), key=lambda i: (run[at[i]], words[i])))
            changed = np.array([i == 0 or words[place[i]] != words[place[i - 1]] for i in range(len(at))])
        else:
            keys = _characters(padded, starts[order[at]], ends[order[at]], depth)
            place = np.lexsort((keys, run[at]))
            changed = np.concatenate([[True], keys[place][1:] != keys[place][:-1]])
        order[at], longer[at] = order[at][place], longer[at][place]
        first[at] |= changed
        if depth >= DEEP:
            return order, first
        depth += WIDTH


def _group_terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group, documents, count) of each run of equal words of one group; pointers come in the order of groups and documents."""
    order, first = sorted_runs(data, starts, ends)
    if not len(order):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, d = group[order], doc[order]
    begins = first | np.concatenate([[True], g[1:] != g[:-1]])
    new_doc = begins | np.concatenate([[True], d[1:] != d[:-1]])
    at = np.flatnonzero(begins)
    text, one = data.tobytes(), order[np.flatnonzero(first)]
    terms = pa.array([text[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], pa.binary()).cast(pa.string())
    return terms.take(pa.array((np.cumsum(first) - 1)[at])), g[at], np.add.reduceat(new_doc, at, dtype=np.int64), np.diff(np.append(at, len(order)))


def shard_counts(docs: DataFrame, shard: int = SHARD_BYTES, block: int | None = None) -> DataFrame:
    """(lang, source, term, docs, n) of each shard's groups; nulls are ''.  A text longer than a shard is sorted in blocks, whose runs are added up before its document is counted once."""

    def of_long_text(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        parts = []
        for piece in pieces(data, offsets, LETTERS, most=block or shard):
            terms, _, _, n = _group_terms(piece.data, piece.starts, piece.ends, np.zeros(len(piece.starts), np.int64), np.zeros(len(piece.starts), np.int64))
            parts.append(pa.table([terms, pa.array(n)], names=["term", "n"]))
        added = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
        return added["term"].combine_chunks(), added["n_sum"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, most=shard):
                data = lowered(data)
                coded = pa.StructArray.from_arrays([part.column(i).fill_null("") for i in (1, 2)], names=["lang", "source"]).to_pylist()
                names = sorted({(c["lang"], c["source"]) for c in coded})
                number = {name: i for i, name in enumerate(names)}
                of_doc = np.array([number[c["lang"], c["source"]] for c in coded], np.int64)
                if len(of_doc) == 1 and len(data) > (block or shard):
                    terms, n = of_long_text(data, offsets)
                    group, docs_ = np.zeros(len(terms), np.int64), np.ones(len(terms), np.int64)
                else:
                    starts, ends, doc = pointers(data, offsets, LETTERS)
                    by_group = np.argsort(of_doc[doc], kind="stable")
                    terms, group, docs_, n = _group_terms(data, starts[by_group], ends[by_group], of_doc[doc][by_group], doc[by_group])
                langs, sources = (pa.array([name[i] for name in names], pa.string()).take(pa.array(group)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(docs_), pa.array(n)], names=["lang", "source", "term", "docs", "n"])

    return docs.select("text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, "lang string, source string, term string, docs long, n long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), exact at any size."""
    wide = F.lit(BILLION).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)"))
    divided = lambda a, b: F.call_function("div", a, b)
    return 1 + F.when(count < 9 * BILLION, divided(F.lit(BILLION).cast("long") * (count + 1), total)).otherwise(divided(wide, total.cast("decimal(20,0)")))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(rows: DataFrame) -> DataFrame:
    """(lang, a, b, part, n): what terms of both sources a and b add, beyond what either alone adds, and how many terms they are.

    ``rows`` has (lang, own, by): the sources of a term with their share p and the share p0 of a term
    they do not have; ``own`` are the places in ``by`` that stand on the left.  Pairs are formed in
    numbers and added up in the task; no row per pair and term is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            by, own = batch.column(2), batch.column(1)
            flat = by.flatten()
            source = flat.field(0).dictionary_encode()
            code, p, p0 = source.indices.to_numpy(), flat.field(1).to_numpy(), flat.field(2).to_numpy()
            ends = np.cumsum(by.value_lengths().to_numpy())
            begins, row = ends - by.value_lengths().to_numpy(), np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy())
            left = begins[row] + own.flatten().to_numpy()
            many, lang = (ends - begins)[row], langs.indices.to_numpy()[row]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(many) // PAIRS_AT_A_TIME)) + 1, [len(left)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i == j:
                    continue
                m = many[i:j]
                a = np.repeat(left[i:j], m)
                b = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begins[row[i:j]], m)
                f = lambda x, y: (x - y) ** 2 // y
                value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
                key = (np.repeat(lang[i:j], m).astype(np.int64) * len(source.dictionary) + code[a]) * len(source.dictionary) + code[b]
                order = np.argsort(key, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
                key = key[order][at]
                here = key % len(source.dictionary), key // len(source.dictionary) % len(source.dictionary), key // len(source.dictionary) ** 2
                names = [langs.dictionary.take(pa.array(here[2])), source.dictionary.take(pa.array(here[1])), source.dictionary.take(pa.array(here[0]))]
                yield pa.RecordBatch.from_arrays([*names, pa.array(np.add.reduceat(value[order], at)), pa.array(np.diff(np.append(at, len(order))), pa.int64())], names=["lang", "a", "b", "part", "n"])

    made = rows.select("lang", "own", "by").mapInArrow(run, "lang string, a string, b string, part long, n long")
    return made.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("n").alias("n"))


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard: int = SHARD_BYTES, tile: int = TILE, groups_a_task: int = GROUPS_A_TASK) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs`` (text, lang, source).

    Terms are runs of letters and characters beyond ASCII, A-Z as a-z; a language keeps those in at
    least ``min_docs`` of its documents.  Part ``pair`` has each other source of the language, with
    its divergence summed over all kept terms; part ``term`` the kept terms that the group has
    relatively more often than its language, up to rank ``top``.  Ranks go by value, then item.

    Null text, lang and source are ''; so a group without terms is there as well, and a language
    without kept terms has pairs of value 0.  Rows that repeat a document are documents each.  A
    text longer than a shard is read whole in blocks.  Other columns (doc_id too) are not read; an
    empty table gives an empty result.

    The pairs of groups are the result itself; sums over their common terms are worked out from the
    sources that have a term (terms of more than ``tile`` sources in parts), and what terms of one
    source alone add is worked out from how many of its terms have which count.
    """
    counts = shard_counts(docs, shard).groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= min_docs)
    terms = written(kept.select("lang", "term", "total", "by"), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = terms.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("group_n"), F.count("*").alias("terms"))
    every = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    known = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    v, n = F.coalesce("v", F.lit(0)).cast("long"), F.coalesce("group_n", F.lit(0)).cast("long")
    # without kept terms no share is used
    groups = checkpointed(known.select("lang", "source", v.alias("v"), n.alias("group_n"), F.coalesce("lang_n", F.lit(0)).cast("long").alias("lang_n"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), share(F.lit(0).cast("long"), F.greatest(n + v, F.lit(1))).alias("p0")))

    rows = terms.select("lang", "term", "total", F.explode("by").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    shares = lookup(rows, groups.where("terms > 0"), ["lang", "source"], "terms", "inner")
    shares = written(shares.select("lang", "source", "term", share(F.col("n"), F.col("group_n") + F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n") + F.col("v")).alias("q"), "p0"), "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    of_terms = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    by_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("by"))
    places = lambda a, b: F.sequence(a.cast("int"), b.cast("int"))
    narrow = by_term.where(F.size("by") <= tile).select("lang", places(F.lit(0), F.size("by") - 1).alias("own"), "by")
    wide = by_term.where(F.size("by") > tile).select("lang", "by", F.explode(F.sequence(F.lit(0), F.ceil(F.size("by") / tile).cast("int") - 1)).alias("t"))
    wide = wide.repartition(F.xxhash64("by"), "t").select("lang", places(F.col("t") * tile, F.least((F.col("t") + 1) * tile, F.size("by")) - 1).alias("own"), "by")
    common = pair_sums(narrow.unionByName(wide)).withColumnRenamed("n", "both")
    spectrum = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("spectrum"))

    sides = checkpointed(groups.join(spectrum, ["lang", "source"], "left").select("lang", "source", "v", "terms", "p0", F.coalesce("spectrum", F.array().cast("array<struct<p:bigint,n:bigint>>")).alias("spectrum")))
    parts = sides.groupBy("lang").agg(F.ceil(F.count("*") / groups_a_task).cast("int").alias("parts"))
    dealt = sides.join(parts, "lang")
    left = dealt.select("lang", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("deal"), *[F.col(c).alias(f"{c}_a") for c in ("source", "v", "terms", "p0", "spectrum")])
    right = dealt.select("lang", F.explode(places(F.lit(0), F.col("parts") - 1)).alias("deal"), *[F.col(c).alias(f"{c}_b") for c in ("source", "terms", "p0", "spectrum")])
    alone = F.aggregate("spectrum_a", F.lit(0).cast("long"), lambda s, x: s + x["n"] * divergence(x["p"], F.col("p0_b")))
    missing = F.aggregate("spectrum_b", F.lit(0).cast("long"), lambda s, x: s + x["n"] * divergence(F.col("p0_a"), x["p"]))
    neither = (F.col("v_a") - F.col("terms_a") - F.col("terms_b")) * divergence(F.col("p0_a"), F.col("p0_b"))
    single = left.join(right, ["lang", "deal"]).where("source_a <> source_b").select("lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"), (alone + missing + neither).alias("single"))
    # a term of both is in each of the three sums; what `part` adds makes that right
    pairs = single.join(common, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), (F.col("single") + F.coalesce("part", F.lit(0))).alias("value"))
    of_pairs = pairs.withColumn("rank", F.row_number().over(best))
    return of_pairs.unionByName(of_terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY 1),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(s, 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY 1, 2) USING (lang, source)),
s AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + {BILLION}::HUGEINT * (coalesce(n, 0) + 1) // (group_n + v)) AS p, (1 + {BILLION}::HUGEINT * (total + 1) // (lang_n + v)) AS q
      FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank FROM s WHERE n > 0 AND p > q),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM b
UNION ALL SELECT lang, source, part, item, value, rank::INT FROM t WHERE rank <= {TOP}"""
