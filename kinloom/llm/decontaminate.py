"""Benchmark decontamination by a prefix-filtered set join.

Every ``window`` neighbouring words of a benchmark item (all of them, if it has fewer) are a set of
word shingles.  Shingles are ordered by rarity in the corpus.  A text can only contain a window if it
has all of its shingles, so for containment a prefix of one shingle is necessary: the window's rarest
one.  Texts are joined to windows on that shingle alone.  Its place within the window says where the
window would begin in the text: a candidate that would reach beyond the text is dropped (length and
positional bounds), and the others are compared word by word with that stretch of the text.
Windows side by side mostly have the same rarest shingle, so few shingles are looked up, and these
are rare ones, so few places of the corpus are candidates.

Shingles that no window has hardly ever leave a task: a filter of 1,024 bits a benchmark shingle (16 MB
at most, where a fuller filter passes more, which the join drops) goes to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kinloom.llm._pointers import BLOCK, LETTERS_AND_DIGITS, Piece, distinct_words, lowered, pieces
from kinloom.llm._spark import checkpointed, lookup, written
from kinloom.llm._text import slices

WINDOW = 10
SHINGLE = 3
SEED = 42
#: Bits of the filter: about 1,024 a shingle, between these powers of two.
A_SHINGLE = 1024
LEAST_BITS = 12
MOST_BITS = 27
#: A task numbers its rows from its own number times this on.
ROWS_A_TASK = 1 << 38


def word_hashes(piece: Piece) -> np.ndarray:
    codes, words = distinct_words(piece.data, piece.starts, piece.ends)
    if not len(codes):
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words.to_pylist()), np.uint64, len(words))[codes]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` neighbouring words, whatever text they are of."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _piece_shingles(piece: Piece, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) for each size: shingles that begin at an own word and end in the same text."""
    words, places = word_hashes(piece), np.arange(piece.own.start, piece.own.stop)
    for size in sizes:
        h = shingle_hashes(words, size)
        at = places[places < len(h)]
        at = at[at + size <= piece.end[at]]
        yield at, h[at]


def _joined(piece: Piece, a: int, b: int) -> str:
    """The words from pointer a to b, joined by one space."""
    return " ".join(bytes(piece.data[s:e]).decode() for s, e in zip(piece.starts[a:b].tolist(), piece.ends[a:b].tolist(), strict=True))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id as a string, window, size, hs): every window of every item, with its shingles' hashes in order."""
    shape = T.StructType([T.StructField("item", T.StringType()), T.StructField("window", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("hs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                ids, out = part.column(1).to_pylist(), [[], [], [], []]
                for piece in pieces(lowered(data), offsets, LETTERS_AND_DIGITS, after=window):
                    hashes = word_hashes(piece)
                    for p in range(piece.own.start, piece.own.stop):
                        left = int(piece.end[p]) - p
                        if left < window and piece.number[p] > 0:
                            continue  # only a whole item may be shorter than a window
                        size = min(window, left)
                        row = (ids[piece.doc[p]], _joined(piece, p, p + size), size, shingle_hashes(hashes[p : p + size], min(shingle, size)).view(np.int64))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=shape.names)

    return items.select("text", F.col("item_id").cast("string")).toDF("t", "i").mapInArrow(run, shape)


class ShingleFilter:
    """Hashes that may be in a set: one bit for each value of their first bits."""

    def __init__(self, hashes: DataFrame, column: str = "h"):
        n = hashes.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, (A_SHINGLE * max(n, 1) - 1).bit_length()))
        place = F.shiftrightunsigned(F.col(column), 64 - self.bits)
        packed = hashes.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        self.words = np.zeros(1 << (self.bits - 6), np.int64)
        for batch in packed.toArrow().to_batches():  # at most a row for each 64 bits
            self.words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.words.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def shingle_counts(docs: DataFrame, filter: ShingleFilter, sizes: list[int]) -> DataFrame:
    """(h, n): how often the shingles that pass the filter occur in all texts."""
    held = docs.sparkSession.sparkContext.broadcast(filter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch):
                for piece in pieces(lowered(data), offsets, LETTERS_AND_DIGITS, after=max(sizes)):
                    for _, hashes in _piece_shingles(piece, sizes):
                        h, n = np.unique(hashes[held.value.passed(hashes)], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def candidate_places(docs: DataFrame, filter: ShingleFilter, sizes: list[int], window: int, block: int = BLOCK) -> DataFrame:
    """A row for each text (row, doc_id, n_words; h is null), and one for each of its places that pass the filter.

    The latter have the shingle's word number ``at``, its hash ``h``, and the text around it: up to
    ``window`` words from the place on and ``before`` of the ones ahead.
    """
    held = docs.sparkSession.sparkContext.broadcast(filter)
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_words", "at", "h", "before")), T.StructField("around", T.StringType())])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = count(TaskContext.get().partitionId() * ROWS_A_TASK)
        for batch in batches:
            for part, data, offsets in slices(batch):
                names = np.fromiter((next(rows) for _ in range(part.num_rows)), np.int64, part.num_rows)
                n_words = np.zeros(part.num_rows, np.int64)
                for piece in pieces(lowered(data), offsets, LETTERS_AND_DIGITS, window - 1, window, block):
                    n_words += np.bincount(piece.doc[piece.own], minlength=part.num_rows)
                    for at, h in _piece_shingles(piece, sizes):
                        found = held.value.passed(h)
                        at, h = at[found], h[found]
                        before = at - np.maximum(piece.begin[at], at - window + 1)
                        stop = np.minimum(piece.end[at], at + window)
                        around = [_joined(piece, a, b) for a, b in zip((at - before).tolist(), stop.tolist(), strict=True)]
                        none = pa.nulls(len(at), arrow.field(2).type)
                        yield pa.RecordBatch.from_arrays([pa.array(names[piece.doc[at]]), pa.nulls(len(at), arrow.field(1).type), none, pa.array(piece.number[at], pa.int64()), pa.array(h.view(np.int64)), pa.array(before, pa.int64()), pa.array(around, pa.string())], schema=arrow)
                nulls = [pa.nulls(part.num_rows, f.type) for f in arrow][3:]
                yield pa.RecordBatch.from_arrays([pa.array(names), part.column(1).cast(arrow.field(1).type), pa.array(n_words), *nulls], schema=arrow)

    return docs.select("text", "doc_id").toDF("t", "d").mapInArrow(run, shape)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated, spans.

    A word is hit if it lies inside any occurrence of a window of an item (item_id, text); words are
    runs of letters, digits and characters beyond ASCII, A-Z as a-z.  ``spans`` are the hit
    stretches (start, end) in word numbers.  Rows that repeat an item_id are one item; an item
    without item_id hits words but is not counted or listed.  Null and empty texts have no words,
    hit nothing and are hit by nothing.  Rows that repeat a doc_id, or have none, are judged each by
    itself.  Very long texts are read whole, a block of words at a time.  Other columns are not
    read, and an empty table gives an empty result.

    The benchmark is read as tables; of it only the filter reaches every task.  Candidates meet
    their windows through ``lookup``, so a passage that many texts share is no hot key.
    """
    every = written(item_windows(items, window, shingle), "windows")
    windows = every.groupBy("window").agg(F.min("size").alias("size"), F.min("hs").alias("hs"), F.collect_set("item").alias("items"))
    windows = checkpointed(windows)
    places = windows.select("window", "size", F.posexplode("hs").alias("o", "h"))
    sizes = sorted(min(shingle, r["size"]) for r in windows.select(F.least("size", F.lit(shingle)).alias("size")).distinct().collect()) or [shingle]
    counts = checkpointed(shingle_counts(docs, ShingleFilter(places.select("h").distinct()), sizes))
    # the rarest shingle of each window; a window with one that occurs nowhere is nowhere
    rarest = places.join(counts, "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "o")).alias("r")).where("r.n > 0")
    chosen = rarest.join(windows.drop("hs"), "window").select("r.h", F.struct(F.col("r.o").alias("o"), "size", "window", "items").alias("w"))
    prefixes = checkpointed(chosen.groupBy("h").agg(F.collect_list("w").alias("ws")))
    found = written(candidate_places(docs, ShingleFilter(prefixes.select("h")), sizes, window, block), "candidates")
    base = found.where("h is null").select("row", "doc_id", "n_words")
    candidates = found.where("h is not null").select("row", "at", "h", "before", "around")
    met = checkpointed(prefixes.join(candidates.groupBy("h").agg(F.count("*").alias("n")), "h"))
    pairs = lookup(candidates, met, ["h"], "n", "inner").select("row", "at", "before", F.split("around", " ").alias("around"), F.explode("ws").alias("w"))
    fits = (F.col("before") >= F.col("w.o")) & (F.col("before") - F.col("w.o") + F.col("w.size") <= F.size("around"))
    there = F.array_join(F.slice("around", (F.col("before") - F.col("w.o") + 1).cast("int"), F.col("w.size")), " ") == F.col("w.window")
    start = F.col("at") - F.col("w.o")
    hits = checkpointed(pairs.where(fits).where(there).select("row", start.alias("start"), (start + F.col("w.size")).alias("end"), "w.items"))
    # stretches that overlap or touch become one
    ahead = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    parted = hits.select("row", "start", "end").distinct().select("row", "start", "end", F.when(F.col("start") <= reached, 0).otherwise(1).alias("new"))
    joined = parted.withColumn("stretch", F.sum("new").over(ahead)).groupBy("row", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    of_text = spans.join(hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids")), "row")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = base.join(of_text, "row", "left").select("doc_id", "n_words", F.coalesce("spans", nothing).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


#: Places of both sides in one table; a window's words are compared as one joined text.
ORACLE = f"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
b AS (SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS size, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS win
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM w),
p AS (SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
h AS (SELECT doc_id, i, p.size, item_id FROM p JOIN w USING (win)),
n AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM h) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id)"""
