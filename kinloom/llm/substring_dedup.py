"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's bytes are cut where the gear hash of the last 16 bytes is the least within some bytes
around, so cuts depend on content alone, an insertion moves only the cuts near it, and gaps vary
less than with a fixed threshold: a passage of 200 bytes seldom holds no whole chunk.  Chunks are deduplicated by
digest across documents, and runs of neighbouring chunks that other documents have too are joined
to spans.  A passage seldom begins and ends at a cut: where the words of the chunks next to a run
could make it long enough, they are compared too, word by word, with those next to the same chunk
elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kinloom.llm._spark import checkpointed, lookup, quoted, unused_names, written
from kinloom.llm._text import slices, span_names, words

REACH = 16
#: A cut's hash is the least of so many places before and after it: there is one in 2 * AROUND + 1 bytes on average.
AROUND = 20
#: A longer stretch without a cut is cut where its hash is least, at every PERIOD bytes if that repeats.
LONGEST = 256
PERIOD = 64
#: 51 words less one at either end, which other punctuation may touch.
MIN_WORDS = 49
GEAR = np.random.RandomState(11).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
DIGEST = 16
#: Bits of the fixed-size filter (16 MB) by which chunks that no other document has are passed over.
FILTER_BITS = 27
#: Told apart in the filter: a chunk as a span's first (its place) and as its last (the place with these bits turned).
OTHER_SIDE = 0x2AAAAAA


def cut_places(data: np.ndarray, offsets: np.ndarray, around: int = AROUND, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts.

    The hash h = 2h + gear[byte] of REACH bytes is added up for all places at once by doubling
    steps, and so is the least hash around each place.  A text's first and last places never cut
    (what is compared would reach out of it).
    """
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    width = 2 * around + 1
    if len(h) < width:
        return _edges(h, np.zeros(0, np.int64), offsets, longest)
    least, k = h, 1
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    least = np.minimum(least[: len(h) - width + 1], least[width - k :])
    at = np.flatnonzero(h[around : len(h) - around] == least) + around
    text = np.searchsorted(offsets, at, "right") - 1
    at = at[(at >= offsets[text] + REACH - 1 + around) & (at < offsets[text + 1] - around)] + 1
    # of equal hashes in reach of each other, as in repeated words, the first one cuts
    return _edges(h, at[np.diff(at, prepend=-width) > around], offsets, longest)


def _edges(h: np.ndarray, at: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.unique(np.concatenate([at, offsets]))
    while len(long := np.flatnonzero(np.diff(edges) > longest)):
        edges = np.unique(np.concatenate([edges, *(_least_places(h, edges[i], edges[i + 1]) for i in long)]))
    return edges[:-1], edges[1:]


def _least_places(h: np.ndarray, start: int, end: int) -> np.ndarray:
    """Cuts within a long stretch: where the hash is least.  In a stretch that repeats itself that is once a period."""
    part = h[start + REACH : end - 1]
    at = np.flatnonzero(part == part.min()) + start + REACH + 1
    gaps = np.diff(at, prepend=at[0] - PERIOD)
    # of places nearer than PERIOD every so manyth is taken, counted from the first of them
    first = np.flatnonzero(gaps >= PERIOD)
    run = np.searchsorted(first, np.arange(len(at)), "right") - 1
    index = np.arange(len(at)) - first[run]
    gap = np.concatenate([gaps[1:], [PERIOD]])[first][run]
    return at[index % np.maximum(-(-PERIOD // gap), 1) == 0]


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(span, DIGEST bytes): SHA-256, shortened; equal spans of a slice are hashed once."""
    names, size = span_names(data, starts, ends)
    first = np.full(size, -1)
    first[names[::-1]] = np.arange(len(names))[::-1]
    text, sha = data.tobytes(), hashlib.sha256
    made = b"".join([sha(text[a:b]).digest()[:DIGEST] if a >= 0 else bytes(DIGEST) for a, b in zip(np.where(first >= 0, starts[first], -1).tolist(), ends[first].tolist(), strict=True)])
    return np.frombuffer(made, np.uint8).reshape(-1, DIGEST)[names]


def _spots(digest: np.ndarray) -> np.ndarray:
    """A digest's place in the filter: its first FILTER_BITS bits."""
    return (np.ascontiguousarray(digest[:, :4]).view(">u4").ravel() >> np.uint32(32 - FILTER_BITS)).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, flat.size + 1, DIGEST, dtype=np.int32)), pa.py_buffer(flat)])


class Chunks:
    """The chunks of a slice of texts: doc, place, starts, ends, n_words (of the words that begin there), digest, spots."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, around: int):
        self.starts, self.ends = cut_places(data, offsets, around)
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.place = np.arange(len(self.starts)) - np.searchsorted(self.starts, offsets[:-1])[self.doc]
        self.word_starts, self.word_ends, _ = words(data, offsets)
        # how far a passage that holds a chunk, but not its neighbour as it is, can go on: to the end
        # of the next chunk and beyond, and beyond the begin of the one before, since the first and
        # last cuts within a passage depend on bytes outside of it
        self.left, self.right = self.starts.copy(), self.ends.copy()
        same = self.doc[1:] == self.doc[:-1]
        self.left[1:][same] = np.maximum(self.starts[:-1] - REACH - around, offsets[self.doc[1:]])[same]
        self.right[:-1][same] = np.minimum(self.ends[1:] + around, offsets[self.doc[1:] + 1])[same]
        begun = lambda a, b: np.searchsorted(self.word_starts, b) - np.searchsorted(self.word_starts, a)
        self.n_words, self.before, self.after = begun(self.starts, self.ends), begun(self.left, self.starts), begun(self.ends, self.right)
        self.digest = digests(data, self.starts, self.ends)
        self.spots = _spots(self.digest)


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What tells texts of one doc_id apart: Spark's xxhash64 of the text."""
    import xxhash

    text = memoryview(data.tobytes())
    return np.array([xxhash.xxh64_intdigest(text[a:b], 42) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _scan(docs: DataFrame, schema: T.StructType, made, around: int) -> DataFrame:
    """Rows from each slice's chunks; ``made(data, offsets, chunks)`` gives (chunk numbers, columns behind doc_id and key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, most=1 << 20):
                if len(data):
                    cut = Chunks(data, offsets, around)
                    rows, columns = made(data, offsets, cut)
                    doc = cut.doc[rows]
                    yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(doc)), pa.array(_keys(data, offsets)[doc]), *columns], names=schema.names)

    return docs.where("text is not null and doc_id is not null").select("text", "doc_id").mapInArrow(run, schema)


def _schema(docs: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], T.StructField("key", T.LongType()), *(T.StructField(n, t) for n, t in fields)])


def _spot(digest: str) -> Column:
    """As ``_spots``."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - FILTER_BITS).cast("int")


def _filter(spots: DataFrame) -> np.ndarray:
    """Which places of the filter the rows' ``spot`` takes: 2^FILTER_BITS bits, whatever the number of rows."""
    spot = F.col("spot").cast("long") + 1
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    made = spots.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    for row in made.collect():  # 4,096 rows of 4 KB at most
        size = len(row["m"])
        bits[(row["b"] - 1) * size : row["b"] * size] = np.frombuffer(bytes(row["m"]), np.uint8)
    return bits


def _passed(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[spots >> 3] >> (spots & 7).astype(np.uint8) & 1)


def _shared_chunks(docs: DataFrame, around: int) -> DataFrame:
    """The chunks that other documents have too, with the smallest doc_id (first_doc_id) and the rows (n) that have them.

    Columns: doc_id, key, spot (of the digest), place, start, size (bytes of UTF-8), n_words, before and after
    (words around that a passage with this chunk may hold too), first_doc_id, n.
    """
    i32 = lambda x: pa.array(x.astype(np.int32))
    names = _scan(docs, _schema(docs, ("digest", T.BinaryType())), lambda data, offsets, c: (np.arange(len(c.starts)), [_binary(c.digest)]), around)
    counts = names.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = checkpointed(counts.where("low < high").select("digest", F.col("low").alias("first_doc_id"), "n"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter(shared.select(_spot("digest").alias("spot"))))

    def kept(data: np.ndarray, offsets: np.ndarray, c: Chunks) -> tuple[np.ndarray, list[pa.Array]]:
        rows = _passed(bits.value, c.spots)
        at = c.starts[rows] - offsets[c.doc[rows]]
        return rows, [_binary(c.digest[rows]), i32(c.place[rows]), i32(at), *(i32(x[rows]) for x in (c.ends - c.starts, c.n_words, c.before, c.after))]

    fields = [("digest", T.BinaryType()), *((n, T.IntegerType()) for n in ("place", "start", "size", "n_words", "before", "after"))]
    pieces = written(_scan(docs, _schema(docs, *fields), kept, around), "chunks")
    found = lookup(pieces, shared, ["digest"], "n", "inner").withColumn("digest", _spot("digest")).withColumnRenamed("digest", "spot")
    # one shuffle by text serves what follows too
    return found.repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "place"])


def _with_runs(rows: DataFrame) -> DataFrame:
    """run numbers the runs of neighbouring chunks of a text.  A text's rows are in one group: as large as its shared part."""
    order = Window.partitionBy("doc_id", "key").orderBy("place")
    return rows.withColumn("run", F.col("place") - F.row_number().over(order))


def _extended(docs: DataFrame, spans: DataFrame, min_words: int, around: int) -> DataFrame:
    """``spans`` (too short ones with enough words around) with the words that another document has beside the same chunk too.

    Every occurrence of a chunk that ends such a span gives one row: a digest of the chunk and the
    bytes from it to each word's end (or back to its begin).  Digests that two documents have are
    common words.
    """
    side_of = {"head": 0, "tail": 1}
    ends = [spans.select(F.col(f"{name}.spot").bitwiseXOR(F.lit(side * OTHER_SIDE)).alias("spot")) for name, side in side_of.items()]
    bits = docs.sparkSession.sparkContext.broadcast(_filter(ends[0].union(ends[1])))
    sha = hashlib.sha256

    def neighbours(data: np.ndarray, offsets: np.ndarray, c: Chunks) -> tuple[np.ndarray, list[pa.Array]]:
        text, rows, out = data.tobytes(), [], []
        for side in (0, 1):
            for i in _passed(bits.value, c.spots ^ (side * OTHER_SIDE)).tolist():
                if side:
                    stops = c.word_ends[np.searchsorted(c.word_ends, c.ends[i], "right") : np.searchsorted(c.word_ends, c.right[i], "right")]
                    found = np.column_stack([np.full(len(stops), c.ends[i]), stops])
                else:
                    begins = c.word_starts[np.searchsorted(c.word_starts, c.left[i]) : np.searchsorted(c.word_starts, c.starts[i])][::-1]
                    found = np.column_stack([begins, np.full(len(begins), c.starts[i])])
                if len(found):
                    before = sha(c.digest[i].tobytes() + bytes([side]))
                    made = []
                    for a, b in found.tolist():
                        one = before.copy()
                        one.update(text[a:b])
                        made.append(one.digest()[:DIGEST])
                    rows.append(i)
                    out.append((side, np.diff(np.searchsorted(c.word_starts, found), axis=1).ravel(), np.diff(found, axis=1).ravel(), b"".join(made)))
        rows = np.array(rows, np.int64)
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
        return rows, [pa.array(c.place[rows].astype(np.int32)), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))]

    fields = [("place", T.IntegerType()), ("side", T.IntegerType()), ("words", T.ArrayType(T.IntegerType())), ("bytes", T.ArrayType(T.IntegerType())), ("digests", T.BinaryType())]
    beside = written(_scan(docs, _schema(docs, *fields), neighbours, around), "neighbours")
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.substring("digests", i * DIGEST + 1, F.lit(DIGEST)))).alias("j", "common")
    alike = beside.select("doc_id", each).groupBy("common").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("common")
    ours = spans.select("doc_id", "key", F.explode(F.array(*[F.struct(F.col(f"{name}.place").alias("place"), F.lit(side).alias("side")) for name, side in side_of.items()])).alias("e")).select("doc_id", "key", "e.*")
    mine = written(ours.join(beside, ["doc_id", "key", "place", "side"]).select("doc_id", "key", "place", "side", "words", "bytes", each).dropDuplicates(["doc_id", "key", "place", "side", "j"]), "spans")
    weighed = checkpointed(mine.groupBy("common").agg(F.count("*").alias("n")).join(alike, "common"))
    more = F.max(F.struct("j", F.element_at("words", F.col("j") + 1).alias("words"), F.element_at("bytes", F.col("j") + 1).alias("bytes"))).alias("more")
    most = checkpointed(lookup(mine, weighed, ["common"], "n", "inner").groupBy("doc_id", "key", "place", "side").agg(more))
    gain = lambda name: most.where(F.col("side") == side_of[name]).select("doc_id", "key", F.col("place").alias(f"{name}_place"), F.col("more").alias(f"{name}_more"))
    placed = spans.withColumns({"head_place": F.col("head.place"), "tail_place": F.col("tail.place")})
    joined = placed.join(gain("head"), ["doc_id", "key", "head_place"], "left").join(gain("tail"), ["doc_id", "key", "tail_place"], "left")
    gained = lambda name, c: F.coalesce(F.col(f"{name}_more.{c}"), F.lit(0))
    wider = joined.withColumns({
        "n_words": F.col("n_words") + gained("head", "words") + gained("tail", "words"),
        "start": F.col("start") - gained("head", "bytes"), "size": F.col("size") + gained("head", "bytes") + gained("tail", "bytes"),
    })
    return wider.select(*spans.columns).where(F.col("n_words") >= min_words)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, around: int = AROUND) -> DataFrame:
    """Spans of at least ``min_words`` words that occur in other documents too.

    Returns doc_id, start, size (bytes of the text's UTF-8), n_words (words that begin there),
    n_chunks, n_repeats (its chunks that a smaller doc_id has too), first_doc_id (of the smallest
    doc_ids that have its chunks, the one with most of the span), most_docs (the largest number of
    rows that share one) and key, Spark's xxhash64 of the text.  A span ends at a chunk's border,
    or up to the last common word beyond where that decides whether it is long enough.  Null and
    empty texts and rows without a doc_id have no spans; rows that repeat a doc_id are no
    documents of each other's, but texts of one doc_id are looked at one by one (see key); rows
    that repeat both count once; texts of any length are read whole; an empty table gives an empty
    result.  Other columns are not read.
    """
    # a chunk may be in some other document by chance, so the first document is the one that has most of the span
    by_first = _with_runs(_shared_chunks(docs, around)).groupBy("doc_id", "key", "run", "first_doc_id").agg(
        F.min("start").alias("start"), F.sum("size").alias("size"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_chunks"), F.max("n").alias("most_docs"),
        F.min(F.struct("place", "spot", "before")).alias("head"), F.max(F.struct("place", "spot", "after")).alias("tail"),
    )
    spans = by_first.groupBy("doc_id", "key", "run").agg(
        F.min("start").alias("start"), F.sum("size").alias("size"), F.sum("n_words").alias("n_words"), F.sum("n_chunks").alias("n_chunks"),
        F.sum(F.when(F.col("first_doc_id") < F.col("doc_id"), F.col("n_chunks")).otherwise(0)).alias("n_repeats"),
        F.min_by("first_doc_id", F.struct(-F.col("size"), F.col("first_doc_id"))).alias("first_doc_id"), F.max("most_docs").alias("most_docs"),
        F.min("head").alias("head"), F.max("tail").alias("tail"),
    ).drop("run")
    spans = checkpointed(spans.where(F.col("n_words") + F.col("head.before") + F.col("tail.after") >= min_words))
    done, open_ = spans.where(F.col("n_words") >= min_words), spans.where(F.col("n_words") < min_words)
    if not open_.isEmpty():
        done = done.unionByName(_extended(docs, open_, min_words, around))
    return done.drop("head", "tail")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, around: int = AROUND) -> DataFrame:
    """``docs`` without the runs of chunks, of at least ``min_words`` words, that smaller doc_ids have; all columns stay, whatever their names.

    Runs are cut out at chunk borders, so some words of a passage may stay at either end.  Rows
    without a doc_id or text stay as they are.
    """
    again = _with_runs(_shared_chunks(docs, around).where(F.col("first_doc_id") < F.col("doc_id")))
    again = again.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "key", "run"))).where(F.col("run_words") >= min_words)
    id_, key, cuts, kept = unused_names(docs, "cut_id_", "cut_key_", "cuts_", "kept_")
    found = again.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias(cuts))
    body = F.col("text").cast("binary")
    start = F.struct(F.lit(0).alias("at"), F.encode(F.lit(""), "UTF-8").alias("out"))
    rest = F.aggregate(cuts, start, lambda s, c: F.struct((c["start"] + c["size"]).alias("at"), F.concat(s["out"], F.substring(body, s["at"] + 1, c["start"] - s["at"])).alias("out")))
    joined = docs.join(found, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)), "left").withColumn(kept, rest)
    whole = F.concat(F.col(f"{kept}.out"), F.substring(body, F.col(f"{kept}.at") + 1, F.octet_length("text")))
    # a chunk may end inside a character of several bytes; a broken one is replaced
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.make_valid_utf8(whole.cast("string")))
    return joined.withColumn("text", text).select(*map(quoted, docs.columns))
