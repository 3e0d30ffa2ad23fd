"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram's value in a text is log(1 + its count per thousand characters), times the log ratio of
its mean density in toxic and in other texts of the learning sample.  A logistic regression over
the n-grams that tell the classes apart best is then applied to every whole text in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from kinloom.llm._spark import held_out, learning_rows, unused_names
from kinloom.llm._text import SLICE_BYTES, SPACE, appended, doc_sums, slices

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 18
#: About so many labelled documents are learned from (a bound of the classifier alone).
LEARN_FROM = 16_000
FEATURES = 1024
THRESHOLD = 0.5
#: Texts scored at a time, so that their values (a row of FEATURES numbers each) stay small.
ROWS = 256
MULTIPLIER = np.uint32(0x01000193)
SPREAD = np.uint32(0x9E3779B1)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in lower case (Latin letters), between spaces, and their offsets."""
    flat = data.copy()
    flat[SPACE[flat]] = 0x20
    starts = np.concatenate([[0], np.cumsum(doc_sums((data & 0xC0) != 0x80, offsets))])
    code = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(offsets) - 1
    # each text gets a space on either side: text i moves up by 2i+1 places
    out = np.full(len(code) + 2 * n, 0x20, np.uint32)
    out[np.arange(len(code)) + 2 * np.repeat(np.arange(n), np.diff(starts)) + 1] = code
    upper = ((out >= 0x41) & (out <= 0x5A)) | ((out >= 0xC0) & (out <= 0xDE) & (out != 0xD7))
    out[upper] += 32
    return out, starts + 2 * np.arange(n + 1)


def gram_buckets(code: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order: the bucket of the n-gram at each place, and which places hold one within their text."""
    h, done = np.zeros(len(code), np.uint32), 0
    for n in sorted(orders):
        for k in range(done, n):
            h = h * MULTIPLIER
            h[: max(len(code) - k, 0)] += code[k:] + np.uint32(1)
        done = n
        whole = np.ones(len(code), bool)
        ends = offsets[1:]
        tails = (ends[:, None] - np.arange(1, n)).ravel()
        whole[tails[tails >= np.repeat(offsets[:-1], n - 1)]] = False
        mixed = (h ^ np.uint32(n)) * SPREAD
        mixed ^= mixed >> np.uint32(15)
        yield ((mixed * SPREAD) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), whole


def _counts(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, width: int, inner: tuple[int, int] | None = None) -> np.ndarray:
    """(text, column): how often the chosen n-grams occur; with ``inner`` only those that begin in this range of places."""
    code, starts = characters(data, offsets)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    out = np.zeros(n * width)
    for buckets, whole in gram_buckets(code, starts):
        if inner:
            whole[: inner[0]] = whole[inner[1] :] = False
        column = place[buckets]
        hit = np.flatnonzero((column >= 0) & whole)
        out += np.bincount(owner[hit] * width + column[hit], minlength=n * width)
    return out.reshape(n, width)


def blocks(data: np.ndarray, block: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, tuple[int, int], int]]:
    """One long text in blocks that overlap by the longest n-gram: bytes, the places whose n-grams count, own characters."""
    overlap, at = max(ORDERS) - 1, 0
    head = lambda x: (x & 0xC0) != 0x80
    while at < len(data):
        stop = at + block
        while stop < len(data) and not head(data[stop]):
            stop += 1
        stop = min(stop, len(data))
        # a few characters more, of four bytes at most, end the n-grams that begin before stop
        after = np.flatnonzero(head(data[stop : stop + 4 * (overlap + 1)]))
        end = stop + int(after[overlap]) if len(after) > overlap else len(data)
        own = int(np.count_nonzero(head(data[at:stop])))
        # place 0 is the space before the block: the text's own for the first block alone
        yield data[at:end], (0 if at == 0 else 1, 1 << 62 if stop == len(data) else own + 1), own
        at = stop


def densities(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Counts per thousand characters of the chosen n-grams: place[bucket] is a column or -1."""
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
        counts, size = np.zeros((1, width)), 0
        for part, inner, own in blocks(data):
            counts, size = counts + _counts(part, np.array([0, len(part)]), place, width, inner), size + own
        return counts * (1000.0 / size)
    sizes = doc_sums((data & 0xC0) != 0x80, offsets)
    return _counts(data, offsets, place, width) * (1000.0 / np.maximum(sizes, 1))[:, None]


class Model:
    """place: column of each bucket or -1; scale, weight: by column; bias."""

    def __init__(self, place: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float):
        self.place, self.scale, self.weight, self.bias = place, scale, weight, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = np.full(len(offsets) - 1, self.bias)
        if len(self.weight):
            margin += np.log1p(densities(data, offsets, self.place, len(self.weight))) @ (self.scale * self.weight)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _class_densities(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, other): sums of the n-grams' densities by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BUCKET_BITS))
        for batch in batches:
            for part, data, offsets in slices(batch):
                sizes = doc_sums((data & 0xC0) != 0x80, offsets)
                y = np.asarray(part.column(1)).astype(bool)
                long = part.num_rows == 1 and len(data) > 2 * SLICE_BYTES
                for some, inner, _ in blocks(data) if long else [(data, (0, 1 << 62), 0)]:
                    code, starts = characters(some, np.array([0, len(some)]) if long else offsets)
                    weight = np.repeat(1000.0 / np.maximum(sizes, 1), np.diff(starts))
                    side = np.repeat(y, np.diff(starts))
                    for buckets, whole in gram_buckets(code, starts):
                        whole[: inner[0]] = whole[inner[1] :] = False
                        for c in (0, 1):
                            use = whole & (side == bool(c))
                            sums[c] += np.bincount(buckets[use], weights=weight[use], minlength=1 << BUCKET_BITS)
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[1][used]), pa.array(sums[0][used])], names=["bucket", "toxic", "other"])

    return sample.mapInArrow(run, "bucket int, toxic double, other double").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn_from: int = LEARN_FROM, features: int = FEATURES) -> Model:
    """Learn from about ``learn_from`` labelled documents that are not held out.

    Without both classes in the sample the score is the share of label 1 for every text (0
    without labels).
    """
    sample = learning_rows(docs, labels, label, learn_from)
    count = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = count["n"], count["p"]
    place = np.full(1 << BUCKET_BITS, -1, np.int16)
    if not 0 < p < n:
        share = min(max(p / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model(place, np.zeros(0), np.zeros(0), float(np.log(share / (1 - share))))
    mean_1, mean_0 = F.col("toxic") / p, F.col("other") / (n - p)
    ratio = F.log((mean_1 + 0.01) / (mean_0 + 0.01))
    worth = F.abs(mean_1 - mean_0) / F.sqrt((mean_1 + mean_0) * (1 / p + 1 / (n - p)) + 1e-6)
    best = _class_densities(sample).select("bucket", ratio.alias("ratio"), worth.alias("worth")).orderBy(F.desc("worth"), "bucket").limit(features).collect()
    scale = np.array([r["ratio"] for r in best])
    place[[r["bucket"] for r in best]] = np.arange(len(best))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, rows=ROWS):
                x = np.log1p(densities(data, offsets, place, len(scale))) * scale
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(1), flat], names=["y", "x"])

    table = sample.mapInArrow(values, "y int, x array<double>").select(F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features"))
    fitted = LogisticRegression(maxIter=60, regParam=1e-3, standardization=False).fit(table)
    return Model(place, scale, fitted.coefficients.toArray(), float(fitted.intercept))


def score(docs: DataFrame, model: Model, carry: list[str], name: str = "score") -> DataFrame:
    """The columns ``carry`` of ``docs`` and the score of the whole text; null text counts as empty."""
    return appended(docs, carry, [T.StructField(name, T.DoubleType())], lambda data, offsets: [model.scores(data, offsets)], ROWS)


def toxicity(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without n-grams.  Labels, lang, source and
    doc_id are no inputs of a score.  Repeated rows are scored alike; an empty table gives an
    empty result; other columns are not read.
    """
    scored = score(docs, fit(docs, labels, **fitting), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns as they are, whatever their names.

    Null and empty texts get the score of a text without n-grams; very long ones are scored whole,
    a block at a time.  Repeated rows are judged alike, and a score of just THRESHOLD goes.  A null
    doc_id is scored like any other.  An empty table gives an empty result.
    """
    (name,) = unused_names(docs, "toxic_score")
    return score(docs, fit(docs, labels, **fitting), docs.columns, name).where(F.col(name) < THRESHOLD).drop(name)
