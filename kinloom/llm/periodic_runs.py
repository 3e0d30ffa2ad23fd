"""Periodic runs of words by block convolution.

A run repeats its first q words at least four times.  For periods from D to 2D, D a power of two, a
run holds a whole block of D words that begins at a multiple of D, and the same block again q words
later.  So each block is laid over the words behind it, at all distances from D to 2D - 1 at once:
the sum of squared differences at every distance is a convolution, worked out in integers by a
number-theoretic transform.  It is 0 where the block occurs again; those distances are extended to
both sides, word by word, to the longest stretch of that period.

* The transform works modulo a prime, where a sum of 0 is necessary, and the extension compares the
  words, so every reported run is exact.
* Blocks of over 4,096 words are laid over by their first 4,096, in as many steps, so transforms stay
  small whatever the period.
* A block with a word that does not come back within 2D words cannot occur there; a block that lies
  with all its distances inside a known run of a shorter period can only find that run again.  Both
  are passed over.
* Below 16 words the squared differences are formed without a transform, for all texts at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from kinloom.llm._pointers import NOT_SPACE, distinct_words, pieces
from kinloom.llm._text import slices

TIMES = 4
LEAST_WORDS = 6
#: Shorter periods are compared directly.
DIRECT = 16
#: Words of a block that are laid over what follows.
MOST_IN_BLOCK = 4096
#: Numbers that are transformed at a time.
AT_A_TIME = 1 << 20
PRIME = 998244353
GENERATOR = 3
WORDS_AT_A_TIME = 1 << 16


def _roots(size: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:  # by doubling: the next half is the first one times root^len
        out = np.concatenate([out, _reduced(out * np.uint64(pow(root, len(out), PRIME)))])
    return out


def _reduced(x: np.ndarray) -> np.ndarray:
    return x - x // np.uint64(PRIME) * np.uint64(PRIME)


def _once(x: np.ndarray) -> np.ndarray:
    """Values below twice the prime, reduced."""
    return np.minimum(x, x - np.uint64(PRIME))  # wraps to a large number where x is below


_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _roots_of(size: int, inverse: bool) -> np.ndarray:
    if (size, inverse) not in _ROOTS:
        _ROOTS[size, inverse] = _roots(size, inverse)
    return _ROOTS[size, inverse]


def transformed(rows: np.ndarray) -> np.ndarray:
    """Each row's transform, in bit-reversed order; rows are powers of two long."""
    m, size = rows.shape
    half = size // 2
    while half:
        pairs = rows.reshape(m, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = _once(u + v)
        out[:, :, 1] = _reduced((u + np.uint64(PRIME) - v) * _roots_of(2 * half, False))
        rows, half = out.reshape(m, size), half // 2
    return rows


def transformed_back(rows: np.ndarray) -> np.ndarray:
    m, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(m, -1, 2, half)
        u, v = pairs[:, :, 0], _reduced(pairs[:, :, 1] * _roots_of(2 * half, True))
        out = np.empty_like(pairs)
        out[:, :, 0] = _once(u + v)
        out[:, :, 1] = _once(u + np.uint64(PRIME) - v)
        rows, half = out.reshape(m, size), half * 2
    return _reduced(rows * np.uint64(pow(size, PRIME - 2, PRIME)))


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Modulo PRIME, (m, B): the sum over i of (block[i] - window[k + i])^2 for k below B.  Blocks are (m, B), windows (m, 2B)."""
    size = blocks.shape[1]
    turned = np.zeros_like(windows)
    turned[:, :size] = blocks[:, ::-1]
    products = transformed_back(_reduced(transformed(turned) * transformed(windows)))[:, size - 1 : 2 * size - 1]
    own = _reduced(_reduced(blocks * blocks).sum(axis=1))[:, None]
    sums = np.zeros((len(windows), 2 * size + 1), np.uint64)
    np.cumsum(_reduced(windows * windows), axis=1, out=sums[:, 1:])
    theirs = _reduced(sums[:, size : 2 * size] - sums[:, :size])
    return _reduced(own + theirs + np.uint64(2) * (np.uint64(PRIME) - products))


class Texts:
    """The words of some texts one after another, as numbers x, and where each text's words begin and end."""

    def __init__(self, x: np.ndarray, bounds: np.ndarray):
        self.x, self.bounds = x, bounds
        self.runs: list[tuple[int, int, int]] = []  # start, end, period
        self.known: set[tuple[int, int]] = set()

    def find(self) -> list[tuple[int, int, int]]:
        n = len(self.x)
        if n >= LEAST_WORDS:
            self._direct()
            longest, size = int(np.diff(self.bounds).max(initial=0)), DIRECT
            if longest >= TIMES * size:
                ahead = self._next_distance()
                while TIMES * size <= longest:
                    self._scale(size, ahead)
                    size *= 2
        return self.runs

    def _keep(self, start: int, end: int, period: int) -> None:
        # periods come from small to large, so the first one of a stretch is its smallest
        if end - start >= max(LEAST_WORDS, TIMES * period) and (start, end) not in self.known:
            self.known.add((start, end))
            self.runs.append((start, end, period))

    def _direct(self) -> None:
        text = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))
        for period in range(1, min(DIRECT, len(self.x) // TIMES + 1)):
            same = np.flatnonzero((self.x[:-period] == self.x[period:]) & (text[:-period] == text[period:]))
            if not len(same):
                continue
            cut = np.flatnonzero(np.diff(same) != 1) + 1
            first, last = same[np.concatenate([[0], cut])], same[np.concatenate([cut - 1, [len(same) - 1]])]
            for i in np.flatnonzero(last - first + 1 + period >= max(LEAST_WORDS, TIMES * period)):
                self._keep(int(first[i]), int(last[i]) + 1 + period, period)

    def _next_distance(self) -> np.ndarray:
        """How far ahead each word comes again in its text; a large number if it does not."""
        order = np.argsort(self.x, kind="stable")
        out = np.full(len(self.x), np.iinfo(np.int32).max, np.int32)
        again = self.x[order[1:]] == self.x[order[:-1]]
        a, b = order[:-1][again], order[1:][again]
        within = b < self.bounds[np.searchsorted(self.bounds, a, "right")]
        out[a[within]] = (b - a)[within]
        return out

    def _scale(self, d: int, ahead: np.ndarray) -> None:
        """Runs with periods from d to 2d - 1."""
        size = min(d, MOST_IN_BLOCK)
        begins, ends = self.bounds[:-1], self.bounds[1:]
        long = ends - begins >= TIMES * d
        begins, ends = begins[long], ends[long]
        per = (ends - begins - d - size) // d + 1
        at = np.repeat(begins - (np.cumsum(per) - per) * d, per) + np.arange(per.sum()) * d
        begin, end = np.repeat(begins, per), np.repeat(ends, per)
        lost = np.concatenate([[0], np.cumsum(ahead >= 2 * d, dtype=np.int32)])
        keep = lost[at + size] == lost[at]
        at, begin, end = at[keep], begin[keep], end[keep]
        # the run that reaches furthest of those that begin before a block
        runs = np.array(sorted(r for r in self.runs if r[2] <= size) or np.zeros((0, 3)), np.int64).reshape(-1, 3)
        furthest = np.maximum.accumulate(runs[:, 1])
        holder = np.concatenate([[-1], np.maximum.accumulate(np.where(runs[:, 1] == furthest, np.arange(len(runs)), -1))])[np.searchsorted(runs[:, 0], at, "right")]
        held = np.concatenate([[-1], furthest])[np.searchsorted(runs[:, 0], at, "right")]
        keep = held < np.minimum(at + 2 * d - 1 + size, end)
        at, begin, end, holder = at[keep], begin[keep], end[keep], holder[keep]
        rows = max(1, AT_A_TIME // (2 * size))
        tried: dict[tuple[int, int], int] = {}
        for i in range(0, len(at), rows):
            for near in range(d, 2 * d, size):
                self._laid_over(at[i : i + rows], begin[i : i + rows], end[i : i + rows], holder[i : i + rows], near, size, runs, tried)

    def _laid_over(self, at: np.ndarray, begin: np.ndarray, end: np.ndarray, holder: np.ndarray, near: int, size: int, runs: np.ndarray, tried: dict[tuple[int, int], int]) -> None:
        """Blocks at distances from ``near`` to ``near + size - 1``."""
        blocks = self.x[at[:, None] + np.arange(size)].astype(np.uint64)
        places = at[:, None] + near + np.arange(2 * size)
        windows = np.where(places < end[:, None], self.x[np.minimum(places, len(self.x) - 1)], 0).astype(np.uint64)
        row, k = np.nonzero(squared_differences(blocks, windows) == 0)
        distance = near + k
        inside = at[row] + distance + size <= end[row]
        if len(runs):
            run = runs[holder[row]]
            inside &= (holder[row] < 0) | (at[row] + distance + size > run[:, 1]) | (distance % run[:, 2] != 0)
        for r, d in zip(row[inside].tolist(), distance[inside].tolist(), strict=True):
            a, lo, hi = int(at[r]), int(begin[r]), int(end[r])
            # blocks come in order, so only the last stretch of a distance can hold this one
            if tried.get((lo, d), -1) >= a + size + d or not np.array_equal(self.x[a : a + size], self.x[a + d : a + d + size]):
                continue
            start, stop = self._extended(a, a + size, d, lo, hi)
            tried[lo, d] = stop + d
            self._keep(start, stop + d, d)

    def _extended(self, a: int, b: int, d: int, lo: int, hi: int) -> tuple[int, int]:
        """The longest [start, stop) around [a, b) whose words equal those d further on."""
        x, step = self.x, 64
        while b + d < hi:
            to = min(b + step, hi - d)
            differ = np.flatnonzero(x[b:to] != x[b + d : to + d])
            if len(differ):
                b += int(differ[0])
                break
            b, step = to, 2 * step
        step = 64
        while a > lo:
            to = max(a - step, lo)
            differ = np.flatnonzero(x[to:a] != x[to + d : a + d])
            if len(differ):
                a = to + int(differ[-1]) + 1
                break
            a, step = to, 2 * step
        return a, b


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of a slice's words (equal words have equal numbers), and where each text's words begin and end."""
    found, names = [], {}
    n_words = np.zeros(len(offsets) - 1, np.int64)
    for piece in pieces(data, offsets, NOT_SPACE):
        codes, words = distinct_words(piece.data, piece.starts, piece.ends)
        if len(piece.data) < len(data):  # a block of a long text: numbers go on over all of them
            codes = np.array([names.setdefault(w, len(names)) for w in words.to_pylist()], np.int64)[codes]
        found.append(((piece.starts + piece.base).astype(np.int32), (piece.ends + piece.base).astype(np.int32), codes.astype(np.int32)))
        n_words += np.bincount(piece.doc, minlength=len(n_words))
    starts, ends, codes = (np.concatenate(c) for c in zip(*found, strict=True))
    return starts, ends, codes, np.concatenate([[0], np.cumsum(n_words)])


def planted(doc_id: object, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on are to repeat with period p, by the id's checksum; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return None if h % 10 else (g % n, 1 + (n - g % n) // (3 + g % 8))


def _collapsed(text: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray | None) -> str:
    """SHA-256 of the words of these numbers (all of them for None), joined by one space."""
    sha = hashlib.sha256()
    if words is None and len(text) < WORDS_AT_A_TIME * 16:
        sha.update(b" ".join(text.split()))
        return sha.hexdigest()
    words = np.arange(len(starts)) if words is None else words
    for i in range(0, len(words), WORDS_AT_A_TIME):
        some = words[i : i + WORDS_AT_A_TIME]
        sha.update((b" " if i else b"") + b" ".join([text[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]))
    return sha.hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_runs, start, length, period, exponent_milli, runs, runs_sha256, collapsed_sha256.

    Words are runs of characters other than ASCII white space.  A run is a stretch of words with
    smallest period q, at least max(6, 4q) words long, that cannot be made longer; ``runs`` has all of
    them (start, length, period) by start and period, the columns before it the longest one (ties: the
    smallest start, then period; nulls without a run).  ``collapsed_sha256`` is the text without the
    words that a run repeats.  With ``plant`` the texts that ``planted`` names are made periodic first.

    Null and empty texts have no words and no runs.  A text is handled by one task, whole, in numbers
    of its words; each row is judged by itself, so repeated rows and doc_ids are repeated in the
    result, and a null doc_id is never planted.  Other columns are not read; an empty table gives an
    empty result.  Nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    long = T.LongType()
    run_type = T.ArrayType(T.StructType([T.StructField(n, long) for n in ("start", "length", "period")]))
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, long) for n in ("n_runs", "start", "length", "period", "exponent_milli")), T.StructField("runs", run_type), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])
    arrow = to_arrow_schema(shape)

    def judged(data: np.ndarray, offsets: np.ndarray, ids: list) -> list[list]:
        starts, ends, x, bounds = word_numbers(data, offsets)
        source: dict[int, np.ndarray] = {}  # of planted texts: the word that stands in each place
        for i, doc_id in enumerate(ids):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if plant and (how := planted(doc_id, hi - lo)):
                a, p = how
                words = np.arange(hi - lo)
                words[a:] = a + (words[a:] - a) % p
                source[i] = words
                x[lo:hi] = x[lo:hi][words]
        by_text: list[list] = [[] for _ in ids]
        found = sorted((s, q, e) for s, e, q in Texts(x, bounds).find())
        text = np.searchsorted(bounds, [s for s, _, _ in found], "right") - 1
        for t, (s, q, e) in zip(text.tolist(), found, strict=True):
            by_text[t].append((s - int(bounds[t]), e - s, q))
        out: list[list] = [[] for _ in arrow]
        for i, runs in enumerate(by_text):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            words = source.get(i)
            if runs:
                repeats = np.zeros(hi - lo + 1, np.int32)
                np.add.at(repeats, [s + q for s, _, q in runs], 1)
                np.add.at(repeats, [s + n for s, n, _ in runs], -1)
                kept = np.flatnonzero(np.cumsum(repeats[:-1]) == 0)
                words = kept if words is None else words[kept]
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            lines = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
            a, b = int(offsets[i]), int(offsets[i + 1])
            collapsed = _collapsed(data[a:b].tobytes(), starts[lo:hi] - a, ends[lo:hi] - a, words)
            values = (ids[i], len(runs), *best, 1000 * best[1] // best[2] if runs else None, [{"start": s, "length": n, "period": q} for s, n, q in runs], lines, collapsed)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                made = judged(data, offsets, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return docs.select("text", "doc_id").toDF("t", "d").mapInArrow(run, shape)
