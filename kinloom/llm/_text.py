"""Vectorised text helpers: a batch of texts is one byte array with offsets, as Arrow keeps it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinloom.llm._spark import quoted

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(batch: pa.RecordBatch, column: int = 0, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``most`` bytes of text and ``rows`` rows (one row at least).

    Yields the rows, the bytes of the text column (given by its place) and n+1 offsets; null counts as empty.
    """
    if not batch.num_rows:
        return
    text = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(text):
        stop = min(start + rows, max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1))
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def appended(docs: DataFrame, carry: list[str], fields: list[T.StructField], compute: Callable[[np.ndarray, np.ndarray], list], rows: int = 1 << 30) -> DataFrame:
    """The columns ``carry`` of ``docs``, whatever their names, and ``fields``, made of the text column's slices.

    ``compute`` gets the bytes and offsets of some whole texts and returns an array per field.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(docs.schema[c] for c in carry), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, rows=rows):
                kept = [part.column(i + 1).cast(arrow.field(i).type) for i in range(len(carry))]
                made = [pa.array(a, arrow.field(len(carry) + i).type) for i, a in enumerate(compute(data, offsets))]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    return docs.select(F.col("text"), *[F.col(quoted(c)) for c in carry]).toDF("t", *[f"c{i}" for i in range(len(carry))]).mapInArrow(run, schema)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the document of each."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_sums(marked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many places are marked in each span; spans are not empty, in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.int64)
    edges = np.column_stack([starts, ends]).ravel()
    return np.add.reduceat(marked.view(np.uint8), edges if edges[-1] < len(marked) else edges[:-1], dtype=np.int64)[::2]


def doc_sums(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many places are marked in each text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(marked.view(np.uint8), offsets[:-1][some], dtype=np.int64)
    return out


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each span, the same for equal bytes alone, and how many numbers there are.

    Spans are in order and do not overlap.  Arrow's dictionary compares bytes, so no hash decides.
    """
    if not len(starts):
        return np.zeros(0, np.int64), 0
    edges = np.column_stack([starts, ends]).ravel().astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    # every other value is what lies between two spans
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy()[::2].astype(np.int64), len(coded.dictionary)


def per_doc(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each of n documents."""
    return np.bincount(docs, weights=values, minlength=n)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines (empty ones too) and the document of each."""
    cuts = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([offsets[:-1], cuts + 1])
    docs = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, "right") - 1])
    order = np.lexsort((starts, docs))
    starts, docs = starts[order], docs[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(docs[1:] == docs[:-1], starts[1:] - 1, offsets[docs[:-1] + 1])
    ends[-1:] = offsets[-1]
    return starts, ends, docs
