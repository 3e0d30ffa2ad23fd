"""Word pointers over a slice of texts as Arrow keeps it: starts and ends of words in one byte array.

Words are runs of bytes of a class.  Every byte of a character beyond ASCII belongs to the class, so
what is said of characters holds for bytes.  Texts are read in slices of whole texts; a text that is
longer than a slice is read in blocks that overlap by a few words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of a long text that are held as pointers at a time.
BLOCK = 4 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the ranges (both ends included) and for every byte beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[0x80:] = True
    for a, b in ranges:
        inside[a : b + 1] = True
    return inside


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z were lower-cased.
LETTERS_AND_DIGITS = byte_class((0x30, 0x39), (0x61, 0x7A))
#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` after A-Z were lower-cased.
LETTERS = byte_class((0x61, 0x7A))
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def pointers(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the text of each."""
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word never goes on in the next text
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, the same for equal bytes alone, and the words by number (some numbers are unused)."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    edges = np.column_stack([starts, ends]).ravel().astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    # every other span is what lies between two words
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy()[::2].astype(np.int64), coded.dictionary


@dataclass
class Piece:
    """Words of some whole texts, or of one block of a long text, which begins at byte ``base``.

    ``doc`` is a word's text, ``number`` its number within that text, ``begin`` and ``end`` the
    pointers between which its text's words lie in this piece.  Words outside of ``own`` belong to
    a neighbouring block and are there for what reaches over its edge.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    number: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    own: slice
    base: int = 0


def _piece(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Piece:
    starts, ends, doc = pointers(data, offsets, inside)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    begin, end = bounds[:-1][doc], bounds[1:][doc]
    return Piece(data, starts, ends, doc, np.arange(len(starts)) - begin, begin, end, slice(0, len(starts)))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay, those of characters beyond ASCII too."""
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def pieces(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, before: int = 0, after: int = 0, most: int = BLOCK) -> Iterator[Piece]:
    """The words of a slice's texts; of one long text in blocks with ``before`` and ``after`` more words at their edges."""
    if len(offsets) != 2 or len(data) <= most:
        yield _piece(data, offsets, inside)
        return
    gaps = lambda at: _first_outside(data, at, inside)
    at, first, skipped, kept = 0, 0, 0, 0
    while True:
        # words from `kept` on are read again for what reaches over the edge
        end = gaps(at + most) if at + most < len(data) else len(data)
        part = data[kept:end]
        piece = _piece(part, np.array([0, len(part)]), inside)
        n = len(piece.starts)
        stop = n if end >= len(data) else max(skipped, n - after)
        piece.number = piece.number + (first - skipped)
        piece.own, piece.base = slice(skipped, stop), kept
        yield piece
        if end >= len(data):
            return
        again = max(0, stop - before)
        first += stop - skipped
        kept, skipped, at = kept + (int(piece.starts[again]) if again < n else len(part)), stop - again, end


def _first_outside(data: np.ndarray, at: int, inside: np.ndarray, step: int = 1 << 16) -> int:
    """The first place from ``at`` on that belongs to no word."""
    while at < len(data):
        found = np.flatnonzero(~inside[data[at : at + step]])
        if len(found):
            return at + int(found[0])
        at += step
    return len(data)
