"""Statistics of whole texts, counted in vectorised batches; used by the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from kinloom.llm._text import SLICE_BYTES, SPACE, appended, doc_sums, lines, per_doc, span_names, span_sums, words

SYMBOLS = b"#*$%&|<>"
GRAM = 8
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_lower", "n_digits",
    "n_bars", "n_bangs", "n_stops", "n_short_words", "n_letter_words", "n_ended_lines", "n_repeat_once", "longest_word", "n_letters",
]


def _marks(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


SYMBOL, STOP = _marks(SYMBOLS), _marks(b".,;:?")
UPPER, LOWER, DIGIT = _marks(bytes(range(0x41, 0x5B))), _marks(bytes(range(0x61, 0x7B))), _marks(bytes(range(0x30, 0x3A)))
LETTER = UPPER | LOWER | (np.arange(256) >= 0xC3)
END = _marks(b".!?")
NEW_LINE = _marks(b"\n")
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def _later_copies(keys: np.ndarray) -> np.ndarray:
    """True where a value equals an earlier one."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    same = keys[order][1:] == keys[order][:-1]
    again[order[1:][same]] = True
    return again


def _same_words(names: np.ndarray, places: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
    """Those of ``places`` whose GRAM words from there on are found from another one of them on, compared by all words."""
    columns = np.column_stack([*([] if doc is None else [doc[places]]), *(names[places + k] for k in range(GRAM))])
    _, inverse, times = np.unique(columns, axis=0, return_inverse=True, return_counts=True)
    return places[times[inverse.ravel()] > 1]


def _repeated_windows(names: np.ndarray, count: int, doc: np.ndarray) -> np.ndarray:
    """The places whose GRAM words from there on occur twice or more in their text, the first time included.

    Windows are sorted by a hash and then compared word by word with the one before them, so equal
    hashes of different windows cost time and count for nothing.
    """
    places = np.arange(len(names) - GRAM + 1)
    places = places[doc[places] == doc[places + GRAM - 1]]
    if not len(places):
        return places
    chance = np.random.default_rng(0)
    luck = chance.integers(0, 1 << 64, count, np.uint64)[names]
    factors = chance.integers(0, 1 << 63, GRAM + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = doc[places].astype(np.uint64) * factors[GRAM]
    for k in range(GRAM):
        hashes += luck[places + k] * factors[k]
    order = np.argsort(hashes, kind="stable")
    alike = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    a, b = places[order[alike]], places[order[alike + 1]]
    equal = doc[a] == doc[b]
    for k in range(GRAM):
        equal &= names[a + k] == names[b + k]
    # where different windows have one hash, all their words are compared
    return np.union1d(a, b) if equal.all() else _same_words(names, np.union1d(a, b), doc)


def _marked_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The counts that are sums over words and characters (longest_word: a largest value), and the words."""
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    first = FIRST_BYTE[data]
    in_word = span_sums(first, starts, ends)
    n_chars = doc_sums(first, offsets)
    del first
    marked = lambda table: doc_sums(table[data], offsets)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, in_word)
    return {
        "n_words": np.bincount(doc, minlength=n), "word_chars": per_doc(in_word, doc, n), "n_symbols": marked(SYMBOL), "n_chars": n_chars,
        "n_upper": marked(UPPER), "n_lower": marked(LOWER), "n_digits": marked(DIGIT), "n_bars": doc_sums(data == 0x7C, offsets), "n_bangs": doc_sums(data == 0x21, offsets),
        "n_stops": marked(STOP), "n_short_words": per_doc(in_word <= 3, doc, n), "n_letter_words": per_doc(span_sums(LETTER[data], starts, ends) > 0, doc, n),
        "longest_word": longest, "n_letters": marked(LETTER),
    }, (starts, ends, doc)


def text_counts(data: np.ndarray, offsets: np.ndarray, block: int = SLICE_BYTES) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text.  Lines, words and windows are equal if their bytes are.

    One text of more than two blocks is counted block by block.
    """
    n = len(offsets) - 1
    if n == 1 and len(data) > 2 * block:
        return {c: np.array([v]) for c, v in _long_counts(data, block).items()}
    counts, (starts, ends, doc) = _marked_counts(data, offsets)
    line_start, line_end, line_doc = lines(data, offsets)
    words_before = np.searchsorted(starts, line_end)
    filled = words_before > np.searchsorted(starts, line_start)
    ls, le, ld = line_start[filled], line_end[filled], line_doc[filled]
    line_names, line_count = span_names(data, ls, le)
    copies = _later_copies(ld * line_count + line_names)
    # the last word's last byte tells how a line ends
    last = ends[words_before[filled] - 1] - 1

    names, count = span_names(data, starts, ends)
    hit = _repeated_windows(names, count, doc)
    covered = np.zeros(len(starts), bool)
    if len(hit):
        # a place is covered if the nearest hit at or before it is less than a window away
        nearest = np.searchsorted(hit, np.arange(len(starts)), "right") - 1
        covered = (nearest >= 0) & (np.arange(len(starts)) - hit[np.maximum(nearest, 0)] < GRAM)
    once = _later_copies(doc * count + names)
    return counts | {
        "n_dup_lines": per_doc(copies, ld, n), "n_repeat_words": per_doc(covered, doc, n), "n_lines": np.bincount(ld, minlength=n),
        "n_ended_lines": per_doc(END[data[last]], ld, n), "n_repeat_once": per_doc(once, doc, n),
    }


def _blocks(data: np.ndarray, breaks: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """``data`` cut before bytes that are marked in ``breaks``, each piece as short as that allows from ``block`` bytes on."""
    at = 0
    while at < len(data):
        stop = min(at + block, len(data))
        while stop < len(data):
            found = np.flatnonzero(breaks[data[stop : stop + block]])
            if len(found):
                stop += int(found[0])
                break
            stop = min(stop + block, len(data))
        yield data[at:stop]
        at = stop


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as every other value, from the first on, of an Arrow array over the same bytes (a text is below 2 GB)."""
    edges = np.empty(2 * len(starts), np.int32)
    edges[::2], edges[1::2] = starts, ends
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _names(blocks: Iterator[pa.Array]) -> tuple[np.ndarray, int]:
    """A number for each span of all blocks, the same for equal bytes alone, and how many different spans there are."""
    own, contents = [], []
    for spans in blocks:
        coded = spans.dictionary_encode()
        own.append(coded.indices.to_numpy()[::2].copy())
        contents.append(coded.dictionary)
    if not own:
        return np.zeros(0, np.int32), 0
    # the blocks' contents are numbered again, all together
    coded = pa.chunked_array(contents).dictionary_encode()
    contents.clear()
    used = np.zeros(len(coded.chunk(0).dictionary), bool)
    for i, chunk in enumerate(coded.chunks):
        own[i] = chunk.indices.to_numpy()[own[i]]
        used[own[i]] = True
    return np.concatenate(own), int(used.sum())


def _window_hashes(names: np.ndarray) -> np.ndarray:
    """A hash for every GRAM names side by side."""
    mixed = (names.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(27)
    h = np.zeros(len(names) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x94D049BB133111EB) + mixed[k : k + len(h)]
    return h ^ (h >> np.uint64(29))


def _covered_words(names: np.ndarray, step: int, hashed=_window_hashes) -> int:
    """How many words lie in windows that occur twice or more in the one text ``names``.

    Windows are dealt into classes by their hash, of about four ``step`` each; a class's hashes are
    sorted, and a window whose hash is there twice is compared word by word with the first one of that hash.
    """
    total = len(names) - GRAM + 1
    if total < 2:
        return 0
    classes = np.uint64(-(-total // (4 * step)))
    covered = np.zeros(len(names), bool)

    def parts(c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, total, step):
            h = hashed(names[at : min(at + step, total) + GRAM - 1])
            mine = np.flatnonzero(h % classes == np.uint64(c))
            yield mine + at, h[mine]

    for c in range(int(classes)):
        # a hash that is twice in a part is kept twice
        held = np.sort(np.concatenate([np.concatenate([u, u[n > 1]]) for u, n in (np.unique(h, return_counts=True) for _, h in parts(c))]))
        again = np.unique(held[1:][held[1:] == held[:-1]])
        del held
        if not len(again):
            continue
        first = np.full(len(again), -1, np.int64)
        mixed_up = np.zeros(len(again), bool)
        for only_look in (True, False):
            for places, h in parts(c):
                slot = np.minimum(np.searchsorted(again, h), len(again) - 1)
                some = again[slot] == h
                places, slot = places[some], slot[some]
                if only_look:
                    new = first[slot] < 0
                    # the last write wins, so places are written from the last to the first
                    first[slot[new][::-1]] = places[new][::-1]
                    for k in range(GRAM):
                        mixed_up[slot[names[places + k] != names[first[slot] + k]]] = True
                    continue
                sure = places[~mixed_up[slot]]
                for k in range(GRAM):
                    covered[sure + k] = True
        if mixed_up.any():
            doubtful = np.concatenate([p[np.isin(h, again[mixed_up])] for p, h in parts(c)])
            found = _same_words(names, doubtful)
            for k in range(GRAM):
                covered[found + k] = True
    return int(covered.sum())


def _long_counts(data: np.ndarray, block: int) -> dict[str, int]:
    """The counts of one text, in blocks that end between words (for lines: between lines).

    Of the whole text there are kept a number of four bytes for each word (then for each line), the
    different ones of each block, and a mark for each word.
    """
    sums = dict.fromkeys(COUNTS, 0)

    def word_spans() -> Iterator[pa.Array]:
        for part in _blocks(data, SPACE, block):
            counts, (starts, ends, _) = _marked_counts(part, np.array([0, len(part)]))
            for c, v in counts.items():
                sums[c] = max(sums[c], int(v[0])) if c == "longest_word" else sums[c] + int(v[0])
            if len(starts):
                yield _spans(part, starts, ends)

    def line_spans() -> Iterator[pa.Array]:
        for at, part in enumerate(_blocks(data, NEW_LINE, block)):
            # a block after the first one begins with the line feed that ends the line before
            part = part[1:] if at else part
            if not len(part):
                continue
            starts, ends, _ = lines(part, np.array([0, len(part)]))
            word_starts, word_ends, _ = words(part, np.array([0, len(part)]))
            before = np.searchsorted(word_starts, ends)
            filled = before > np.searchsorted(word_starts, starts)
            sums["n_ended_lines"] += int(END[part[word_ends[before[filled] - 1] - 1]].sum())
            if filled.any():
                yield _spans(part, starts[filled], ends[filled])

    names, different = _names(word_spans())
    sums["n_repeat_once"] = len(names) - different
    sums["n_repeat_words"] = _covered_words(names, max(block // 2, 1))
    del names
    names, different = _names(line_spans())
    sums["n_lines"], sums["n_dup_lines"] = len(names), len(names) - different
    return sums


def with_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` and the counts of the whole text (long); null text counts as empty."""

    def counted(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        counts = text_counts(data, offsets)
        return [counts[c].astype(np.int64) for c in COUNTS]

    return appended(docs, carry, [T.StructField(c, T.LongType()) for c in COUNTS], counted)
