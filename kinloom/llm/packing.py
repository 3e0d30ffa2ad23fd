"""Bounded-space online packing of token sequences.

Each task keeps a fixed number of open windows.  A document's full windows are cut off as they
are; its tail goes best-fit into the open window with the least room that still holds it.  When
none does and no window is free, the fullest is topped up by a cut of the tail and emitted.  What
is open when a task ends is merged: first within the task, then across tasks by a tree of
bounded groups.  The very last, partly filled window is cut into sequences whose lengths are
powers of two, so nothing has to be padded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from kinloom.llm._spark import checkpointed
from kinloom.llm._text import slices

WINDOW = 2048
OPEN = 32
#: Tasks whose leftovers (less than one window each) are merged by one task of the next round.
FAN_IN = 256
END = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's added token, as its ``tokenizers`` file names it.
SPECIAL_TOKENS: Mapping[str, int] = {"<|endoftext|>": 50256}
#: White space as the splitting pattern's \s has it; Python's own has four control characters more.
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Runs of white space that are cut out where the pattern's backtracking fails (600,000 passed, 1,000,000 failed).
LONG_SPACES = 100_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, object] = {}


def encoder(path: str, pattern: str | None = None):
    """The byte-pair encoder of a rank file; special tokens' strings are ordinary text."""
    key = f"{path}\n{pattern}"
    if key not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def text_encoder(path: str, special_tokens: Mapping[str, int] | None = None) -> Callable[[str], np.ndarray]:
    """Text to ids, whatever the text; the strings of ``special_tokens`` stand for their ids."""
    special = special_tokens or {}
    plain = encoder(path).encode_to_numpy
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def ordinary(text: str) -> np.ndarray:
        try:
            return plain(text)
        except ValueError:  # the pattern's backtracking over a very long run of white space
            return np.concatenate(list(around_spaces(text)))

    def around_spaces(text: str) -> Iterator[np.ndarray]:
        whole = encoder(path, r"(?s:.+)").encode_to_numpy  # no splitting
        at = 0
        for run in SPACES.finditer(text):
            if run.end() - run.start() >= LONG_SPACES:
                # the pattern leaves the last one to what follows
                end = run.end() - (run.end() < len(text))
                yield plain(text[at : run.start()])
                yield whole(text[run.start() : end])
                at = end
        yield plain(text[at:])

    def encode(text: str) -> np.ndarray:
        if not any(token in text for token in special):
            return ordinary(text)
        return np.concatenate([np.array([special[part]], np.uint32) if k % 2 else ordinary(part) for k, part in enumerate(cut.split(text))])

    return encode


class Packer:
    """Open windows of one task.  A piece is (row of attributes, start, ids); done sequences are lists of pieces."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open = window, most_open
        self.open: list[list] = []  # of [filled, pieces]

    def add(self, what: tuple, start: int, ids: np.ndarray) -> Iterator[list]:
        while len(ids) >= self.window:
            yield [(what, start, ids[: self.window])]
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        fitting = [w for w in self.open if w[0] + len(ids) <= self.window]
        if fitting:
            best = max(fitting, key=lambda w: w[0])
        elif len(self.open) < self.most_open:
            best = [0, []]
            self.open.append(best)
        else:
            best = max(self.open, key=lambda w: w[0])
            room = self.window - best[0]
            best[1].append((what, start, ids[:room]))
            self.open.remove(best)
            yield best[1]
            yield from self.add(what, start + room, ids[room:])
            return
        best[0] += len(ids)
        best[1].append((what, start, ids))
        if best[0] == self.window:
            self.open.remove(best)
            yield best[1]

    def merge(self) -> Iterator[list]:
        """Fill the fullest windows from the emptiest; less than one window stays open."""
        self.open.sort(key=lambda w: w[0])
        while len(self.open) > 1:
            target = self.open.pop()
            while target[0] < self.window and self.open:
                source = self.open[0]
                what, start, ids = source[1].pop()
                room = self.window - target[0]
                target[1].append((what, start, ids[:room]))
                target[0] += len(ids[:room])
                source[0] -= len(ids[:room])
                if len(ids) > room:
                    source[1].append((what, start + room, ids[room:]))
                if not source[1]:
                    self.open.pop(0)
            if target[0] == self.window:
                yield target[1]
            else:
                self.open.append(target)


def _rows(sequences: list[tuple[int, list]], open_: bool, schema: pa.Schema) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in schema]
    for sequence, pieces in sequences:
        offset = 0
        for what, start, ids in pieces:
            for column, value in zip(columns, (*what, start, len(ids), ids.tobytes(), sequence, offset, open_), strict=True):
                column.append(value)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(doc_id: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("doc_id", doc_id), *(T.StructField(n, long) for n in ("doc_tokens", "start", "length")), T.StructField("ids", T.BinaryType()), T.StructField("sequence_id", long), T.StructField("offset", long), T.StructField("open", T.BooleanType())])


def pack(docs: DataFrame, window: int = WINDOW, most_open: int = OPEN, vocabulary: str | None = None, fan_in: int = FAN_IN, special_tokens: Mapping[str, int] = SPECIAL_TOKENS) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``window`` tokens.

    Returns one row per piece: doc_id, doc_tokens, start, length, ids (unsigned 32-bit, little
    endian), sequence_id, offset.  A document is its text's ids and then id 1; null text counts
    as empty, so it has id 1 alone.  The strings of ``special_tokens`` are one id each wherever they
    stand in a text, as ``tokenizers`` has it by default; with none given they are ordinary text.
    Texts of any length are encoded whole.  Rows that repeat a doc_id are packed as documents of
    their own.  An empty table gives an empty result.  Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    path, special = vocabulary or vocabulary_path(), dict(special_tokens)
    schema = _schema(docs.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = text_encoder(path, special), Packer(window, most_open)
        task = TaskContext.get().partitionId()
        sequence = (task << 32) + 1
        for batch in batches:
            for part, _, _ in slices(batch):
                done = []
                for text, doc_id in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or "").astype("<u4"), np.array([END], "<u4"))
                    for pieces in packer.add((doc_id, len(ids)), 0, ids):
                        done.append((sequence, pieces))
                        sequence += 1
                # open pieces must not keep their documents' whole id arrays alive
                for w in packer.open:
                    w[1] = [(what, start, ids if ids.base is None else ids.copy()) for what, start, ids in w[1]]
                yield _rows(done, False, arrow)
        done = list(enumerate(packer.merge(), sequence))
        yield _rows(done, False, arrow)
        yield _rows([(task << 32, w[1]) for w in packer.open], True, arrow)

    pieces = checkpointed(docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").mapInArrow(local, schema))
    result = pieces.where("not open").drop("open")
    left = pieces.where("open")
    # the leftovers' tasks, in bounded groups, until one group is left
    tasks = left.agg(F.max("sequence_id")).first()[0]
    groups, level = (0 if tasks is None else (tasks >> 32) + 1), 0
    while groups:
        groups, level, last = -(-groups // fan_in), level + 1, groups <= fan_in
        merged = _merged(left, window, most_open, fan_in, level, last, schema)
        merged = merged if last else checkpointed(merged)
        result = result.unionByName(merged.where("not open").drop("open"))
        left = merged.where("open")
        groups = 0 if last else groups
    return result


def _merged(left: DataFrame, window: int, most_open: int, fan_in: int, level: int, last: bool, schema: T.StructType) -> DataFrame:
    """One round of merging: a task gets the leftovers of ``fan_in`` tasks, less than a window each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        packer, group = Packer(window, most_open), key[0].as_py()
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        done: list[list] = []
        for row in table.select(["doc_id", "doc_tokens", "start", "ids"]).to_pylist():
            done += packer.add((row["doc_id"], row["doc_tokens"]), row["start"], np.frombuffer(row["ids"], "<u4"))
        done += packer.merge()
        opened = [w[1] for w in packer.open]
        if last:
            done, opened = done + [piece for pieces in opened for piece in powers_of_two(pieces)], []
        # a round's own range of ids, above all tasks' ids
        base = (level << 58) + (group << 32)
        made = [_rows(list(enumerate(done, base + 1)), False, arrow), _rows([(group << 32, w) for w in opened], True, arrow)]
        return pa.Table.from_batches(made, arrow)

    keyed = left.withColumn("group_", F.floor(F.shiftright("sequence_id", 32) / fan_in))
    return keyed.groupBy("group_").applyInArrow(merge, schema)


def powers_of_two(pieces: list) -> Iterator[list]:
    """Cut the pieces of one sequence into sequences whose lengths are its length's binary digits."""
    total = sum(len(ids) for _, _, ids in pieces)
    queue = list(pieces)
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        out, want = [], size
        while want:
            what, start, ids = queue.pop(0)
            out.append((what, start, ids[:want]))
            if len(ids) > want:
                queue.insert(0, (what, start + want, ids[want:]))
            want -= len(out[-1][2])
        yield out
