"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of byte pieces has one probability per piece and language.  A text's
probability is the sum over all ways to cut the whole text into pieces, which a forward pass in
logarithms adds up.  Probabilities are learned by expectation-maximisation (forward-backward over
a bounded sample of documents).

Two neighbouring bytes that no piece has side by side are in different pieces in every way to cut
the text.  A text falls apart at these places into stretches (mostly words with their leading
space), and its sum is the product of theirs, without any loss.  Stretches repeat so often that
each task keeps the scores of those it has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinloom.llm._spark import checkpointed, held_out
from kinloom.llm._text import slices, span_names

LEARN_FROM = 12_000
ROUNDS = 3
#: Longer stretches are passed over this many bytes at a time (memory, not results).
BLOCK = 2048
#: A task forgets the stretches it has met beyond so many (memory, not results).
REMEMBER = 300_000
UNKNOWN = "und"
SMOOTH = 0.5
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """All pieces of the vocabulary in a trie, kept as sorted arrays: state * 256 + byte -> next state."""

    def __init__(self, path: str):
        import base64

        with open(path, "rb") as f:
            self.tokens = sorted(base64.b64decode(line.split()[0]) for line in f)
        self.longest = max(map(len, self.tokens))
        states: dict[bytes, int] = {b"": 0}
        ends: list[int] = [-1]
        edges: list[tuple[int, int]] = []
        self.beside = np.zeros((256, 256), bool)
        for number, token in enumerate(self.tokens):
            for i in range(len(token)):
                if token[: i + 1] not in states:
                    states[token[: i + 1]] = len(states)
                    ends.append(-1)
                    edges.append((states[token[:i]] << 8 | token[i], len(states) - 1))
                if i:
                    self.beside[token[i - 1], token[i]] = True
            ends[states[token]] = number
        edges.sort()
        self.edge, self.next = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        self.ends = np.array(ends, np.int32)

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches of all texts; together they are all bytes."""
        cut = np.ones(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = ~self.beside[data[:-1], data[1:]]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    def found(self, codes: np.ndarray) -> np.ndarray:
        """(row, end, length - 1) -> the number of the piece that ends there, or -1, for rows of equal length."""
        n, size = codes.shape
        out = np.full((n, size + 1, min(size, self.longest)), -1, np.int32)
        row, start = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(size), indexing="ij"))
        state = np.zeros(len(row), np.int64)
        for depth in range(min(size, self.longest)):
            inside = start + depth < size
            row, start, state = row[inside], start[inside], state[inside]
            key = state << 8 | codes[row, start + depth]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            alive = self.edge[at] == key
            row, start, state = row[alive], start[alive], self.next[at[alive]]
            if not len(row):
                break
            out[row, start + depth + 1, depth] = self.ends[state]
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _sum_logs(terms: list[tuple[np.ndarray, np.ndarray]], n: int, width: int) -> np.ndarray:
    """log(sum(exp)) per row of (rows, values) terms, in each of which a row occurs once at most."""
    top = np.full((n, width), -np.inf)
    for rows, values in terms:
        top[rows] = np.maximum(top[rows], values)
    total = np.zeros((n, width))
    shift = np.where(np.isneginf(top), 0.0, top)
    for rows, values in terms:
        total[rows] += np.exp(values - shift[rows])
    with np.errstate(divide="ignore"):
        return shift + np.log(total)


def _hits(found: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """By end: (length, rows, pieces) of the pieces that end there."""
    out: list[list] = [[] for _ in range(found.shape[1])]
    for end, k in np.argwhere((found >= 0).any(axis=0)).tolist():
        rows = np.flatnonzero(found[:, end, k] >= 0)
        out[end].append((k + 1, rows, found[rows, end, k]))
    return out


def forward(hits: list, n: int, logs: np.ndarray) -> np.ndarray:
    """(row, end, language): log of the summed probability of all segmentations of each row's first ``end`` bytes."""
    out = np.full((n, len(hits), logs.shape[1]), -np.inf)
    out[:, 0] = 0.0
    for end in range(1, len(hits)):
        out[:, end] = _sum_logs([(rows, out[rows, end - length] + logs[piece]) for length, rows, piece in hits[end]], n, logs.shape[1])
    return out


def long_score(vocabulary: Pieces, text: bytes, logs: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The score of one long stretch; memory holds ``block`` ends and those that their pieces begin at."""
    codes, reach = np.frombuffer(text, np.uint8), vocabulary.longest
    tail, at = np.zeros((1, logs.shape[1])), 0
    while at < len(codes):
        stop = min(len(codes), at + block)
        first = at - (len(tail) - 1)
        found = vocabulary.found(codes[None, first:stop])[0]
        ends, lengths = np.nonzero(found >= 0)
        p, groups = logs[found[ends, lengths]], np.searchsorted(ends, np.arange(len(found) + 1))
        out = np.concatenate([tail, np.zeros((stop - at, logs.shape[1]))])
        for end in range(len(tail), len(out)):
            some = slice(groups[end], groups[end + 1])
            values = out[end - 1 - lengths[some]] + p[some]
            top = values.max(axis=0)
            out[end] = top + np.log(np.exp(values - top).sum(axis=0))
        tail, at = out[-(reach + 1) :], stop
    return tail[-1]


def log_scores(vocabulary: Pieces, texts: list[bytes], logs: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """(stretch, language): log of the summed probability of all segmentations of each stretch."""
    out = np.zeros((len(texts), logs.shape[1]))
    short = [i for i, t in enumerate(texts) if len(t) <= block]
    for batch in by_length([texts[i] for i in short]):
        places = [short[i] for i in batch]
        codes = np.frombuffer(b"".join(texts[i] for i in places), np.uint8).reshape(len(places), -1)
        out[places] = forward(_hits(vocabulary.found(codes)), len(places), logs)[:, -1]
    for i, t in enumerate(texts):
        if len(t) > block:
            out[i] = long_score(vocabulary, t, logs, block)
    return out


def by_length(texts: list[bytes], cells: int = 400_000) -> Iterator[list[int]]:
    """Places of stretches of equal length (none is empty), in batches of bounded memory."""
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(len(t), []).append(i)
    for size, places in groups.items():
        step = max(1, cells // (size * min(size, 128)))
        for i in range(0, len(places), step):
            yield places[i : i + step]


def expected_counts(vocabulary: Pieces, texts: list[bytes], weight: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """(piece): expected uses over all segmentations of the stretches, for one language (logs has one column)."""
    out = np.zeros(len(vocabulary.tokens))
    for batch in by_length(texts):
        codes = np.frombuffer(b"".join(texts[i] for i in batch), np.uint8).reshape(len(batch), -1)
        hits = _hits(vocabulary.found(codes))
        before = forward(hits, len(batch), logs)[:, :, 0]
        n, ends = before.shape
        waiting: list[list] = [[] for _ in range(ends)]
        after = np.full((n, ends), -np.inf)
        after[:, -1] = 0.0
        for end in range(ends - 1, 0, -1):
            if waiting[end]:
                after[:, end] = _sum_logs(waiting[end], n, 1)[:, 0]
            for length, rows, piece in hits[end]:
                p = logs[piece, 0]
                out += np.bincount(piece, weights=weight[batch][rows] * np.exp(before[rows, end - length] + p + after[rows, end] - before[rows, -1]), minlength=len(out))
                waiting[end - length].append((rows, (p + after[rows, end])[:, None]))
    return out


class Model:
    """languages, and probability as (piece, language)."""

    def __init__(self, languages: list[str], probability: np.ndarray, path: str):
        self.languages, self.probability, self.path = languages, probability, path


def fit(docs: DataFrame, learn_from: int = LEARN_FROM, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Learn from about ``learn_from`` documents with a lang that are not held out (picked by a hash of the id)."""
    path = path or vocabulary_path()
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    n = usable.count()
    if n > learn_from:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < 1_000_000 * learn_from // n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            for part, data, offsets in slices(batch):
                starts, ends = vocabulary.stretches(data, offsets)
                if not len(starts):
                    continue
                # learning, not scoring, takes very long stretches in blocks
                more = [np.arange(starts[i] + BLOCK, ends[i], BLOCK) for i in np.flatnonzero(ends - starts > BLOCK)]
                edges = np.unique(np.concatenate([starts, ends, *more]))
                starts, ends = edges[:-1], edges[1:]
                names, size = span_names(data, starts, ends)
                lang = part.column(1).dictionary_encode()
                doc = np.searchsorted(offsets, starts, "right") - 1
                keys, first, times = np.unique(lang.indices.to_numpy()[doc].astype(np.int64) * size + names, return_index=True, return_counts=True)
                text = data.tobytes()
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(keys // size)), pa.array([text[starts[i] : ends[i]] for i in first], pa.binary()), pa.array(times)], names=["lang", "word", "n"])

    words = checkpointed(usable.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(12, "lang", "word"))
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    size = len(pieces(path).tokens)
    probability = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds if languages else 0):

        def expect(batches: Iterator[pa.RecordBatch], p: np.ndarray = probability) -> Iterator[pa.RecordBatch]:
            vocabulary, sums = pieces(path), np.zeros((len(languages), p.shape[0]))
            for batch in batches:
                lang, word, n = (np.array(batch.column(k).to_pylist(), dtype=object) for k in range(3))
                for j, name in enumerate(languages):
                    own = np.flatnonzero(lang == name)
                    if len(own):
                        sums[j] += expected_counts(vocabulary, word[own].tolist(), n[own].astype(float), np.log(p[:, j : j + 1]))
            j, piece = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[j, piece])], names=["lang", "piece", "n"])

        # one number per language and piece of the fixed vocabulary: a bounded result
        table = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full((size, len(languages)), SMOOTH)
        np.add.at(counts, (table["piece"].to_numpy(), table["lang"].to_numpy()), table["n"].to_numpy())
        probability = counts / counts.sum(axis=0)
    return Model(languages, probability, path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text).

    score is the posterior of lang_pred over the learned languages with equal priors.  A null text
    or one without a letter is ``und`` with score 0, and so is every text if nothing was learned.
    A tie goes to the first language by name.  Texts of any length and script are scored whole.
    Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    languages, path = model.languages, model.path
    shared = docs.sparkSession.sparkContext.broadcast(model.probability.astype(np.float32))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, logs = pieces(path), np.log(shared.value.astype(np.float64))
        known: dict[bytes, int] = {}
        table = np.zeros((0, len(languages)), np.float32)
        for batch in batches:
            for part, data, offsets in slices(batch):
                starts, ends = vocabulary.stretches(data, offsets)
                names, size = span_names(data, starts, ends)
                if len(known) > REMEMBER:
                    known, table = {}, table[:0]
                first = np.full(size, -1)
                first[names[::-1]] = np.arange(len(names))[::-1]
                used = np.flatnonzero(first >= 0)
                texts = [data[starts[i] : ends[i]].tobytes() for i in first[used].tolist()]
                new = [t for t in texts if t not in known]
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    table = np.concatenate([table, log_scores(vocabulary, new, logs).astype(np.float32)])
                at = np.zeros(size, np.int64)
                at[used] = [known[t] for t in texts]
                # texts are not empty here: they hold a letter
                sums = np.add.reduceat(table[at[names]].astype(np.float64), np.searchsorted(starts, offsets[:-1]), axis=0)
                best = sums.argmax(axis=1)
                share = np.exp(sums - sums.max(axis=1, keepdims=True))
                score = 1.0 / share.sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([languages[i] for i in best], pa.string()), pa.array(score)], names=["doc_id", "pred", "score"])

    letters = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    has = letters.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, schema) if languages else None
    none = letters.where(~F.col("text").rlike(r"\p{L}")) if languages else letters
    out = none.select("doc_id", F.lit(UNKNOWN).alias("pred"), F.lit(0.0).alias("score"))
    out = out if has is None else has.unionByName(out)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("pred").alias("lang_pred"), "score")
