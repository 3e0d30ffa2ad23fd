"""SimHash near-duplicate detection with BK-trees.

Fingerprints are made in vectorised batches and reduced to the distinct ones.  Two fingerprints
that differ in at most two bits agree on one of three parts of their 64 bits, so they meet in at
least one shard keyed by (part, its value).  Each shard builds a BK-tree (children keyed by their
Hamming distance to the parent) and searches it while it grows, following only edges within the
radius.  A shard sends back one link per fingerprint to a local root, which keeps what is
connected connected without listing all pairs.  A shard that is too large for one tree is split
by three parts of its remaining bits, as often as needed; after five splits at most 2^10
different fingerprints can be left in one.

Two bits are few: texts whose shingles agree to 0.8 differ in about one bit of seven, and no parts
of the bits bring such texts together at scale.  ``drop_similar`` therefore takes wider
fingerprints, names its shards by the smallest hashes of a text's shingles (min-hash bands; a text is
in several), follows the edges of each shard's BK-trees within a wide radius, and compares the
shingles of every pair found there, unless other links have brought the two together already.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kinloom.llm._spark import checkpointed, lookup, unused_names
from kinloom.llm._text import appended
from kinloom.operators.components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
MOST_IN_TREE = 256
SPLITS = 5
#: Bytes of words held at a time.
BLOCK = 1 << 20
SPACE = re.compile(rb"[ \t\n\v\f\r]")
#: doc_ids (8 bytes each) are broadcast up to so many.
BROADCAST_DROPPED = 1_000_000

#: Similarity of texts: shingles of so many words, and the least share of common ones among all of both.
WORDS = 5
SIMILARITY = 0.8
#: A text is in BANDS shards, each named by BAND_ROWS smallest hashes: of pairs at 0.8, 0.998 meet in one or more.
BANDS = 12
BAND_ROWS = 4
#: Bits of a wide fingerprint, and how many may differ: at 0.8, 39 differ on average with a deviation of 6.
WIDE = 256
WIDE_RADIUS = 64
#: Members of a shard that one task judges, and the bytes of their shingles' hashes; larger shards are dealt into parts.
MOST_IN_PART = 4096
PART_BYTES = 32 << 20
#: Members of a dealt shard that are in all of its parts: those that are in the most shards.
HUBS = 32
#: A group outgrows the one that is searched apart by this factor before it takes its place.
OUTGROWN = 2


def word_blocks(text: bytes, most: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``most`` bytes, so that a very long text is never a list of all its words."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > most:
            space = SPACE.search(text, at + most)
            end = space.start() if space else end
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the hashes of a lower-case text's shingles; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    total, votes, before = 0, np.zeros(64, np.int64), []
    for found in word_blocks(text):
        words = before + found
        n = len(words) - shingle + 1
        if n > 0:
            # eight million bits at a time
            hashes = np.fromiter((digest(g, seed) for g in map(b" ".join, zip(*(words[i : n + i] for i in range(shingle)), strict=True))), np.uint64)
            for start in range(0, len(hashes), 1 << 17):
                some = hashes[start : start + (1 << 17)]
                votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        before = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and before:
        whole = digest(b" ".join(before), seed)
        return whole
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > total).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, carry: list[str] | None = None, name: str = "fp") -> DataFrame:
    """The columns ``carry`` (doc_id by default) and the fingerprint's 64 bits as a signed long.  Null text has no words, so 0."""

    def made(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        text = data.tobytes().lower()  # of bytes: A-Z alone
        prints = [fingerprint(text[a:b], shingle, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return [np.array(prints, np.uint64).view(np.int64)]

    return appended(docs, ["doc_id"] if carry is None else carry, [T.StructField(name, T.LongType())], made)


def part_masks(splits: int = SPLITS) -> list[dict[int, tuple[int, list[int]]]]:
    """By split: shard kind -> (its parent's kind, three masks that its parts agree on)."""
    out, free = [], {0: (1 << 64) - 1}
    for _ in range(splits):
        level, below = {}, {}
        for kind, mask in free.items():
            bits = [i for i in range(64) if mask >> i & 1]
            thirds = [bits[i::3] for i in range(3)]
            for j, third in enumerate(thirds):
                part = sum(1 << i for i in third)
                level[3 * kind + 1 + j] = (kind, ((1 << 64) - 1) & ~mask | part)
                below[3 * kind + 1 + j] = mask & ~part
        out.append(level)
        free = below
    return out


class BKTree:
    """Nodes are [value, index, children by distance]."""

    def __init__(self):
        self.root: list | None = None

    def near(self, value: int, radius: int) -> list[int]:
        """The indices of the values within the radius."""
        found, visit = [], [self.root] if self.root else []
        while visit:
            node = visit.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append(node[1])
            for edge, child in node[2].items():
                if -radius <= edge - d <= radius:
                    visit.append(child)
        return found

    def insert(self, value: int, index: int) -> None:
        if self.root is None:
            self.root = [value, index, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, index, {}]
                return
            node = child

    def add(self, value: int, index: int, radius: int) -> list[int]:
        """Insert a value; the indices of the earlier values within the radius."""
        near = self.near(value, radius)
        self.insert(value, index)
        return near


def tree_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(value, root) for the values that are linked to a root other than themselves."""
    tree, parent = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.add(value, i, radius):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return ((values[i], values[r]) for i in range(len(values)) if (r := find(i)) != i)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, most: int = MOST_IN_TREE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span all components.

    ``radius`` is 2 at most, which is what three parts can guarantee.
    """
    if radius > 2:
        raise ValueError("three parts guarantee a common one up to radius 2 only")
    shape = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by shard; a shard may go on in the next batch
        shard, held, out = None, [], []
        for batch in batches:
            for kind, value, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, value) != shard:
                    out += tree_links(held, radius) if len(held) > 1 else ()
                    shard, held = (kind, value), []
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([_signed(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        out = list(tree_links(held, radius)) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([_signed(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = None
    rest = prints.select(F.lit(0).alias("kind"), "fp")
    levels = part_masks()
    for k, level in enumerate(levels):
        # a row for each of the three parts of the shard that a fingerprint is in
        parents = F.create_map(*[x for kind in sorted({p for p, _ in level.values()}) for x in (F.lit(kind), F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(_signed(m)).alias("mask")) for c, (p, m) in level.items() if p == kind]))])
        rows = rest.select("fp", F.explode(parents[F.col("kind")]).alias("part")).select("part.kind", F.col("fp").bitwiseAND(F.col("part.mask")).alias("value"), "fp")
        rows = checkpointed(rows.distinct() if k else rows)
        sizes = checkpointed(rows.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1"))
        sized = lookup(rows, sizes, ["kind", "value"], "n", "inner")
        small = sized if k == len(levels) - 1 else sized.where(F.col("n") <= most)
        made = small.select("kind", "value", "fp").repartition("kind", "value").sortWithinPartitions("kind", "value", "fp").mapInArrow(run, shape)
        found = made if found is None else found.unionByName(made)
        if k == len(levels) - 1 or sizes.where(F.col("n") > most).isEmpty():
            break
        rest = sized.where(F.col("n") > most).select("kind", "fp")
    return checkpointed(found)


def _grouped(docs: DataFrame, radius: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, n, component, component_id) of each fingerprint; component is the smallest fp linked."""
    made = checkpointed(fingerprints(docs))
    prints = checkpointed(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    nodes = checkpointed(connected_components(links(prints, radius, most), "a", "b"))
    joined = prints.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    joined = checkpointed(joined)
    least = checkpointed(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    return made, checkpointed(lookup(joined, least, ["component"], "m", "inner").select("fp", "n", "component", "component_id"))


def near_groups(docs: DataFrame, radius: int = RADIUS, most: int = MOST_IN_TREE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, fingerprint, component_id.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach.
    Texts without words (null and empty ones too) have fingerprint 0 and are linked like any
    other.  A null doc_id never names a component, unless all of its rows have none: then it is
    null.  Very long texts are read whole, a block of words at a time.  An empty table gives an
    empty result.  Other columns are not read.
    """
    made, named = _grouped(docs, radius, most)
    out = lookup(made, named, ["fp"], "n", "inner")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, most: int = MOST_IN_TREE) -> DataFrame:
    """One row of each group of linked fingerprints, with all columns as they are, whatever their names.

    The row with the smallest doc_id stays (a null one only if no row of its group has one), of
    several with that doc_id the one with the smallest fingerprint, of several with both any one.
    Null, empty and very long texts are handled as in ``near_groups``; an empty table gives an
    empty result.

    A row whose doc_id occurs once is found again by it.  Only rows that repeat a doc_id, or have
    none, get their fingerprint a second time and are found by both.
    """
    made, named = _grouped(docs.select("doc_id", "text"), radius, most)
    return _one_of_each(docs, made, named, lambda rows, name: fingerprints(rows, carry=docs.columns, name=name))


def _one_of_each(docs: DataFrame, made: DataFrame, named: DataFrame, reprint: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that stay: ``made`` has (doc_id, fp) of each row, ``named`` (fp, n, component) of each fingerprint.

    ``reprint`` adds a row's fingerprint to all its columns under a given name.
    """
    grouped = checkpointed(lookup(made, named, ["fp"], "n", "inner").select("doc_id", "fp", "component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    best = grouped.groupBy("component").agg(first.alias("best")).select("best.doc_id", "best.fp", F.lit(True).alias("stays"))
    ids = grouped.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("fp").alias("fp"))
    judged = checkpointed(ids.join(best.groupBy("doc_id").agg(F.max("stays").alias("stays")), "doc_id", "left"))
    odd = judged.where("rows > 1 or doc_id is null").select("doc_id")
    # the ids that do not simply stay are the few
    away, mine, odd_key = unused_names(docs, "away_", "print_", "odd_")
    others = judged.where("doc_id is not null and (stays is null or rows > 1)").select(F.col("doc_id").alias(away))
    if others.limit(BROADCAST_DROPPED + 1).count() <= BROADCAST_DROPPED:
        others = F.broadcast(others)
    held = docs.where("doc_id is not null").join(others, F.col("doc_id") == F.col(away), "left_anti")
    if odd.isEmpty():
        return held
    again = docs.join(odd.select(F.col("doc_id").alias(odd_key)), F.col("doc_id").eqNullSafe(F.col(odd_key)), "left_semi")
    again = reprint(again, mine)
    wins = best.select(F.col("doc_id").alias(away), F.col("fp").alias(odd_key))
    again = again.join(wins, F.col("doc_id").eqNullSafe(F.col(away)) & (F.col(mine) == F.col(odd_key)), "left_semi")
    return held.unionByName(again.dropDuplicates(["doc_id", mine]).drop(mine))


def shingle_hashes(text: bytes, shingle: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The different hashes of a lower-case text's shingles, in order; the whole sequence if it has fewer words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts, before = [], []
    for found in word_blocks(text):
        words = before + found
        n = len(words) - shingle + 1
        if n > 0:
            parts.append(np.fromiter((digest(g, seed) for g in map(b" ".join, zip(*(words[i : n + i] for i in range(shingle)), strict=True))), np.uint64, n))
        before = words[-(shingle - 1) :] if shingle > 1 else []
    if not parts and before:
        return np.array([digest(b" ".join(before), seed)], np.uint64)
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _constants(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(salt).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over all 64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def wide_print(hashes: np.ndarray) -> bytes:
    """Majority bits over WIDE bits made of each hash; all 0 without hashes."""
    steps, votes = _constants(WIDE // 64, 1), np.zeros(WIDE, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        spread = _mixed(hashes[start : start + (1 << 14), None] + steps)
        votes += np.unpackbits(spread.view(np.uint8).reshape(-1, WIDE // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def shard_names(hashes: np.ndarray) -> np.ndarray:
    """A name for each band: the smallest of all hashes under each of its BAND_ROWS orders, mixed into one number."""
    factors = _constants(BANDS * BAND_ROWS, 2)
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for start in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[start : start + (1 << 12), None] * factors).min(axis=0))
    rows = _mixed(least).reshape(BANDS, BAND_ROWS) * _constants(BAND_ROWS, 3)
    return _mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, carry: list[str], name: str = "fp", extra: str | None = None, shingle: int = WORDS, seed: int = SEED) -> DataFrame:
    """The columns ``carry`` and the wide fingerprint; with ``extra`` also ``keys`` (the shards' names) and ``size`` (how many different shingles), or ``hashes`` (the different shingles')."""
    fields = [T.StructField(name, T.BinaryType())]
    if extra:
        fields.append(T.StructField(extra, T.ArrayType(T.LongType())))
    if extra == "keys":
        fields.append(T.StructField("size", T.LongType()))

    def made(data: np.ndarray, offsets: np.ndarray) -> list[list]:
        text = data.tobytes().lower()  # of bytes: A-Z alone
        out: list[list] = [[] for _ in fields]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            hashes = shingle_hashes(text[a:b], shingle, seed)
            out[0].append(wide_print(hashes))
            if extra:
                out[1].append(shard_names(hashes) if extra == "keys" else hashes.view(np.int64))
            if extra == "keys":
                out[2].append(len(hashes))
        return out

    return appended(docs, carry, fields, made)


class Part:
    """Members of a shard, joined as they are found similar.

    Every pair of members within the radius is compared unless both are in one group by then, so
    the groups in the end are those of all such pairs.  Members of the largest group lie in a tree
    of their own, which a member of that group need not search; whether it is one is asked first
    of the group's best-linked member.  So a crowd around one text costs little more than its number.
    """

    def __init__(self, prints: list[int], sets: list[np.ndarray], radius: int, similarity: float):
        self.prints, self.radius, self.similarity = prints, radius, similarity
        self.sizes = np.array([len(x) for x in sets])
        names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(numbers.astype(np.int32), np.cumsum(self.sizes)[:-1])
        self.marked = np.zeros(len(names), bool)
        self.parent, self.members, self.degree = list(range(len(prints))), [1] * len(prints), [0] * len(prints)
        self.main, self.rest, self.anchor, self.hub = BKTree(), BKTree(), None, None
        self.placed: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[a] = b
            self.members[b] += self.members[a]

    def place(self, i: int) -> None:
        """Put a member where later ones find it."""
        self.placed.append(i)
        group = self.find(i)
        if self.anchor is None or (group != self.find(self.anchor) and self.members[group] > OUTGROWN * self.members[self.find(self.anchor)]):
            self.anchor, self.hub, self.main, self.rest = i, i, BKTree(), BKTree()
            for j in self.placed:
                inside = self.find(j) == group
                (self.main if inside else self.rest).insert(self.prints[j], j)
                if inside and self.degree[j] > self.degree[self.hub]:
                    self.hub = j
        else:
            (self.main if group == self.find(self.anchor) else self.rest).insert(self.prints[i], i)

    def _similar(self, i: int, others: list[int]) -> list[int]:
        """Those of ``others`` that have enough shingles in common with i, whose shingles are marked."""
        sizes = self.sizes[others]
        least, most = np.minimum(sizes, self.sizes[i]), np.maximum(sizes, self.sizes[i])
        likely = np.flatnonzero(least >= self.similarity * most)
        if not len(likely):
            return []
        chosen = [self.ids[others[k]] for k in likely]
        ends = np.cumsum(sizes[likely])
        common = np.add.reduceat(self.marked[np.concatenate(chosen)], ends - sizes[likely], dtype=np.int64) if ends[-1] else np.zeros(len(likely), np.int64)
        return [others[k] for k in likely[common >= self.similarity * (sizes[likely] + self.sizes[i] - common)]]

    def judge(self, i: int) -> None:
        """Link a member to those placed before it that are similar and in other groups."""
        self.marked[self.ids[i]] = True
        apart = lambda: self.anchor is not None and self.find(self.anchor) != self.find(i)
        if apart() and self._similar(i, [self.hub]):
            self._link(i, self.hub)
        near = self.rest.near(self.prints[i], self.radius) + (self.main.near(self.prints[i], self.radius) if apart() else [])
        near = [j for j in near if self.find(j) != self.find(i)]
        for j in self._similar(i, near) if near else ():
            if self.find(j) != self.find(i):
                self._link(i, j)
        self.marked[self.ids[i]] = False

    def _link(self, i: int, j: int) -> None:
        self.join(i, j)
        self.links.append((i, j))
        for k in (i, j):
            self.degree[k] += 1
            if self.hub is not None and self.degree[k] > self.degree[self.hub] and self.find(k) == self.find(self.anchor):
                self.hub = k


def part_links(prints: list[bytes], sets: list[np.ndarray], labels: list[bytes], visits: list[bool], radius: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that span what is similar within the radius.  Members of one label are one group beforehand.

    If some members are visitors, they alone are compared, with the residents.
    """
    part = Part([int.from_bytes(p, "big") for p in prints], sets, radius, similarity)
    first: dict[bytes, int] = {}
    for i, label in enumerate(labels):
        part.join(i, first.setdefault(label, i))
    visiting = any(visits)
    for i, visitor in enumerate(visits):
        if visitor or not visiting:
            part.judge(i)
        if not visitor:
            part.place(i)
    return [(prints[i], prints[j]) for i, j in part.links]


def _part_links(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) found within each (key, part) of ``rows`` (key, part, fp, label, visits, score, hashes)."""
    shape = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part; a part may go on in the next batch
        at, held = None, ([], [], [], [])

        def judged() -> pa.RecordBatch:
            found = part_links(*held, radius, similarity) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            hashes = batch.column(5)
            bounds, every = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            for r, (key, part, fp, label, visits) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if (key, part) != at:
                    yield judged()
                    at, held = (key, part), ([], [], [], [])
                if not held[0] or held[0][-1] != fp:  # rows that repeat a text
                    for column, value in zip(held, (fp, every[bounds[r] : bounds[r + 1]].copy(), label, visits), strict=True):
                        column.append(value)
        yield judged()

    # those in the most shards come first: the middle of a crowd is in more of them than its edge
    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part", "visits", F.desc("score"), "fp")
    return checkpointed(ordered.select("key", "part", "fp", "label", "visits", "hashes").mapInArrow(run, shape))


def _similar_groups(docs: DataFrame, shingle: int, similarity: float, most: int, radius: int = WIDE_RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, n, component) of each wide fingerprint; component is the smallest fp linked."""
    made = checkpointed(sketches(docs, ["doc_id"], extra="keys", shingle=shingle))
    prints = checkpointed(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("keys").alias("keys"), F.max("size").alias("size")))
    rows = prints.select("fp", "size", F.explode("keys").alias("key"))
    met = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1"))
    parts = F.greatest(F.ceil(F.col("n") / most), F.ceil(8 * F.col("shingles") / PART_BYTES)).cast("int")
    shared = checkpointed(lookup(rows, met, ["key"], "n", "inner").select("key", "fp", "n", F.least(parts, F.col("n")).cast("int").alias("parts")))
    score = shared.groupBy("fp").agg(F.count("*").alias("score"))
    dealt = checkpointed(shared.join(score, "fp").withColumn("part", F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int")))

    def with_hashes(some: DataFrame) -> DataFrame:
        """Rows with the hashes of one text of each fingerprint: that of the smallest doc_id."""
        ids = checkpointed(prints.join(some.select("fp").distinct(), "fp", "left_semi").select(F.col("least").alias("one")).distinct())
        if ids.limit(BROADCAST_DROPPED + 1).count() <= BROADCAST_DROPPED:
            ids = F.broadcast(ids)
        texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("one")), "left_semi")
        return some.join(sketches(texts, [], extra="hashes", shingle=shingle), "fp")

    alone = dealt.select("key", "part", "fp", F.col("fp").alias("label"), F.lit(False).alias("visits"), "score")
    split = dealt.where("parts > 1")
    crowded = not split.isEmpty()
    if crowded:
        first = Window.partitionBy("key").orderBy(F.desc("score"), "fp")
        hubs = split.withColumn("place", F.row_number().over(first)).where(F.col("place") <= HUBS)
        others = F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("part"))
        alone = alone.unionByName(hubs.select("key", F.explode(others).alias("part"), "fp", F.col("fp").alias("label"), F.lit(False).alias("visits"), "score"))
    linked = _part_links(with_hashes(alone), radius, similarity)
    nodes = checkpointed(connected_components(linked, "a", "b"))
    if crowded:
        # members of a dealt shard's largest group need not meet each other; all others meet the parts they were not in
        label = nodes.select(F.col("node").alias("fp"), F.col("component").alias("label"))
        named = checkpointed(split.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
        largest = named.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.sum("m").alias("rows"))
        named = checkpointed(lookup(named, checkpointed(largest), ["key"], "rows", "inner"))
        elsewhere = F.explode(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("part")))
        visitors = named.where("label <> largest").select("key", elsewhere.alias("part"), "fp", "label", F.lit(True).alias("visits"), "score")
        if not visitors.isEmpty():
            residents = named.select("key", "part", "fp", "label", F.lit(False).alias("visits"), "score")
            linked = linked.unionByName(_part_links(with_hashes(residents.unionByName(visitors)), radius, similarity))
            nodes = checkpointed(connected_components(linked, "a", "b"))
    named = prints.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"))
    return made.select("doc_id", "fp"), checkpointed(named)


def drop_similar(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, most: int = MOST_IN_PART) -> DataFrame:
    """One row of each group of similar texts, with all columns as they are, whatever their names.

    Two texts are linked if at least ``similarity`` of the different ``shingle``-word shingles of
    both are common (lower case; fewer words: the whole sequence), counted exactly; a group is what
    links reach.  Compared are texts that share a shard and lie within WIDE_RADIUS bits: of pairs at
    0.8 about 2 in 1,000 share no shard, fewer at more.  Within a shard no link is lost, however large
    it is: shards of over ``most`` texts are dealt into parts, each with the shard's HUBS best-known
    texts, and then texts outside of the shard's largest group visit the other parts.  A crowd of
    near copies of one text costs little more than its number; texts in reach of each other that are
    not similar are compared pair by pair in their shard, which grows by the square of their number.

    Which row stays, and null, empty and very long texts, repeated and null doc_ids and an empty
    table, are as in ``drop_near_copies``: texts without words are one group.
    """
    made, named = _similar_groups(docs.select("doc_id", "text"), shingle, similarity, most)
    return _one_of_each(docs, made, named, lambda rows, name: sketches(rows, docs.columns, name, shingle=shingle))
