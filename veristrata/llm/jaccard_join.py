"""N-gram Jaccard join with prefix trees.

A document's set is its distinct word n-grams, as 64-bit hashes, in one global
order: by hash, with the most frequent ones last. Two sets whose Jaccard
similarity reaches num/den share a path of two elements, which follow each
other in both, within prefixes of a known length; so sets that share such a
path meet in its block. In a block, the ordered sets form a prefix tree. A probe
walks it once, level by level: sets that share a prefix share the overlap counted
so far, and a subtree is left as soon as the elements that remain cannot make up
the overlap needed. All links are exact.

Copies (equal sets) are one class. Paths with the same least class among those
that meet there are one block: the paths that near copies share have few least
classes, so a class is sent to few blocks. Blocks that hang together are one block, to
which each class is sent once, where that needs fewer comparisons. A block is
split into chunks, of SMALL classes first and of CHUNK at most, and each pair of
chunks is a task of its own: links are counted, so the work in a block grows with its pairs, but
no pair leaves it. A block returns its classes' components and numbers of links;
the components of all blocks are joined by alternating stars.

Nothing is capped: the list of frequent elements has FREQUENT entries at most,
but only sets the order, on which results do not depend. Null texts and texts
without words have an empty set, link with nothing and keep their own id as
component. A component's id is its smallest doc_id that is not null. Repeated
rows get a row each. Texts of any length are read whole. Empty tables give no rows. Hashes are taken as equal only for equal n-grams; at 2^64
values, a collision is possible and not expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.llm.common import IDENTITY, SPACE, identity, packed, pieces, text_of, unpacked
from veristrata.session import cut, release, table

FREQUENT = 1 << 16
#: A shingle is frequent if so many sets of one task have it.
FREQUENT_LEAST = 16
CHUNK = 4096
#: Elements that a task counts at a time for the list of frequent ones.
COUNTED = 2_000_000
#: Smaller blocks are split into up to SPLIT chunks of SMALL classes, so that a few groups do not hold up a stage.
SMALL, SPLIT = 512, 8
#: Elements in a node of the prefix tree's first level; the next levels' nodes hold twice as many each.
FIRST_WIDTH = 16
#: Edges, of 16 bytes, that one task may finish.
FEW_EDGES = 1 << 18
#: Bytes of text that are hashed at a time.
PIECE = 1 << 19
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD))


@dataclass(frozen=True)
class Similarity:
    """n-grams of so many words; linked if den * intersection >= num * union."""

    shingle: int = 5
    num: int = 80
    den: int = 100

    def least_overlap(self, a, b):
        """Of sets of sizes a and b; works on arrays."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, size: int) -> int:
        """So many first elements hold two that follow each other in both of any two linked sets.

        Where the shorter of two such prefixes ends, the one set has x elements
        that the other lacks, and the other y; the common ones then form
        x + y + 1 runs at most, so some run has two if there are 2 x + y + 2.
        0 if only an equal set can link.
        """
        if size not in self._prefixes:
            others = np.arange(-(-self.num * size // self.den), size * self.den // self.num + 1)
            least = self.least_overlap(size, others)
            lost = 2 * (size - least) + (others - least)
            self._prefixes[size] = int(lost.max()) + 2 if lost.max() > 0 else 0
        return self._prefixes[size]

    def __post_init__(self):
        if 10 * self.num < 7 * self.den or self.num > self.den:
            raise ValueError("a similarity from 0.7 to 1")
        object.__setattr__(self, "_prefixes", {})


def _byte_codes() -> np.ndarray:
    """A random 64-bit number for each byte, from a fixed seed; A-Z as a-z, and white space as 0."""
    codes = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    codes[[9, 10, 11, 12, 13, 32]] = 0
    return codes


_CODES = _byte_codes()


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and 64-bit hashes of the words in bytes that end with white space: a polynomial of the bytes' codes, without the case of A-Z."""
    codes = _CODES[data]
    inside = codes != 0
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    codes = codes[inside]
    offsets = np.cumsum(lengths) - lengths
    at = np.arange(len(codes)) - np.repeat(offsets, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _MIX[1], dtype=np.uint64))
    h = np.add.reduceat(codes * powers[at], offsets) + lengths.astype(np.uint64) * _MIX[3]
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return starts, lengths, h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-grams; of the whole sequence, if it is shorter."""
    data = b"\n".join(texts) + b"\n"
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, _, h = word_hashes(np.frombuffer(data, dtype=np.uint8))
    limits = np.concatenate(([0], np.searchsorted(starts, ends))).tolist()
    grams = np.full(max(len(h) - n + 1, 0), np.uint64(0x5EED), dtype=np.uint64)
    for k in range(n):
        grams = (grams ^ h[k : k + len(grams)]) * _MIX[k % len(_MIX)]
        grams ^= grams >> np.uint64(31)
    out = []
    for a, b in zip(limits, limits[1:], strict=False):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            whole = np.full(min(b - a, 1), b - a, dtype=np.uint64)
            for k in range(a, b):
                whole = (whole ^ h[k]) * _MIX[2]
                whole ^= whole >> np.uint64(31)
            out.append(whole)
    return out


def shingle_set(text: bytes, n: int) -> np.ndarray:
    return shingle_sets([text], n)[0]


def set_key(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    if not len(frequent):
        return s
    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return np.concatenate((s[~often], s[often])) if often.any() else s


class Trie:
    """Ordered sets in a prefix tree, level by level; the nodes of a level hold so many elements as its width.

    Widths double from FIRST_WIDTH, so there are few levels, and a set's rows are at most twice its size. Sets
    with the same elements up to a level's end share its node, and with it the overlap counted so far.
    """

    def __init__(self, sets: list[np.ndarray], similarity: Similarity):
        self.similarity = similarity
        self.sizes = sizes = np.array([len(s) for s in sets], dtype=np.int64)
        all_, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        # The order of ranks differs from the global order, but is as good inside the block: it is one order for all.
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.sets = [np.sort(ranks[a:b].astype(np.int32)) for a, b in zip(bounds, bounds[1:], strict=False)]
        order = np.array(sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">i4").tobytes()), dtype=np.int64)
        shared = np.zeros(len(order), dtype=np.int64)
        for k in range(1, len(order)):
            a, b = self.sets[order[k - 1]], self.sets[order[k]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[k] = differ[0] if len(differ) else m
        self.has = np.zeros(len(all_) + 1, dtype=np.uint8)  # the last one pads rows that end early
        self.left = np.ones(len(sets), dtype=bool)
        self.levels = []
        low, width, above = 0, FIRST_WIDTH, np.zeros(len(sets), dtype=np.int64)
        while (inside := sizes[order] > low).any():
            members, high = order[inside], low + width
            # Sets that share up to `high` are neighbours, and all between them share as much.
            at = np.cumsum(shared[inside] < high) - 1
            firsts = np.flatnonzero(np.diff(at, prepend=-1))
            rows = np.full((len(firsts), width), len(all_), dtype=np.int32)
            for r, i in enumerate(members[firsts]):
                part = self.sets[i][low:high]
                rows[r, : len(part)] = part
            own = sizes[members]
            node = np.full(len(sets), -1, dtype=np.int64)
            node[members] = at
            ends = own <= high
            self.levels.append(
                {
                    "low": low, "rows": rows, "parent": above[members[firsts]], "node": node,
                    "least": np.minimum.reduceat(own, firsts), "most": np.maximum.reduceat(own, firsts),
                    "live": np.bincount(at, minlength=len(firsts)), "last": np.minimum(rows, len(all_) - 1).max(axis=1),
                    "ends": members[ends], "ends_at": at[ends],
                }
            )
            low, width, above = high, 2 * width, node

    def take(self, which: list[int] | np.ndarray) -> None:
        """Takes sets out of the tree; nodes that hold none any more are not walked."""
        self.left[which] = False
        for level in self.levels:
            nodes = level["node"][which]
            np.subtract.at(level["live"], nodes[nodes >= 0], 1)

    def probe(self, which: int) -> np.ndarray:
        """The sets in the tree that link with this one."""
        own, size, s = self.sets[which], len(self.sets[which]), self.similarity
        largest, smallest = size * s.den // s.num, -(-size * s.num // s.den)
        self.has[own] = 1
        found, alive, above = [], np.ones(1, dtype=bool), np.zeros(1, dtype=np.int64)
        for level in self.levels:
            at = np.flatnonzero(alive[level["parent"]] & (level["live"] > 0) & (level["least"] <= largest) & (level["most"] >= smallest))
            if not len(at):
                break
            overlap = np.zeros(len(level["rows"]), dtype=np.int64)
            overlap[at] = above[level["parent"][at]] + self.has[level["rows"][at]].sum(axis=1, dtype=np.int64)
            alive = np.zeros(len(overlap), dtype=bool)
            alive[at] = True
            linked = level["ends"][alive[level["ends_at"]]]
            linked = linked[self.left[linked]]
            linked = linked[overlap[level["node"][linked]] >= s.least_overlap(self.sizes[linked], size)]
            found.append(linked)
            # What remains of the largest set below a node, and of the probe, must make up the overlap needed.
            high = level["low"] + level["rows"].shape[1]
            most = np.minimum(level["most"][at], largest)
            rest = size - np.searchsorted(own, level["last"][at], side="right")
            fits = overlap[at] + np.maximum(most - high, 0) >= s.least_overlap(most, size)
            fits &= overlap[at] + rest >= s.least_overlap(np.maximum(level["least"][at], smallest), size)
            alive[at[~fits]] = False
            above = overlap
        self.has[own] = 0
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def block_links(sets: list[np.ndarray], similarity: Similarity, first: int | None = None, counts=lambda i, found: found) -> tuple[list[int], list[np.ndarray]]:
    """For each set, the first of its component, and the sets that it links with and that come after it in the order of probes.

    Each set probes the prefix tree once and is then taken out, so a pair is met once. With `first`, only pairs
    of one of the first so many sets and one of the others are looked at. `counts` says which pairs count as links here.
    """
    trie, root, linked = Trie(sets, similarity), list(range(len(sets))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if first is not None:
        trie.take(np.arange(first))
    for i in range(len(sets) if first is None else first):
        if first is None:
            trie.take([i])
        found = trie.probe(i)
        for j in found.tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
        linked.append(counts(i, found))
    return [find(i) for i in range(len(sets))], linked


def block_components(sets: list[np.ndarray], similarity: Similarity) -> list[int]:
    """For each set, the first of its component."""
    return block_links(sets, similarity)[0]


def classes(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """A row for each document (doc_id, text_hash, n, key), and rows with h set: frequent n-grams of a task (n: how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        names = ["doc_id", "text_hash", "n", "key", "h"]

        def often():
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                h, n = h[n >= FREQUENT_LEAST], n[n >= FREQUENT_LEAST]
                none = pa.nulls(len(h), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(n.astype(np.int64)), none, pa.array(h.view(np.int64))], names=names)

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                n, keys = [], []
                for s in shingle_sets([t.as_buffer().to_pybytes() for t in part.column(2)], similarity.shingle):
                    key = set_key(s) if len(s) else None
                    n.append(len(s))
                    keys.append(key)
                    if key is not None and key not in seen:  # each set once
                        seen.add(key)
                        held.append(s)
                        size += len(s)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(len(n), pa.int64())], names=names)
                if size > COUNTED:
                    yield from often()
                    held.clear()
                    seen.clear()
                    size = 0
        yield from often()

    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, key long, h long")


def paths(s: np.ndarray, similarity: Similarity, frequent: np.ndarray) -> np.ndarray:
    """The pairs of neighbouring elements of the set's prefix, as hashes."""
    first = ordered(s, frequent)[: similarity.prefix(len(s))]
    return ((first[:-1] * _MIX[4]) ^ (first[1:] * _MIX[2] + _MIX[1])).view(np.int64)


def prefixes(docs: DataFrame, similarity: Similarity, frequent: np.ndarray) -> DataFrame:
    """h, key, size: the paths by which classes can meet."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                h, keys, sizes = [np.zeros(0, np.int64)], [], []
                for s in shingle_sets([t.as_buffer().to_pybytes() for t in part.column(0)], similarity.shingle):
                    key = set_key(s) if len(s) else None
                    if key is None or key in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    h.append(paths(s, similarity, shared.value))
                    keys.append(key)
                    sizes.append(len(s))
                counts = [len(x) for x in h[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.repeat(np.array(keys, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))], names=["h", "key", "size"])

    return docs.select(text_of().cast("binary").alias("text")).mapInArrow(run, "h long, key long, size int")


def blocks(pairs: DataFrame, similarity: Similarity) -> DataFrame:
    """block, key, n: the classes that can link, by block, and how many are in it. pairs: as of prefixes().

    A class leaves a path where no class of a size that could link with its own is. A path's least class names its
    block, so classes that meet at a path are in one block.
    """
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_h, by_size = Window.partitionBy("h"), Window.partitionBy("h").orderBy("size", "key")
    met = pairs.repartition(partitions, "h").groupBy("h", "key").agg(F.max("size").alias("size"))
    met = met.withColumns({"before": F.lag("size").over(by_size), "after": F.lead("size").over(by_size)})
    alike = lambda x, y: F.coalesce(F.lit(similarity.den) * x >= F.lit(similarity.num) * y, F.lit(False))
    met = met.filter(alike(F.col("before"), F.col("size")) | alike(F.col("size"), F.col("after"))).select("h", "key")
    named = met.select(F.min("key").over(by_h).alias("block"), "key").distinct()
    return cut(named.withColumn("n", F.count("key").over(Window.partitionBy("block"))))


def candidates(docs: DataFrame, known: DataFrame, met: DataFrame) -> DataFrame:
    """key, size, text: a document for each class that meets another, and how many documents the class has. known: classes' documents; met: as of blocks()."""
    first = known.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("size")).join(met.select("key").distinct(), "key")
    first = first.select("key", "size", F.coalesce("first.doc_id", F.lit(-1)).alias("doc"), F.col("first.doc_id").isNull().alias("no_id"), F.col("first.text_hash").alias("text_hash"))
    texts = docs.select(*[v.alias(k) for k, v in identity().items()], text_of().cast("binary").alias("text"))
    return cut(texts.join(first, IDENTITY).select("key", "size", "text"))


def links(docs: DataFrame, known: DataFrame, met: DataFrame, similarity: Similarity) -> DataFrame:
    """key, root, linked: a row for each class and block: the first class of its component there, and with how many documents of other classes it links, if they are counted there. met: as of blocks().

    Classes that meet, directly or through others, form a group. Either the
    group is one block, and each class is sent once, or its blocks stay:
    whichever has fewer pairs to compare. A pair that meets in several blocks
    counts in the least of them, so each link is counted once.
    """
    texts = candidates(docs, known, met)
    groups = components(met.select(F.col("block").alias("a"), F.col("key").alias("b")))
    roots = met.select("key").distinct().join(groups.select(F.col("b").alias("key"), F.col("a").alias("group")), "key", "left").select("key", F.coalesce("group", "key").alias("group"))
    roots = cut(roots)
    own = roots.groupBy("group").agg(F.count("*").alias("n"))
    dense = met.join(roots, "key").groupBy("group").agg(F.sum("n").alias("pairs"))  # a class of a block of n meets n of them
    groups = cut(own.join(dense, "group").withColumn("whole", (F.col("n") <= CHUNK) | (F.col("n") * F.col("n") <= F.col("pairs"))).select("group", "n", "whole"))
    kept = roots.join(groups, "group")
    whole = kept.filter("whole").select(F.col("group").alias("block"), "key", "n", F.lit(True).alias("whole"), F.lit(None).cast("array<long>").alias("blocks"))
    rest = met.join(kept.filter("not whole").select("key"), "key")
    rest = rest.join(rest.groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("blocks")), "key").select("block", "key", "n", F.lit(False).alias("whole"), "blocks")
    found = cut(in_blocks(texts, whole.unionByName(rest), similarity))
    release(texts, roots, groups)
    return found


def in_blocks(texts: DataFrame, where: DataFrame, similarity: Similarity) -> DataFrame:
    """key, root, linked, as of links(). where: block, key, n (classes in the block), whole (whether the block is a group), blocks (else: all of the class)."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.greatest(F.expr(f"(n + {CHUNK - 1}) div {CHUNK}"), F.least(F.lit(SPLIT), F.expr(f"(n + {SMALL - 1}) div {SMALL}"))).cast("int")
    sent = where.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    sent = sent.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("key", "block", "whole", "blocks", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = texts.join(sent, "key").select("block", "whole", "i", "j", "own", "key", "size", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks one after the other, as the rows are sorted; one block (of 2 CHUNK classes, about) is held at a time."""
        held, sets, out = None, [], []

        def solve():
            block, whole, i, j = held
            keys, sizes = [x[1] for x in sets], np.array([x[2] for x in sets], dtype=np.int64)
            first = None if i == j else sum(x[0] == i for x in sets)
            own = None if whole else [np.array(x[4], dtype=np.int64) for x in sets]

            def least_here(a: int, found: np.ndarray) -> np.ndarray:
                return np.array([b for b in found.tolist() if np.intersect1d(own[a], own[b], assume_unique=True)[0] == block], dtype=np.int64)

            if first == 0 or first == len(sets):
                return
            root, linked = block_links([x[3] for x in sets], similarity, first, (lambda a, found: found) if whole else least_here)
            n = np.zeros(len(sets), dtype=np.int64)
            for a, found in enumerate(linked):
                n[a] += sizes[found].sum()
                n[found] += sizes[a]
            out.extend((keys[a], keys[r], int(c)) for a, (r, c) in enumerate(zip(root, n.tolist(), strict=True)) if c or r != a)

        def flush():
            columns = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "root", "linked"])

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                found = shingle_sets([t.as_buffer().to_pybytes() for t in part.column("text")], similarity.shingle)
                columns = [part.column(c).to_pylist() for c in ("block", "whole", "i", "j", "own", "key", "size", "blocks")]
                for *block, side, key, size, own_blocks, s in zip(*columns, found, strict=True):
                    if block != held:
                        if len(sets) > 1:
                            solve()
                        held, sets = block, []
                    if not sets or sets[-1][:2] != (side, key):  # a repeated row's text comes twice
                        sets.append((side, key, size, s, own_blocks))
            yield flush()
        if len(sets) > 1:
            solve()
        yield flush()

    to = ["block", "i", "j"]
    return rows.repartition(partitions, *to).sortWithinPartitions("block", "whole", "i", "j", "own", "key").mapInArrow(run, "key long, root long, linked long")


def stars_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """b, a: union-find over the edges of one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """b, a: each node that has links, except the smallest of its component (a).

    Alternating stars until the edges are few enough (FEW_EDGES, counted) for one task.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return edges
        if state["n"] <= FEW_EDGES:
            return cut(edges.coalesce(1).mapInArrow(stars_of, "a long, b long"))
        before = state
        # Large star: every larger neighbour of a node is linked with the node's smallest neighbour, or itself.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a != b").distinct()
        # Small star: the smaller neighbours of a node, and itself, are linked with the smallest.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
        before_edges, edges = edges, cut(small)
        release(before_edges)


def grouped(docs: DataFrame, similarity: Similarity) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_hash, n, key); and key, root (smallest key of the class's component), linked (documents of other classes that link with the class)."""
    both = cut(classes(docs, similarity))
    known = both.filter("h is null").drop("h")
    often = both.filter("h is not null").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()  # FREQUENT numbers
    frequent = np.sort(np.array([r["h"] for r in often], dtype=np.int64).view(np.uint64))
    met = blocks(prefixes(docs, similarity, frequent), similarity)
    found = links(docs, known, met, similarity)
    release(met)
    stars = components(found.select(F.col("root").alias("a"), F.col("key").alias("b")))
    keys = known.filter("key is not null").select("key").distinct()
    roots = keys.join(stars.select(F.col("b").alias("key"), F.col("a").alias("root")), "key", "left")
    roots = roots.join(found.groupBy("key").agg(F.sum("linked").alias("linked")), "key", "left")
    return known, roots.select("key", F.coalesce("root", "key").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))


def join(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size, n_links: a row for each row of docs.

    class_size counts the rows with an equal set; n_links the other rows that the row links with, copies included.
    """
    known, roots = grouped(docs, similarity)
    sizes = known.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    named = cut(roots.join(sizes, "key"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "root").select("key", "component_id", "class_size", (F.col("class_size") - 1 + F.col("linked")).alias("n_links")))
    rows = known.withColumn("side", F.coalesce("key", F.xxhash64("doc_id", "text_hash")))  # null keys are spread
    rows = rows.join(named.withColumnRenamed("key", "found"), F.col("side") == F.col("found"), "left")
    empty = F.col("key").isNull()
    one = lambda c, none: F.when(empty, F.lit(none)).otherwise(F.col(c)).cast("long").alias(c)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), one("class_size", 1), one("n_links", 0))


def keep_one(docs: DataFrame, similarity: Similarity | None = None) -> DataFrame:
    """docs with one row of each component, and all rows without words; columns as they are.

    The row of the smallest doc_id stays (a null one only if there is no other); of rows with equal doc_id and
    text, the least by the other columns, in their order.
    """
    known, roots = grouped(docs, similarity or Similarity())
    # Of each class first, so that many copies are one row before they meet.
    first = known.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one"))
    first = first.join(roots, "key").groupBy("root").agg(F.min("one").alias("one"))
    kept = first.select(F.coalesce("one.doc_id", F.lit(-1)).alias("doc"), "one.no_id", "one.text_hash")
    worded = text_of().rlike(f"[^{SPACE}]")
    rows = packed(docs.filter(worded), **identity()).join(kept, IDENTITY, "left_semi")
    order = F.struct(*[F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = rows.groupBy(*IDENTITY).agg(F.min_by("row", order).alias("row"))
    return unpacked(one, docs.columns).union(docs.filter(~worded))


OP4 = Similarity(shingle=4, num=85, den=100)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"), OP4)


QUERIES = {"op4_jaccard_join": op4}
ORACLE_SQL = {
    "op4_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(t, '[\x20\x09-\x0D]+') END AS w
  FROM (SELECT doc_id, translate(regexp_replace(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
k AS (SELECT doc_id, md5(coalesce(array_to_string(list(g ORDER BY g), chr(10)), '')) AS h FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id,
       coalesce(count(*) FILTER (k.h IS NOT NULL) OVER (PARTITION BY coalesce(k.h, CAST(d.doc_id AS VARCHAR))), 1) AS class_size, (SELECT count(*) FROM u WHERE u.x = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
}
