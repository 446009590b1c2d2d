"""Language-model scoring with a hashed maximum-entropy model.

The softmax is factored by word classes: P(word) = P(class | context) *
P(word | class, context). The class model has hashed features of the previous
word, the two previous words, the word before the previous one (a skip) and a
skip pair. The most frequent words have classes by frequency; inside one, a
second maximum-entropy model has features of the two previous classes. All
other words, unknown ones too, have classes by their form (their last letters and
length), so that their context tells them apart as well; inside such a class they
follow smoothed corpus frequencies, with a share for unknown words. So the
probabilities sum to one over all known words and one unknown of each form.

Training: exact token counts over the whole training text. The text is dealt by
its hash into shards of about SHARD_TOKENS tokens each; a shard is read in order
of hashes, and takes gradient steps (with rates by feature) of BATCH tokens. The
shards' weights are averaged, each feature by how often a shard saw it. How many
shards there are, what they hold and in which order depends on the text alone:
the result is the same for any partitioning and any number of machines, up to
rounding, and more text means more shards, not smaller ones. The counts, which
grow with the text, stay in a table; the weights have a fixed number of buckets
(BUCKETS), as a shard's have. Counts are whole numbers throughout. Scoring: sparse numpy batches, with one join for the words that are
too rare for the bounded lookup table that each worker holds.

Words are told apart by 64-bit hashes; a collision is possible and not expected.
Null and empty texts have one token, the end. Texts of any length are read whole.
Repeated rows get a row each. A null doc_id is in no fold that is held out, and
trains. With no training text at all, scores are those of the uniform smoothed
model. Empty tables give no rows. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import pieces, remainder, text_of
from veristrata.llm.jaccard_join import word_hashes
from veristrata.session import cut, table

#: Words that workers hold in memory, by count; the rest are joined.
LOOKUP = 1 << 18
#: Words with classes by frequency.
MODEL_WORDS = 2048
#: Classes by frequency, and by form.
FREQUENT, FORMS = 20, 12
CLASSES = FREQUENT + FORMS
#: Feature buckets of a template, at any size of the text: what a shard sends and a worker holds is bounded by them.
BUCKETS = 1 << 14
TEMPLATES = 4
SHARD_TOKENS = 4_000_000
BATCH = 1 << 16
#: Numbers in a block that tasks exchange.
BLOCK = 16384
#: Counts that a task holds before it passes them on.
HELD = 1 << 20
RATE = 0.25
#: The end of a text as a token; no word hashes to it.
END = np.uint64(1)
_PRIMES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


@dataclass
class LanguageModel:
    """Parameters of a bounded size; the lookup has LOOKUP words at most, in order of their counts."""

    lookup: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    word_class: np.ndarray
    bias: np.ndarray
    buckets: int
    form_mass: np.ndarray = field(default_factory=lambda: np.full(FORMS, 0.5))  # smoothed mass of the words of each form
    weights: np.ndarray | None = None
    inner: np.ndarray | None = None  # log P(word | class, previous two classes)


def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and forms of all tokens, ends included, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, sizes, h = word_hashes(data)
    limits = np.searchsorted(starts, ends)
    lengths = np.diff(limits, prepend=0) + 1
    last = data[starts + sizes - 1].astype(np.int64)
    before = data[np.maximum(starts + sizes - 2, 0)].astype(np.int64) * (sizes > 1)
    forms = ((last * 31 + before) * 2654435761 >> 12) % FORMS
    out, kinds = np.full(len(h) + len(texts), END, dtype=np.uint64), np.zeros(len(h) + len(texts), dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(lengths) - 1] = False
    out[inside], kinds[inside] = h, forms
    return out, kinds, lengths


def _summed(h: np.ndarray, forms: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, forms, c = h[order], forms[order], c[order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    return h[starts], forms[starts], np.add.reduceat(c, starts) if len(h) else c


def token_counts(docs: DataFrame) -> DataFrame:
    """Exact counts: h, form, c. Tasks add up what they read before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged():
            return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def out(h, forms, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(forms), pa.array(c)], names=["h", "form", "c"])

        for batch in batches:
            for part in pieces(batch):
                h, forms, _ = read([x.as_buffer().to_pybytes() for x in part.column(0)])
                held.append(_summed(h, forms, np.ones(len(h), dtype=np.int64)))
                if sum(len(x[0]) for x in held) > HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    texts = docs.select(text_of().cast("binary").alias("text"))
    return texts.mapInArrow(count, "h long, form long, c long").groupBy("h").agg(F.min("form").alias("form"), F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[int, int, int]]:
    """h, form, count of the most frequent tokens, `most` at most: all above a count that a histogram gives."""
    bins = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("bin")).count().collect()  # 1,024 bins at most
    total, least = 0, None
    for row in sorted(bins, key=lambda r: -r["bin"]):
        total += row["count"]
        if total > most:
            break
        least = row["bin"]
    if least is None:
        return []
    rows = counts.filter(F.floor(F.log2("c") * 16) >= least).collect()
    return sorted(((r["h"], r["form"], r["c"]) for r in rows), key=lambda x: (-x[2], x[0]))


def plan_classes(counts: np.ndarray) -> np.ndarray:
    """Frequency classes of equal shares of the root counts."""
    top = counts[:MODEL_WORDS]
    if not len(top):
        return np.zeros(0, dtype=np.int64)
    mass = np.cumsum(np.sqrt(top.astype(np.float64)))
    return np.minimum((mass / mass[-1] * FREQUENT).astype(np.int64), FREQUENT - 1)


class Reader:
    """Turns texts into word ids, classes and hashed contexts."""

    def __init__(self, model: LanguageModel):
        self.known, self.words, self.buckets = len(model.lookup), len(model.word_class), np.uint64(model.buckets)
        self.word_class = np.append(model.word_class, 0).astype(np.int64)
        bits = max(4, int(4 * self.known).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.ids = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, self.known, dtype=np.int32)
        left, slots = np.arange(self.known), (model.lookup & self.mask).astype(np.int64)
        while len(left):  # an open table: of words that meet, the first stays and the others go one further
            free = self.ids[slots] == self.known
            slot, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            put = first[slot >= 0]
            self.keys[slots[put]], self.ids[slots[put]] = model.lookup[left[put]], left[put]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, slots = left[stay], (slots[stay] + 1) & int(self.mask)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ranks of known words; self.known for others."""
        out = np.full(len(h), self.known, dtype=np.int32)
        slots = (h & self.mask).astype(np.int64)
        at = np.arange(len(h))
        while len(at):
            ids = self.ids[slots]
            hit = (self.keys[slots] == h[at]) & (ids != self.known)
            out[at[hit]] = ids[hit]
            go = ~hit & (ids != self.known)
            at, slots = at[go], (slots[go] + 1) & int(self.mask)
        return out

    @staticmethod
    def before(x: np.ndarray, at: np.ndarray, k: int, start: int) -> np.ndarray:
        """x, k tokens earlier in the same text; `start` before its beginning."""
        out = np.full_like(x, start)
        out[k:] = x[:-k] if k < len(x) else x[:0]
        out[at < k] = start
        return out

    def contexts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens: hashes, ids, buckets (templates x tokens), classes, those of the two before; and the texts' lengths."""
        h, forms, lengths = read(texts)
        ids = self.find(h)
        classes = np.where(ids < self.words, self.word_class[np.minimum(ids, self.words)], FREQUENT + forms)
        at = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        one, two, three = (self.before(h, at, k, 0) for k in (1, 2, 3))
        p = _PRIMES
        values = (one * p[0], (one * p[1]) ^ (two * p[2] + p[0]), two * p[2] + p[3], (one * p[3]) ^ (three * p[0] + p[1]))
        buckets = np.empty((TEMPLATES, len(h)), dtype=np.uint16)
        for f, x in enumerate(values):
            x = (x ^ (x >> np.uint64(29))) * p[(f + 1) % 4]
            buckets[f] = (x >> np.uint64(40)) % self.buckets
        return h, ids, buckets, classes, self.before(classes, at, 1, CLASSES), self.before(classes, at, 2, CLASSES), lengths


def class_logits(weights: np.ndarray, bias: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Log-probabilities of the classes, tokens x CLASSES."""
    logits = bias + weights[0][buckets[0]]
    for f in range(1, TEMPLATES):
        logits += weights[f][buckets[f]]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


class Trainer:
    """Gradient steps of one shard over its text, BATCH tokens at a time, however the text is cut into pieces."""

    def __init__(self, model: LanguageModel, reader: Reader):
        self.reader = reader
        self.bias = model.bias.astype(np.float32)
        self.weights = np.zeros((TEMPLATES, model.buckets, CLASSES), dtype=np.float32)
        self.squares = np.ones_like(self.weights)
        self.seen = np.zeros((TEMPLATES, model.buckets), dtype=np.int64)
        k, words = CLASSES + 1, max(1, reader.words)
        self.first, self.second, self.joint = (np.zeros(s, dtype=np.int64) for s in ((k, words), (k, words), (k, k, CLASSES)))
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def step(self, buckets: np.ndarray, classes: np.ndarray) -> None:
        error = np.exp(class_logits(self.weights, self.bias, buckets))
        error[np.arange(len(classes)), classes] -= 1
        for f in range(TEMPLATES):
            order = np.argsort(buckets[f], kind="stable")
            sorted_buckets = buckets[f][order]
            starts = np.flatnonzero(np.concatenate(([True], sorted_buckets[1:] != sorted_buckets[:-1])))
            which = sorted_buckets[starts]
            gradient = np.add.reduceat(error[order], starts, axis=0)
            self.squares[f][which] += gradient * gradient
            self.weights[f][which] -= RATE * gradient / np.sqrt(self.squares[f][which])
            self.seen[f][which] += np.diff(np.append(starts, len(order)))

    def learn(self, texts: list[bytes]) -> None:
        _, ids, buckets, classes, c1, c2, _ = self.reader.contexts(texts)
        inside = ids < self.reader.words
        w, k = self.first.shape[1], CLASSES + 1
        self.first += np.bincount(c1[inside] * w + ids[inside], minlength=k * w).reshape(k, w)
        self.second += np.bincount(c2[inside] * w + ids[inside], minlength=k * w).reshape(k, w)
        self.joint += np.bincount((c1[inside] * k + c2[inside]) * CLASSES + classes[inside], minlength=k * k * CLASSES).reshape(k, k, CLASSES)
        self.waiting.append((buckets, classes))
        self.n_waiting += len(classes)
        if self.n_waiting >= BATCH:
            self.drain(BATCH)

    def drain(self, least: int) -> None:
        """Steps over what waits, as long as there are so many tokens."""
        buckets, classes = np.concatenate([x for x, _ in self.waiting], axis=1), np.concatenate([x for _, x in self.waiting])
        at = 0
        while len(classes) - at >= least and at < len(classes):
            self.step(buckets[:, at : at + BATCH], classes[at : at + BATCH])
            at = min(at + BATCH, len(classes))
        self.waiting, self.n_waiting = [(buckets[:, at:], classes[at:])], len(classes) - at

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights, each times how often its feature was seen; and counts."""
        if self.n_waiting:
            self.drain(1)
        return (self.weights * self.seen[:, :, None]).astype(np.float32).ravel(), np.concatenate([x.ravel() for x in (self.seen, self.first, self.second, self.joint)])


def fit_inner(model: LanguageModel, first: np.ndarray, second: np.ndarray, joint: np.ndarray, steps: int = 12) -> np.ndarray:
    """Maximum-entropy fit of P(word | class, previous two classes) from summed counts of fixed size."""
    words = len(model.word_class)
    base = np.log(model.counts[:words] + 0.5)
    a, b = np.zeros(first.shape), np.zeros(second.shape)
    starts = np.searchsorted(model.word_class, np.arange(FREQUENT))
    present = starts < np.append(starts[1:], words)
    sizes = np.diff(np.append(starts[present], words))

    def logs() -> np.ndarray:
        logits = base + a[:, None, :] + b[None, :, :]
        logits -= np.repeat(np.maximum.reduceat(logits, starts[present], axis=2), sizes, axis=2)
        total = np.add.reduceat(np.exp(logits), starts[present], axis=2)
        return logits - np.log(np.repeat(total, sizes, axis=2))

    for _ in range(steps):
        expected = np.exp(logs()) * joint[:, :, model.word_class]
        a += 0.5 * np.log((first + 1.0) / (expected.sum(axis=1) + 1.0))
        b += 0.5 * np.log((second + 1.0) / (expected.sum(axis=0) + 1.0))
    return logs().astype(np.float32)


def plan(counts: DataFrame) -> LanguageModel:
    """The model before training: the vocabulary, classes, their sizes, and the number of buckets."""
    totals = {r["form"]: (r["n"], r["v"]) for r in counts.groupBy("form").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # FORMS rows
    n, v = sum(x for x, _ in totals.values()), sum(x for _, x in totals.values())
    top = frequent(counts, LOOKUP)
    lookup, own = np.array([h for h, _, _ in top], dtype=np.int64).view(np.uint64), np.array([c for _, _, c in top], dtype=np.int64)
    model = LanguageModel(lookup, own, int(n), int(v), plan_classes(own), np.zeros(CLASSES, np.float32), BUCKETS)
    words = len(model.word_class)
    sizes = np.zeros(CLASSES)
    sizes[:FREQUENT] = np.bincount(model.word_class, weights=own[:words], minlength=FREQUENT)[:FREQUENT] if words else 0
    for form, (c, kinds) in totals.items():
        inside = np.array([f == form for _, f, _ in top[:words]], dtype=bool)
        rest, types = c - int(own[:words][inside].sum()), kinds - int(inside.sum())
        sizes[FREQUENT + form] = rest
        model.form_mass[form] = rest + 0.5 * types + 0.5
    model.bias = np.log(sizes + 0.5).astype(np.float32)
    model.bias[:FREQUENT][sizes[:FREQUENT] == 0] = -30  # classes without words
    return model


def train(docs: DataFrame) -> tuple[LanguageModel, DataFrame]:
    """The model, and the token counts of all of docs."""
    spark = docs.sparkSession
    counts = cut(token_counts(docs))
    model = plan(counts)
    shared = spark.sparkContext.broadcast(vars(model))
    shards = max(1, round(model.n / SHARD_TOKENS))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = trainer = held = None
        plan = LanguageModel(**shared.value)  # plain values travel, so workers need no package of ours

        def out():
            for kind, x in enumerate(trainer.packed()):
                blocks = [x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)]
                for i in range(0, len(blocks), 64):
                    some = blocks[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(range(i, i + len(some)), pa.int32()), pa.array([held % 32] * len(some), pa.int32()), pa.array(some, pa.binary())], names=["kind", "block", "salt", "sums"])

        for batch in batches:
            owners = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if owners[a] != held:  # rows are sorted by shard
                    if trainer is not None:
                        yield from out()
                    reader = reader or Reader(plan)
                    held, trainer = int(owners[a]), Trainer(plan, reader)
                for part in pieces(batch.slice(a, b - a)):
                    trainer.learn([x.as_buffer().to_pybytes() for x in part.column(1)])
        if trainer is not None:
            yield from out()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for kind, block, salt, sums in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(sums, dtype=np.int64 if kind else np.float32)
                if (kind, block, salt) in held:
                    held[kind, block, salt] += x
                else:
                    held[kind, block, salt] = x.astype(np.int64 if kind else np.float64)
        if held:
            texts = [x.astype(np.int64 if k[0] else np.float32).tobytes() for k, x in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array(texts, pa.binary())], names=["kind", "block", "salt", "sums"])

    kind = "kind int, block int, salt int, sums binary"
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.pmod(F.xxhash64(text_of()), F.lit(shards)).cast("int").alias("shard"), text_of().cast("binary").alias("text"), F.xxhash64(text_of(), F.lit(7)).alias("order"))
    # A shard goes to the task of its number, so no task has two while others have none.
    rows = rows.repartitionById(min(shards, 4 * partitions), F.pmod("shard", F.lit(min(shards, 4 * partitions)))).sortWithinPartitions("shard", "order").select("shard", "text")
    sums = rows.mapInArrow(learn, kind).repartition(partitions, "kind", "block", "salt").mapInArrow(add_up, kind).repartition(partitions, "kind", "block").mapInArrow(add_up, kind)
    k, words = CLASSES + 1, max(1, len(model.word_class))
    shapes = [(TEMPLATES, model.buckets), (k, words), (k, words), (k, k, CLASSES)]
    found: tuple[dict, dict] = ({}, {})
    for r in sums.collect():  # the model: BUCKETS and MODEL_WORDS bound its blocks
        found[r["kind"]][r["block"]] = np.frombuffer(r["sums"], dtype=np.int64 if r["kind"] else np.float32)
    parts = [np.zeros(s, dtype=np.int64) for s in shapes]
    model.weights = np.zeros((TEMPLATES, model.buckets, CLASSES), dtype=np.float32)
    if found[1]:
        flat = np.concatenate([found[1][i] for i in sorted(found[1])])
        parts = [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes, strict=True)]
        weights = np.concatenate([found[0][i] for i in sorted(found[0])]).reshape(model.weights.shape)
        model.weights = (weights / np.maximum(parts[0], 1)[:, :, None]).astype(np.float32)
    if len(model.word_class):
        model.inner = fit_inner(model, *parts[1:])
    shared.unpersist()
    return model, counts


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_once (tokens that the training text has once): a row for each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(model))
    schema = "doc_id long, text_hash long, token long, tf int, own struct<n_tokens:long,n_known:long,n_once:long,base:double,model:double>"
    own_type = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_once", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                if reader is None:
                    m = LanguageModel(**shared.value)
                    reader = Reader(m)
                    logs, masses, once = np.append(np.log10(m.counts + 0.5), 0.0), np.log10(m.form_mass), np.append(m.counts == 1, False)
                h, ids, buckets, classes, c1, c2, lengths = reader.contexts([x.as_buffer().to_pybytes() for x in part.column(2)])
                known, inside = ids < reader.known, ids < reader.words
                base = logs[ids]
                value = np.empty(len(ids))
                for i in range(0, len(ids), BATCH):
                    s = slice(i, i + BATCH)
                    value[s] = class_logits(m.weights, m.bias, buckets[:, s])[np.arange(len(classes[s])), classes[s]]
                if reader.words:
                    value[inside] += m.inner[c1[inside], c2[inside], ids[inside]]
                value /= np.log(10)
                value[~inside] += base[~inside] - masses[classes[~inside] - FREQUENT]
                starts = np.cumsum(lengths) - lengths
                n_known, n_once, sum_base, sum_value = (np.add.reduceat(x, starts) for x in (known.astype(np.int64), once[ids].astype(np.int64), base, value))
                # Words that the lookup lacks: a row for each text and word.
                owner, other = np.repeat(np.arange(len(lengths)), lengths)[~known], h[~known]
                order = np.lexsort((other, owner))
                owner, other = owner[order], other[order]
                firsts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])))) if len(owner) else np.zeros(0, dtype=np.int64)
                tf = np.diff(np.append(firsts, len(owner)))
                # Then a row for each text, whose token is no word's; it would not count if it were.
                rows = np.concatenate((owner[firsts], np.arange(len(lengths))))
                doc_ids, hashes = part.column(0).take(pa.array(rows)), part.column(1).to_numpy()[rows]
                tokens = np.concatenate((other[firsts].view(np.int64), hashes[len(firsts) :] ^ np.int64(0x5DEECE66D)))
                mine = pa.StructArray.from_arrays([pa.array(lengths), pa.array(n_known), pa.array(n_once), pa.array(sum_base), pa.array(sum_value)], fields=list(own_type))
                own = pa.concat_arrays([pa.nulls(len(firsts), own_type), mine])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(hashes), pa.array(tokens), pa.array(np.concatenate((tf, np.zeros(len(lengths), dtype=np.int64))).astype(np.int32)), own], names=["doc_id", "text_hash", "token", "tf", "own"])

    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(run, schema)
    c = F.coalesce(F.col("c"), F.lit(0))
    kept = ("n_tokens", "n_known", "n_once", "base", "model")
    sums = (
        rows.join(counts.select(F.col("h").alias("token"), "c"), "token", "left")
        .select("doc_id", "text_hash", (F.col("tf") * F.log10(c + 0.5)).alias("rare_log"), F.when(c > 0, F.col("tf")).otherwise(0).alias("rare_known"), F.when(c == 1, F.col("tf")).otherwise(0).alias("rare_once"), *[F.col(f"own.{k}").alias(k) for k in kept])
        .groupBy("doc_id", "text_hash")
        .agg(F.count("n_tokens").alias("copies"), F.sum("rare_log").alias("rare_log"), F.sum("rare_known").alias("rare_known"), F.sum("rare_once").alias("rare_once"), *[F.max(k).alias(k) for k in kept])
    )
    rare_log = F.col("rare_log") / F.col("copies")
    low = float(np.log10(model.n + 0.5 * (model.v + 1)))
    return sums.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + (F.col("rare_known") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.lit(low)).alias("base_score"),
        (F.col("model") + rare_log).alias("score"),
        (F.col("n_once") + (F.col("rare_once") / F.col("copies")).cast("long")).alias("n_once"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.filter(remainder("doc_id", 5) != 1))
    scored = score(docs, model, counts)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_once")


QUERIES = {"op1_lm_score": op1}
ORACLE_SQL: dict[str, str] = {}
