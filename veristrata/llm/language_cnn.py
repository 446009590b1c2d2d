"""Language identification with a byte convolutional network.

Bytes are embedded; filters of widths 2, 3 and 4 run over windows of 256 bytes,
are rectified and max-pooled; a softmax gives the languages. Training is Adam
in numpy on the driver, over a bounded sample: about SAMPLE rows of each language
(all, where it has fewer), taken by a hash of the row, and of each row one window,
at a place that a hash of its id gives; the rest of a row's text does not train.
The softmax has a column for each language, so there are as many as a driver may
hold windows of. Inference covers whole texts in windows that overlap by three bytes, and
averages the windows' log-probabilities; there, embedding and filters become
tables by byte pair, so that a position costs two lookups.

Null texts and texts without a letter (of any script; digits, fractions and
circled numbers are none) are `und` with score 0. Without any labelled row, every
text is `und`. Of languages with equal scores the first by name is taken.
Repeated rows get a row each. Empty tables give no rows. Texts of any length are
read whole. Columns beyond doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import pieces, remainder, text_of
from veristrata.session import table

#: Rows of each language to learn from, as expected under the hash threshold.
SAMPLE = 1200
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
DEPTH = 8
EPOCHS = 6
STRIDE = WINDOW - max(WIDTHS) + 1
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def windows(text: bytes) -> int:
    return max(1, -(-(len(text) - max(WIDTHS) + 1) // STRIDE))


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (windows x WINDOW, zero-padded), and how many windows each text has."""
    counts = np.array([windows(t) for t in texts], dtype=np.int64)
    out, k = np.zeros((int(counts.sum()), WINDOW), dtype=np.uint8), 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        x = np.frombuffer(text, dtype=np.uint8)
        padded = np.zeros((n - 1) * STRIDE + WINDOW, dtype=np.uint8)
        padded[: len(x)] = x[: len(padded)]
        out[k : k + n] = np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (STRIDE, 1))
        k += n
    return out, counts


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x DEPTH
    filters: list[np.ndarray]  # by width: (width * DEPTH) x FILTERS
    biases: list[np.ndarray]
    head: np.ndarray  # (3 * FILTERS) x languages
    head_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.head, self.head_bias]


def fit(samples: list[tuple[bytes, str]], seed: int = 7) -> Network | None:
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    rng, n_filters = np.random.default_rng(seed), FILTERS * len(WIDTHS)
    net = Network(
        languages,
        rng.normal(0, 0.3, (256, DEPTH)),
        [rng.normal(0, 1 / np.sqrt(w * DEPTH), (w * DEPTH, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.1, (n_filters, len(languages))),
        np.zeros(len(languages)),
    )
    x = np.zeros((len(samples), WINDOW), dtype=np.uint8)
    for row, (text, _) in zip(x, samples, strict=True):
        part = np.frombuffer(text[:WINDOW], dtype=np.uint8)
        row[: len(part)] = part
    index = {lang: i for i, lang in enumerate(languages)}
    y = np.array([index[lang] for _, lang in samples])
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(order), 64):
            batch = order[s : s + 64]
            gradients = backward(net, x[batch], y[batch])
            step += 1
            for p, g, (m, v) in zip(net.parameters(), gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def backward(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy, in the order of parameters()."""
    embedded, n = net.embedding[x], len(x)
    pooled, best = [], []
    for w, kernel, bias in zip(WIDTHS, net.filters, net.biases, strict=True):
        length = WINDOW - w + 1
        patches = np.concatenate([embedded[:, i : i + length] for i in range(w)], axis=2)
        responses = patches @ kernel + bias
        at = responses.argmax(axis=1)
        best.append(at)
        pooled.append(np.take_along_axis(responses, at[:, None, :], axis=1)[:, 0])
    raw = np.concatenate(pooled, axis=1)
    hidden = np.maximum(raw, 0)
    logits = hidden @ net.head + net.head_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ net.head.T) * (raw > 0)
    d_embedding, d_filters, d_biases = np.zeros_like(net.embedding), [], []
    for k, (w, kernel) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        places = best[k][:, :, None] + np.arange(w)  # rows x FILTERS x w
        read = x[np.arange(n)[:, None, None], places]
        patch = net.embedding[read].reshape(n, FILTERS, w * DEPTH)
        d_filters.append(np.einsum("nfd,nf->df", patch, own))
        d_biases.append(own.sum(axis=0))
        np.add.at(d_embedding, read, np.einsum("nf,df->nfd", own, kernel).reshape(n, FILTERS, w, DEPTH))
    return [d_embedding, *d_filters, *d_biases, hidden.T @ p, p.sum(axis=0)]


class Scorer:
    """The network with its convolutions as tables by byte pair."""

    def __init__(self, net: Network):
        self.net = net
        by_byte = [[net.embedding @ kernel[i * DEPTH : (i + 1) * DEPTH] for i in range(w)] for w, kernel in zip(WIDTHS, net.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.first = np.concatenate([pair(t[0], t[1]) + b for t, b in zip(by_byte, net.biases, strict=True)], axis=1).astype(np.float32)
        nothing = np.zeros((256, FILTERS))
        self.second = np.concatenate([pair(by_byte[1][2], nothing), pair(by_byte[2][2], by_byte[2][3])], axis=1).astype(np.float32)

    def window_logs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window; a position that runs over the end of its window has no response."""
        out = np.empty((len(x), len(self.net.languages)))
        for s in range(0, len(x), 1024):
            part = np.ascontiguousarray(x[s : s + 1024].T).astype(np.int32)
            pairs = (part[:-1] << 8) | part[1:]
            best = np.full((part.shape[1], FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
            for i in range(WINDOW - 3):
                response = self.first[pairs[i]]
                response[:, FILTERS:] += self.second[pairs[i + 2]]
                np.maximum(best, response, out=best)
            i = WINDOW - 3  # widths 2 and 3
            response = self.first[pairs[i]][:, : 2 * FILTERS]
            response[:, FILTERS:] += self.second[part[i + 2] << 8][:, :FILTERS]
            np.maximum(best[:, : 2 * FILTERS], response, out=best[:, : 2 * FILTERS])
            np.maximum(best[:, :FILTERS], self.first[pairs[WINDOW - 2]][:, :FILTERS], out=best[:, :FILTERS])
            logits = np.maximum(best, 0) @ self.net.head + self.net.head_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[s : s + 1024] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def score(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        x, counts = cut_windows(texts)
        logs = np.add.reduceat(self.window_logs(x), np.cumsum(counts) - counts, axis=0) / counts[:, None]
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.net.languages[i] for i in best], p[np.arange(len(best)), best].tolist()


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def train(docs: DataFrame) -> Network | None:
    """docs: doc_id, text, lang of the rows to learn from."""
    usable = docs.filter("text is not null and lang is not null")
    share = usable.groupBy("lang").agg((F.lit(SAMPLE) / F.count("*")).alias("share")).withColumnRenamed("lang", "of")
    h = F.xxhash64("doc_id", F.length("text"), F.lit(17))
    taken = usable.join(F.broadcast(share.filter("share < 1")), F.col("lang") == F.col("of"), "left")  # the softmax bounds the languages
    start = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1
    rows = taken.filter(F.pmod(h, F.lit(1 << 20)) / F.lit(1 << 20) < F.coalesce("share", F.lit(1.0))).select("lang", F.expr("text").substr(start.cast("int"), F.lit(WINDOW)).alias("text"), h.alias("h")).collect()  # SAMPLE windows a language
    samples = sorted(((r["h"], r["text"].encode()[:WINDOW], r["lang"]) for r in rows))
    return fit([(t, lang) for _, t, lang in samples if has_letter(t)])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score: a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else vars(net))  # plain values: workers need no package of ours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            for part in pieces(batch):
                if scorer is None and shared.value is not None:
                    scorer = Scorer(Network(**shared.value))
                texts = [x.as_buffer().to_pybytes() for x in part.column(1)]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                where = [i for i, t in enumerate(texts) if scorer is not None and has_letter(t)]
                if where:
                    for i, lang, score in zip(where, *scorer.score([texts[i] for i in where]), strict=True):
                        langs[i], scores[i] = lang, score
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder("doc_id", 4)
    net = train(docs.select("doc_id", "text", "lang").filter(fold != 2))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_cnn": op8}
ORACLE_SQL: dict[str, str] = {}
