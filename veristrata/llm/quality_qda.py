"""Quality classifier: regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics (logs of sizes, shares of
kinds of characters, repetition of words and lines). The class means and
covariances come from sums of the vectors and of their products over all
labelled training rows; covariances are shrunk towards the pooled one and then
towards its diagonal, and their Cholesky factors are kept. The score is the
posterior probability of label 1 from the difference of the log-densities.

Null and empty texts have the vector of an empty text, and a score as any
other. Rows with a null doc_id have no label and are scored. Repeated doc_ids
train once per (row, label) pair. Texts of any length are read whole; empty tables
give no rows. `keep_good` keeps all columns, whatever their names, and scores
equal texts alike. Without labels of both classes, every score
is the share of label 1, or 0.5 if there is no label at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import pieces, remainder, text_of
from veristrata.session import cut, table

#: Shrinkage: share of the pooled covariance, share of its diagonal, and a ridge.
POOL, DIAGONAL, RIDGE = 0.15, 0.1, 1e-3
THRESHOLD = 0.3

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "punctuation", "marks", "pipes", "space", "lines", "line_repeats", "word_repeats", "word_pair_repeats", "bursts")
UPPER, DIGIT, SYMBOL, PUNCTUATION, SPACE, PIPE, BANG = 1, 2, 3, 4, 5, 6, 7


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[ord("A") : ord("Z") + 1] = UPPER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    for c in b"#$%&*@^~<>{}[]\\=_/+`":
        kinds[c] = SYMBOL
    for c in b".,;:?'\"()-":
        kinds[c] = PUNCTUATION
    for c in b" \t\n\r\x0b\x0c":
        kinds[c] = SPACE
    kinds[ord("|")], kinds[ord("!")] = PIPE, BANG
    return kinds


KINDS = _kinds()


def statistics(texts: list[bytes]) -> np.ndarray:
    """Texts x FEATURES; whole texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        n = len(text)
        tally = np.bincount(KINDS[np.frombuffer(text, dtype=np.uint8)], minlength=8) if n else np.zeros(8)
        tokens, lines = text.split(), [x for x in text.split(b"\n") if x]
        w, unique = len(tokens), len(set(tokens))
        pairs = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
        share = tally / max(n, 1)
        row[:] = (
            np.log1p(n),
            np.log1p(w),
            np.log1p((n - tally[SPACE]) / max(w, 1)),
            np.sqrt(share[UPPER]),
            np.sqrt(share[DIGIT]),
            np.sqrt(share[SYMBOL]),
            np.sqrt(share[PUNCTUATION]),
            np.sqrt(share[BANG]),
            np.sqrt(share[PIPE]),
            share[SPACE],
            np.log1p(len(lines)) - np.log1p(w) * 0.5,
            np.sqrt(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0,
            np.log1p(w) * 0.5 - np.log1p(unique) * 0.5,
            np.sqrt(pairs / max(w - 1, 1)),
            np.log1p(max(map(len, tokens), default=0)),
        )
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its vector, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                values = statistics([x.as_buffer().to_pybytes() for x in part.column(1)])
                flat = pa.array(values.ravel())
                offsets = pa.array(np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    prior: float
    means: np.ndarray | None = None
    inverse_factors: np.ndarray | None = None  # of the Cholesky factors, transposed
    log_determinants: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse_factors[k]
            density.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.log_determinants[k])
        odds = density[1] - density[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(np.clip(-odds, -500, 500)))


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """From all labelled vectors: sums of fixed size reach the driver."""
    d = len(FEATURES)
    rows = vectors.join(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)"), "doc_id").select("quality", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if not len(batch):
                continue
            quality, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[quality == k]
                held[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        flat = held.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "s"])

    total = np.zeros(2 * (1 + d + d * d))
    for row in rows.mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[row["i"]] = row["s"]
    total = total.reshape(2, -1)
    n = total[:, 0]
    if not n.all():
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 1 : 1 + d] / n[:, None]
    scatter = total[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factors, determinants = [], []
    for k in (0, 1):
        own = (1 - POOL) * scatter[k] / n[k] + POOL * pooled
        own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(factor).T)
        determinants.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(float(n[1] / n.sum()), means, np.array(factors), np.array(determinants))


def predict(vectors: DataFrame, model: Discriminant) -> DataFrame:
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return vectors.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, training=None) -> DataFrame:
    """doc_id, score, predicted; `training` is a condition on doc_id for the rows to learn from."""
    vectors = cut(features(docs))
    model = fit(vectors if training is None else vectors.filter(training), labels)
    return predict(vectors, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1; all labelled rows of docs train.

    The vectors are read again from the texts, so no text is shuffled.
    """
    model = fit(features(docs), labels)
    d, own = len(FEATURES), "text_"
    while own.lower() in {c.lower() for c in docs.columns}:
        own += "_"
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, own):
                x = statistics([t.as_buffer().to_pybytes() for t in part.column(own)])
                yield part.select(columns).filter(pa.array(model.score(x.reshape(-1, d)) >= THRESHOLD))

    return docs.select("*", text_of().cast("binary").alias(own)).mapInArrow(run, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 5)
    scored = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), fold != 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_qda": op6}
ORACLE_SQL: dict[str, str] = {}
