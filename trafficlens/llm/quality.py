"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: each hashed lower-cased word with weight log(1 + count), the whole scaled to
unit length; statistics of its structure (shares of capitals, digits, marks, repeated words and
lines, word and line lengths) and its size as metadata, standardised on the sample. The score is

    sigmoid(b + sum w_i x_i + 1/2 * sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2])

so the pairwise interactions cost time linear in the features. Weights are fitted by Adam on a
bounded sample of labelled rows (``PER_LABEL`` of each label at most, by hash); labels weigh the same in total, and the intercept is set back to the real
share of labels at the end, so that the score is a probability. Scoring reads every whole text.

Defined cases: a null or empty text has no words and statistics 0, and is scored like any other;
null labels are no training rows; without training rows every score is 0.5, with a single label it
is that label. Rows that repeat are scored each by itself, an id of several texts is learnt by the one
of least hash. Very long texts are read whole; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import keep
from .language import remainder, sample_by_label
from .words import Words, as_bytes, runs

BUCKETS = 1 << 14
RANK = 8
PER_LABEL = 2500
EPOCHS = 14
STEP = 1 << 20
STATISTICS = 14


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the hashed words and a rows x STATISTICS matrix."""
    n = len(at) - 1
    w = Words(data, at, lower=True)
    key, back, count = np.unique(
        w.text.astype(np.uint64) << np.uint64(32) | w.hash() >> np.uint64(32), return_inverse=True, return_counts=True
    ) if len(w) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = (key >> np.uint64(32)).astype(np.int64)
    bucket = (key & np.uint64(BUCKETS - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, minlength=n))
    value = value / np.maximum(norm[row], 1e-12)

    size = np.diff(at).astype(float)
    size1 = np.maximum(size, 1)
    words = np.maximum(w.per_text, 1)
    share = lambda mask: _sums(mask, at) / size1
    capital = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~capital & ~digit & ~((data >= 97) & (data <= 122))
    stop = np.isin(data, (46, 44))  # full stops and commas
    line = data == 10
    lengths = (w.end - w.begin).astype(float)
    marked = mark[w.end - 1] & ~stop[w.end - 1] if len(w) else np.zeros(0, bool)
    alone = marked & (lengths == 1)
    big = capital[w.begin] & (lengths > 1) & capital[np.minimum(w.begin + 1, len(data) - 1)] if len(w) else np.zeros(0, bool)
    per = lambda mask: np.bincount(w.text, mask, minlength=n) / words
    statistics = np.stack(
        [
            np.log1p(size),
            np.log1p(w.per_text),
            share(capital),
            share(digit),
            share(mark & ~stop),
            share(stop) * 10,
            share(line) * 10,
            share(data >= 128),
            per(lengths),
            np.sqrt(np.maximum(per(lengths**2) - per(lengths) ** 2, 0)),
            per(marked),
            per(alone),
            per(big),
            np.bincount(row, minlength=n) / words,
        ],
        axis=1,
    )
    return row, bucket, value, statistics


def feature_batches(column) -> Iterator[tuple[int, int, tuple]]:
    data, at = as_bytes(column)
    for i, j in runs(at, STEP):
        yield i, j, features(data[at[i] : at[j]], at[i : j + 1] - at[i])


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # buckets + statistics
    factor: np.ndarray  # (buckets + statistics) x rank
    mean: np.ndarray
    spread: np.ndarray

    def margin(self, row, bucket, value, statistics) -> np.ndarray:
        n = len(statistics)
        z = np.clip((statistics - self.mean) / self.spread, -4, 4)
        s = BUCKETS
        out = self.bias + np.bincount(row, self.weight[bucket] * value, minlength=n) + z @ self.weight[s:]
        for f in range(self.factor.shape[1]):
            vx = self.factor[bucket, f] * value
            total = np.bincount(row, vx, minlength=n) + z @ self.factor[s:, f]
            squares = np.bincount(row, vx**2, minlength=n) + (z**2) @ self.factor[s:, f] ** 2
            out += 0.5 * (total**2 - squares)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_arrays(row, bucket, value, statistics, label, rank=RANK, epochs=EPOCHS, seed=7, rate=0.02, decay=1e-4) -> Model:
    """Adam on mini-batches of the logistic loss, both labels weighing the same in total."""
    n, dim = len(label), BUCKETS + STATISTICS
    rng = np.random.default_rng(seed)
    mean, spread = statistics.mean(axis=0), statistics.std(axis=0) + 1e-6
    z = np.clip((statistics - mean) / spread, -4, 4)
    share = label.mean()
    if share in (0.0, 1.0):
        return Model(20.0 if share else -20.0, np.zeros(dim), np.zeros((dim, rank)), mean, spread)
    cost = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    theta = np.hstack([np.zeros((dim, 1)), rng.normal(0, 0.02, (dim, rank))])
    bias = 0.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    first = np.searchsorted(row, np.arange(n + 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            pick = order[lo : lo + 256]
            span = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            r = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
            b, x, s = bucket[span], value[span], z[pick]
            vx = theta[b, 1:] * x[:, None]
            total = np.zeros((len(pick), rank))
            np.add.at(total, r, vx)
            total += s @ theta[BUCKETS:, 1:]
            squares = np.bincount(r, (vx**2).sum(axis=1), minlength=len(pick)) + (s**2) @ (theta[BUCKETS:, 1:] ** 2).sum(axis=1)
            margin = bias + np.bincount(r, theta[b, 0] * x, minlength=len(pick)) + s @ theta[BUCKETS:, 0] + 0.5 * ((total**2).sum(axis=1) - squares)
            g = (_sigmoid(margin) - label[pick]) * cost[pick] / len(pick)
            grad = decay * theta
            np.add.at(grad, b, np.hstack([(g[r] * x)[:, None], g[r][:, None] * (x[:, None] * total[r] - vx * x[:, None])]))
            grad[BUCKETS:, 0] += s.T @ g
            grad[BUCKETS:, 1:] += s.T @ (g[:, None] * total) - theta[BUCKETS:, 1:] * ((s**2).T @ g)[:, None]
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            bias -= rate * 5 * g.sum()
    return Model(bias, theta[:, 0], theta[:, 1:], mean, spread)


def fit(rows: DataFrame, shares: dict[int, int]) -> Model:
    """Learn from a bounded sample of (text, label) rows; ``shares`` counts all labels of the table."""

    def featurise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            labels = batch.column("label")
            for i, j, (row, bucket, value, statistics) in feature_batches(batch.column("text")):
                first = np.searchsorted(row, np.arange(j - i + 1))
                words = [
                    (bucket[a:b].astype(np.uint16).tobytes(), value[a:b].astype(np.float32).tobytes())
                    for a, b in zip(first[:-1], first[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        labels.slice(i, j - i),
                        pa.array([w[0] for w in words], pa.binary()),
                        pa.array([w[1] for w in words], pa.binary()),
                        pa.array([s.tobytes() for s in statistics], pa.binary()),
                    ],
                    names=["label", "bucket", "value", "statistics"],
                )

    sample = rows.select("text", "label").mapInArrow(featurise, "label int, bucket binary, value binary, statistics binary")
    found = sorted(sample.collect())
    if not found:
        dim = BUCKETS + STATISTICS
        return Model(0.0, np.zeros(dim), np.zeros((dim, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS))
    label = np.array([r["label"] for r in found])
    bucket = [np.frombuffer(r["bucket"], np.uint16) for r in found]
    row = np.repeat(np.arange(len(found)), [len(b) for b in bucket])
    value = np.concatenate([np.frombuffer(r["value"], np.float32) for r in found]).astype(float)
    statistics = np.stack([np.frombuffer(r["statistics"], float) for r in found])
    model = fit_arrays(row, np.concatenate(bucket).astype(np.int64), value, statistics, label)
    if len(shares) == 2:
        model.bias += float(np.log(shares[1] / shares[0]))
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``score``, the probability of label 1, to rows that have a text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = np.zeros(batch.num_rows)
            for i, j, parts in feature_batches(batch.column("text")):
                out[i:j] = _sigmoid(model.margin(*parts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(batches, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, fold: int = 2, folds: int = 4, least: float = 0.7, per_label: int = PER_LABEL
) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from the labels of the other folds, scores all."""
    held = remainder(F.col("doc_id"), folds) == fold
    known = labels.select("doc_id", F.col("quality").alias("label")).filter(~held & F.col("label").isNotNull())
    known = known.filter("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # the ids are sampled before the texts are joined: a few thousand rows, of a size Spark knows
    picked = keep(sample_by_label(known, "label", per_label), "labelled")
    # an id that stands for several texts is learnt by the one of least hash, so that reruns agree
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(one, F.max("label").alias("label"))
    found = score(docs.select("doc_id", held.alias("held_out"), "text"), fit(rows, shares))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
