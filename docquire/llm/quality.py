"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in linear time as half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). It is fitted on a bounded sample of labelled rows; the weights have a
fixed size and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquire.llm.common import slices, spread, word_hashes

WORDS = 4096  # slots for hashed words
BINS = 16  # bins of each statistic
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SPACES, _STOPS = b" \t\n\r\x0b\x0c", b".,;:?!'\"-()"
STATISTICS = 12
FEATURES = WORDS + STATISTICS * BINS


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's non-zero features; an empty text has its statistics only."""
    words = text.split()
    hashed = word_hashes([text], ascii_only=False)[0]
    slots = np.zeros(0, dtype=np.int64)
    n = max(1, len(text))
    if len(hashed):
        at = (hashed >> np.uint64(52)).astype(np.int64)  # the top 12 bits: WORDS slots
        times = np.bincount(at, minlength=WORDS)
        slots = np.flatnonzero(times)
        values = np.log1p(times[slots])
        values /= np.sqrt((values**2).sum())
    else:
        values = np.zeros(0)
    lines = text.split(b"\n")
    kept = lambda drop: len(text) - len(text.translate(None, drop))
    upper, lower, digits, spaces, stops = map(kept, (_UPPER, _LOWER, _DIGITS, _SPACES, _STOPS))
    other = sum(c < 128 for c in set(text) - set(_UPPER + _LOWER + _DIGITS + _SPACES + _STOPS))
    symbols = len(text.translate(None, _UPPER + _LOWER + _DIGITS + _SPACES + _STOPS + bytes(range(128, 256))))
    distinct = len(set(words))
    shares = [
        upper / n, digits / n, spaces / n, stops / n, symbols / n, (n - upper - lower - digits - spaces - stops - symbols) / n,
        distinct / max(1, len(words)), len(set(lines)) / len(lines),
        np.log2(n) / 24, np.log2(1 + len(words)) / 20, min(1, n / max(1, len(words)) / 32), min(1, (len(lines) / n) ** 0.5 + other / 64),
    ]
    binned = [WORDS + i * BINS + int(min(BINS - 1, max(0.0, x) ** 0.5 * BINS)) for i, x in enumerate(shares)]
    return np.concatenate([slots, binned]).astype(np.int32), np.concatenate([values, np.full(STATISTICS, 0.3)]).astype(np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.linear[at] @ x) + pairs, -30, 30))))

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        """AdaGrad on the logistic loss; without two classes the score is a constant."""
        rng = np.random.default_rng(seed)
        mean = (labels.sum() + 1) / (len(labels) + 2)
        w0, w, v = float(np.log(mean / (1 - mean))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, rank)).astype(np.float32)
        g0, gw, gv = 1e-6, np.full(FEATURES, 1e-6, np.float32), np.full(v.shape, 1e-6, np.float32)
        if len(set(labels.tolist())) < 2:
            return FactorisationMachine(w0, w, v * 0)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), batch):
                part = order[start : start + batch]
                x = np.zeros((len(part), FEATURES), np.float32)
                for i, r in enumerate(part):
                    x[i, rows[r][0]] = rows[r][1]
                s, x2 = x @ v, x * x
                z = w0 + x @ w + 0.5 * ((s**2).sum(1) - (x2 @ v**2).sum(1))
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)).astype(np.float32)
                dw = x.T @ d + decay * w
                dv = x.T @ (d[:, None] * s) - v * (x2.T @ d)[:, None] + decay * v
                gw += dw**2
                gv += dv**2
                g0 += float(d.sum()) ** 2
                w -= rate * dw / np.sqrt(gw)
                v -= rate * dv / np.sqrt(gv)
                w0 -= rate * float(d.sum()) / g0**0.5
        return FactorisationMachine(w0, w, v)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 12_000) -> FactorisationMachine:
    """Fit on about `sample` labelled rows chosen by a hash of the key (all, where there are fewer), 2 x `sample` at most.

    Null keys and labels take no part; several labels of a key count as their largest; a labelled null text is empty; rows
    that repeat a labelled key all count, unless they are more than the bound: then a hash of key and text chooses among
    them. Whole texts count, however long. Without labels, or with one class only, the score is a constant.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    n = known.count()
    part = known.where(F.pmod(F.xxhash64(F.lit("quality"), "key"), F.lit(1 << 20)) < min(1.0, sample / max(1, n)) * (1 << 20))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).join(part.hint("broadcast"), "key")  # the sample's size is the bound
    found = docs.select(F.col(key).alias("key")).join(part.hint("broadcast"), "key").count()
    if found > 2 * sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("rows"), "key", "text"), F.lit(1 << 20)) < sample / found * (1 << 20)).limit(2 * sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x or b"") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["key", "label", "at", "x"])

    schema = T.StructType([rows.schema["key"], rows.schema["label"], T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())])
    got = rows.mapInArrow(extract, schema).toPandas().sort_values(["key", "label"])
    parsed = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(got["at"], got["x"], strict=True)]
    return FactorisationMachine.fit(parsed, got["label"].to_numpy(dtype=np.float32))


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text") -> DataFrame:
    """Add score and predicted (1 from 0.5 up) to every row from its whole text; null counts as empty. No shuffle.

    Repeated rows get the same score and ties can't arise. Other columns pass through; columns with the new names are
    replaced; an empty table stays empty.
    """
    docs = spread(docs.drop("score", "predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = [known.score(*features((x or "").encode())) for part in slices(batch.column(column)) for x in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
