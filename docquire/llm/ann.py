"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, turned by a rotation learned from a bounded sample (iterative quantisation) and cut to one bit per
dimension. Codes are split into substrings, each indexed by its value. Codes within Hamming radius r differ from the
query's in one of m substrings by at most that substring's share of the radius (shares add up to r - m + 1), so probing
every substring's values within its share finds all of them; those are reranked by cosine on the original floats.

The stated queries meet all vectors in blocks: vectors are dealt into blocks once, a copy of the queries follows to each
block, and a task streams the queries past the index of one block after another. Each block answers with its k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquire.llm.common import ragged, written

#: Vectors in an index block, about, where there are enough of them to keep all cores at work, and at least.
BLOCK, LEAST_BLOCK = 65_536, 4_096


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one: no square of it can
    overflow or vanish then, and no cosine changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """The codes as bytes, padded with zeros to whole 64-bit words."""
        packed = np.packbits((unit - self.mean) @ self.rotation > 0, axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))

    @staticmethod
    def learn(unit: np.ndarray, k: int, aim: float, rounds: int = 30, seed: int = 11) -> Codes:
        """Rotation and the radius that holds `aim` of the true k nearest within the sample (sparser than the whole
        table, so its neighbours lie farther off and the radius errs on the wide side)."""
        rng = np.random.default_rng(seed)
        mean = unit.mean(axis=0)
        _, axes = np.linalg.eigh((unit - mean).T @ (unit - mean))
        flat = (unit - mean) @ axes
        turn = np.linalg.qr(rng.normal(size=axes.shape))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        codes = Codes(mean, axes @ turn, 0)
        packed = codes.encode(unit)
        some = rng.choice(len(unit), min(200, len(unit)), replace=False)
        far = []
        for i in some:
            near = unit @ unit[i]
            near[i] = -np.inf
            best = np.argsort(-near)[: min(k, len(unit) - 1)]
            far += np.bitwise_count(packed[best] ^ packed[i]).sum(axis=1).tolist()
        codes.radius = int(np.quantile(far, aim)) if far else unit.shape[1]
        return codes


class MultiIndex:
    """The codes of a block, indexed by each substring's value; substrings of 8 bits, or of 16 in blocks of 2^14 rows and more."""

    def __init__(self, packed: np.ndarray, dims: int):
        self.words = np.ascontiguousarray(packed).view(np.uint64)
        self.kind, width = (np.uint16, 16) if len(packed) >= 1 << 14 else (np.uint8, 8)
        self.m, self.dims = -(-dims // width), dims
        self.values = np.ascontiguousarray(packed).view(self.kind)[:, : self.m]
        self.order = [np.argsort(self.values[:, j], kind="stable") for j in range(self.m)]
        self.starts = [np.searchsorted(self.values[self.order[j], j], np.arange((1 << width) + 1)) for j in range(self.m)]
        self.weights = np.bitwise_count(np.arange(1 << width, dtype=self.kind))
        self.masks: dict[int, np.ndarray] = {}

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius, by pigeonhole probing."""
        word, value = code.view(np.uint64), code.view(self.kind)
        hit = np.zeros(len(self.words), dtype=bool)
        share, extra = divmod(radius + 1, self.m)
        for j in range(self.m):
            allowed = share - 1 + (j < extra)
            if allowed < 0:
                continue
            if allowed not in self.masks:
                self.masks[allowed] = np.flatnonzero(self.weights <= allowed)
            probes = self.masks[allowed] ^ int(value[j])
            hit[self.order[j][ragged(self.starts[j][probes], self.starts[j][probes + 1])]] = True
        near = np.flatnonzero(hit)
        return near[np.bitwise_count(self.words[near] ^ word).sum(axis=1) <= radius]


class Block:
    """The vectors of a block, in double precision, and their index."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, codes: Codes):
        first = np.lexsort((*v.T[::-1], ids))  # of rows with the same id the smallest vector counts
        first = first[np.r_[True, ids[first][1:] != ids[first][:-1]]] if len(ids) else first
        self.ids, self.v = ids[first], scaled(v[first])
        self.lengths = np.sqrt((self.v**2).sum(axis=1))
        self.codes = codes
        self.index = MultiIndex(codes.encode(self.v / self.lengths[:, None]), v.shape[1])

    def nearest(self, name: int, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, id, score) of the k nearest in the radius, which is widened while it holds fewer than k."""
        q = scaled(q)
        length = np.sqrt((q**2).sum())
        code, radius = self.codes.encode((q / length)[None])[0], self.codes.radius
        while True:
            near = self.index.within(code, radius)
            near = near[self.ids[near] != name]
            if len(near) >= k or radius > self.index.dims:
                break
            radius += 4
        if len(near) > k:  # a fast product to choose from, with room for its rounding
            rough = (self.v[near] @ q) / (self.lengths[near] * length)
            near = near[rough >= np.partition(rough, -k)[-k] - 1e-9]
        score = (self.v[near] * q).sum(axis=1) / (self.lengths[near] * length)  # the same for equal vectors
        return [(name, int(self.ids[near[b]]), float(score[b])) for b in np.lexsort((self.ids[near], -score))[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", sample: int = 20_000, aim: float = 0.97, block: int = BLOCK, least_block: int = LEAST_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by cosine, itself left out, ties to the smaller id.

    The rotation is fitted on about `sample` different vectors chosen by a hash (2 x `sample` at most); every one is indexed. Null and zero
    vectors, those with null or non-finite components and those of another length than most (ties: the longer) take no
    part, nor do rows with a null key. Repeated rows count once; of different vectors under one key the smallest counts,
    as a candidate and as a query. A query with fewer than k candidates in its radius widens it; with fewer than k rows
    in all it gets them all. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{column}`")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col(f"`{key}`").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine).select(F.col(f"`{key}`").cast("long").alias("id"), v.cast("array<double>").alias("v"))

    every = clean(vectors)
    usual = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = usual["d"], usual["count"]
    every = every.where(F.size("v") == dims)
    asked = clean(queries).where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))
    part = every.where(F.pmod(F.xxhash64(F.lit("vectors"), "id", "v"), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20))
    some = part.distinct().limit(2 * sample).orderBy("id", "v").select("v").toArrow().column(0).combine_chunks()
    unit = scaled(some.flatten().to_numpy().reshape(-1, dims)) if len(some) else np.eye(dims)
    codes = spark.sparkContext.broadcast(Codes.learn(unit / np.linalg.norm(unit, axis=1, keepdims=True), k, aim))

    blocks = max(-(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // least_block)))
    held = every.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    sought = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    dealt = held.union(sought).repartition("block").sortWithinPartitions("block", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, parts, now = codes.value, None, [], None
        for batch in batches:
            block_of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, v = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().reshape(-1, dims)
            cuts = [0, *(np.flatnonzero((np.diff(block_of) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for s, e in zip(cuts, cuts[1:]):
                if block_of[s] != now:
                    known, parts, now = None, [], block_of[s]
                if not kind[s]:
                    parts.append((ids[s:e].copy(), v[s:e].copy()))
                    continue
                if parts and known is None:
                    known, parts = Block(*map(np.concatenate, zip(*parts, strict=True)), model), []
                if known:
                    out = [x for i in range(s, e) for x in known.nearest(int(ids[i]), v[i], k)]
                    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate([pa.int64(), pa.int64(), pa.float64()])], names=["query_id", "vec_id", "score"])

    found = written(dealt.mapInArrow(search, "query_id long, vec_id long, score double"), "nearest")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
