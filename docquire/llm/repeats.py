"""Suffix-array de-duplication: remove every byte inside a string of `length` bytes that starts anywhere else too.

No machine could hold one suffix array of the corpus, so suffixes are first dealt by content. Every window of `length`
bytes names an anchor, the 64-byte string of least hash inside it; equal windows name equal anchors at equal places.
Windows can thus only be equal within one anchor's bucket:

1. Anchors that occur once are dropped: a map-side-combined minimum and maximum per anchor hash.
2. An occurrence's context is the bytes of all windows that name it. Contexts that occur twice are repeats as a whole.
3. Each other bucket builds an enhanced suffix array of its distinct contexts, from the anchor on. A stack scan over the
   common prefixes gives the tree of common-prefix intervals; an interval is a repeat group with all its occurrences,
   and the text to the left of its members tells how far each repeat extends there (left-extension diversity). A window
   is a repeat if the part right of the anchor fits an interval's prefix and the part left of it is shared by two members.
4. A bucket of too many distinct contexts for one task is split by more of what its windows hold. Windows with the anchor
   at places a to b in them have at least a bytes left of it and all but b right of it, so contexts are dealt again by
   those bytes, for the lower and the upper half of the places, and so on until every bucket fits. At a single place
   the bytes are the whole window, and its bucket is one interval.

Texts are told apart by 64-bit hashes: contexts and whole copies that occur twice are not compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquire.llm.common import batch_slices, bit_filter, discard, group_bounds, groups, in_filter, mix, signed, spread, written

ANCHOR = 64
#: Distinct contexts (of under 2 * length bytes) that one bucket may bring to a task.
BUCKET = 4096
_FILTER_BITS = 1 << 27
_PIECE = 1 << 18  # bytes hashed in one go; longer texts go through in overlapping pieces
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1 << 63, dtype=np.uint64, size=256) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1 << 62, dtype=np.uint64, size=8) * np.uint64(2) + np.uint64(1)
_X = 0x9E3779B97F4A7C15
_SPAN = "array<struct<start:int,end:int>>"


class Anchors:
    """Anchors of buffers of whole texts or pieces of one."""

    def __init__(self, length: int):
        self.length, self.window = length, length - ANCHOR + 1
        if self.window < 1:
            raise ValueError(f"length must be at least {ANCHOR}")
        size = 2 * _PIECE + 2 * length
        self.power = np.ones(size, dtype=np.uint64)
        self.power[1:] = np.multiply.accumulate(np.full(size - 1, _X, dtype=np.uint64))
        self.inverse = np.ones(size, dtype=np.uint64)
        self.inverse[1:] = np.multiply.accumulate(np.full(size - 1, pow(_X, -1, 1 << 64), dtype=np.uint64))

    def pieces(self, texts: list[bytes | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """(buffer, text numbers, their starts in the buffer, their offsets in the text); only texts with windows."""
        held, size = [], 0
        for i, text in enumerate(texts):
            if text is None or len(text) < self.length:
                continue
            for at in range(0, len(text) - self.length + 1, _PIECE):
                piece = text[at : at + _PIECE + self.length - 1]
                if size + len(piece) > 2 * _PIECE:
                    yield self._joined(held)
                    held, size = [], 0
                held.append((i, at, piece))
                size += len(piece)
        if held:
            yield self._joined(held)

    @staticmethod
    def _joined(held: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(h[2]) for h in held)])
        return b"".join(h[2] for h in held), np.array([h[0] for h in held]), starts, np.array([h[1] for h in held])

    def find(self, texts: list[bytes | None], contexts: bool) -> Iterator[dict]:
        """For every run of windows that name the same anchor: text number, anchor, first and last window start (in the
        text), anchor hash, and with `contexts` the hash of the context and where its bytes are."""
        for buffer, numbers, starts, offsets in self.pieces(texts):
            raw = np.frombuffer(buffer, dtype=np.uint8)
            h = _BYTE[raw]
            step = 1
            for c in _STEP:
                if step == ANCHOR:
                    break
                h = h[:-step] * c + h[step:]
                step *= 2
            h = mix(h)
            least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while span * 2 <= self.window:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < self.window:
                least = np.minimum(least[: len(least) - (self.window - span)], least[self.window - span :])
            named = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
            text = np.repeat(np.arange(len(numbers)), np.diff(starts))[: len(named)]
            at = np.flatnonzero(np.arange(len(named)) + self.length <= starts[text + 1])
            anchor, owner = named[at], text[at]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
            first = np.flatnonzero(new)
            lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
            anchor, owner = anchor[first], owner[first]
            base = starts[owner] - offsets[owner]
            found = {"number": numbers[owner], "anchor": anchor - base, "lo": lo - base, "hi": hi - base, "h": h[anchor], "raw": buffer, "from": lo, "to": hi + self.length}
            if contexts:
                total = np.zeros(len(raw) + 1, dtype=np.uint64)
                np.cumsum(_BYTE[raw] * self.power[: len(raw)], out=total[1:])
                body = (total[hi + self.length] - total[lo]) * self.inverse[lo]
                found["c"] = mix(body + mix(found["h"] + (anchor - lo).astype(np.uint64) * _STEP[0] + (hi - lo).astype(np.uint64) * _STEP[1]))
            yield found


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differs.bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each common-prefix interval; prefixes[i] is what sorted suffixes i and i + 1 share.

    Suffixes that share nothing form none; an interval comes before the intervals that contain it.
    """
    stack = [(0, 0)]
    for i, common in enumerate([*prefixes, 0]):
        start = i
        while stack[-1][0] > common:
            length, start = stack.pop()
            yield length, start, i
        if stack[-1][0] < common:
            stack.append((common, start))


def repeated_windows(contexts: list[tuple[bytes, int]], length: int, low: int = 0, high: int | None = None) -> list[list[tuple[int, int]]]:
    """For each (bytes, anchor place) of a bucket of distinct contexts: ranges of window starts that another shares, of
    windows with the anchor at places `low` to `high` in them."""
    high = length if high is None else high
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][0][contexts[i][1] :])
    right = [contexts[i][0][contexts[i][1] :] for i in order]
    left = [contexts[i][0][: contexts[i][1]][::-1] for i in order]
    rank = {m: r for r, m in enumerate(sorted(range(len(order)), key=left.__getitem__))}
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for size, first, last in intervals([_common(a, b) for a, b in zip(right, right[1:])]):
        least = max(0, length - size)
        members = sorted(range(first, last + 1), key=rank.__getitem__)
        shared = [_common(left[a], left[b]) for a, b in zip(members, members[1:])]
        for j, m in enumerate(members):
            most = max(shared[j - 1] if j else -1, shared[j] if j < len(shared) else -1)
            if most >= least:
                text, place = contexts[order[m]]
                a, b = max(0, place - most, place - high), min(place - least, place - low, len(text) - length)
                if a <= b:
                    found[order[m]].append((a, b))
    return [merge_ranges(f) for f in found]


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed ranges of whole numbers, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _bucket_ranges(bodies: DataFrame, length: int, bucket: int) -> DataFrame:
    """c, ranges: window starts of each context (h, c, place, bytes) that another context of its bucket shares."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["k"]):
            c, place, body, low, high = (part.column(n).to_pylist() for n in ("c", "place", "bytes", "low", "high"))
            bounds = group_bounds(part, ["k"]).tolist()
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                out += repeated_windows([(body[i], place[i]) for i in range(s, e)], length, low[s], high[s])
            got = [[{"start": a, "end": b} for a, b in o] for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(got, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["c", "ranges"])

    room = length - ANCHOR
    dealt = bodies.select("h", "c", "place", "bytes", F.lit(0).alias("low"), F.lit(room).alias("high"), F.col("h").alias("k"), "m")
    found = None
    while True:
        usual = dealt.where(F.col("m") <= bucket).select("k", "c", "place", "bytes", "low", "high").repartition("k").sortWithinPartitions("k")
        ranges = usual.mapInArrow(scan, f"c long, ranges {_SPAN}").where(F.size("ranges") > 0)
        found = ranges if found is None else found.union(ranges)
        large = dealt.where(F.col("m") > bucket)
        if large.isEmpty():
            return found
        single = F.array(F.struct((F.col("place") - F.col("low")).alias("start"), (F.col("place") - F.col("low")).alias("end")))
        found = found.union(large.where("low = high").select("c", single.alias("ranges")))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high"))).alias("half")
        split = large.where("low < high").select("h", "c", "place", "bytes", halves).select("h", "c", "place", "bytes", "half.*")
        right = ANCHOR + room - F.col("high")
        split = split.where((F.col("place") >= F.col("low")) & (F.octet_length("bytes") - F.col("place") >= right))
        keyed = split.withColumn("k", F.xxhash64("h", "low", "high", F.expr(f"substring(bytes, place - low + 1, low + {ANCHOR + room} - high)")))
        keyed = written(keyed, "split")
        counts = written(keyed.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), "counts")
        dealt = written(keyed.join(counts.hint("merge"), "k").select("h", "c", "place", "bytes", "low", "high", "k", "m"), "open")


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Add n_bytes, n_removed, spans (maximal removed runs of bytes) and kept (the remaining bytes) to every row.

    Null or empty text has no bytes. Texts of fewer than `length` bytes lose nothing. Repeated rows are separate
    documents, so both lose all windows they have. Other columns pass through but the text itself; columns with the
    new names or named text_key are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_removed", "spans", "kept", "text_key")]
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    kinds = [docs.schema[c] for c in rest]
    docs = spread(docs.select(*[F.col(f"`{c}`").alias(f"rest{i}") for i, c in enumerate(rest)], raw.alias("text"), F.xxhash64(raw).alias("text_key")))
    source = docs.select("text_key", "text")

    def occurrence(batch: pa.RecordBatch, found: dict) -> np.ndarray:
        key = batch.column(0).to_numpy().view(np.uint64)[found["number"]]
        return mix(key + found["anchor"].astype(np.uint64) * _STEP[2])

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batch_slices(batches):
            for found in anchors.find(batch.column(1).to_pylist(), False):
                yield pa.RecordBatch.from_arrays([pa.array(signed(found["h"])), pa.array(signed(occurrence(batch, found)))], names=["h", "id"])

    twice = source.mapInArrow(survey, "h long, id long").groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("h")
    repeated = spark.sparkContext.broadcast(bit_filter(twice, "h", _FILTER_BITS))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, allowed = Anchors(length), repeated.value
        for batch in batch_slices(batches):
            keys = batch.column(0).to_numpy()
            for found in anchors.find(batch.column(1).to_pylist(), True):
                on = in_filter(allowed, found["h"])
                columns = [signed(found["h"]), signed(found["c"]), signed(occurrence(batch, found)), keys[found["number"]], found["lo"].astype(np.int32), found["hi"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in columns], names=["h", "c", "id", "text_key", "lo", "hi"])

    rows = written(source.mapInArrow(occurrences, "h long, c long, id long, text_key long, lo int, hi int"), "occurrences")
    contexts = written(rows.groupBy("c").agg(F.first("h").alias("h"), (F.min("id") != F.max("id")).alias("whole"), F.max(F.col("hi") - F.col("lo")).alias("last")), "contexts")
    buckets = written(contexts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "buckets")  # so the join can split a common anchor
    open_contexts = written(contexts.join(buckets.hint("merge"), "h").select("c", "m"), "open")
    wanted = spark.sparkContext.broadcast(bit_filter(open_contexts, "c", _FILTER_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, allowed = Anchors(length), wanted.value
        for batch in batch_slices(batches):
            for found in anchors.find(batch.column(1).to_pylist(), True):
                on = np.flatnonzero(in_filter(allowed, found["c"]))
                parts = [found["raw"][a:b] for a, b in zip(found["from"][on].tolist(), found["to"][on].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(found["h"][on])), pa.array(signed(found["c"][on])), pa.array((found["anchor"] - found["lo"])[on].astype(np.int32)), pa.array(parts, pa.binary())], names=["h", "c", "place", "bytes"])

    fetched = source.mapInArrow(fetch, "h long, c long, place int, bytes binary").groupBy("c").agg(F.first("h").alias("h"), F.first("place").alias("place"), F.first("bytes").alias("bytes"))
    bodies = written(fetched.join(open_contexts.hint("merge"), "c"), "bodies")

    ranges = _bucket_ranges(bodies, length, bucket)
    whole = contexts.where("whole").select("c", F.array(F.struct(F.lit(0).alias("start"), F.col("last").alias("end"))).alias("ranges"))
    covered = rows.select("c", "text_key", "lo").join(whole.union(ranges).hint("merge"), "c").select("text_key", "lo", F.explode("ranges").alias("r"))
    spans = covered.select("text_key", (F.col("lo") + F.col("r.start")).alias("start"), (F.col("lo") + F.col("r.end") + length).alias("end"))
    copies = docs.groupBy("text_key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("end")).where(F.col("n") > 1).where(F.col("end") >= length)
    spans = spans.union(copies.select("text_key", F.lit(0).alias("start"), "end"))
    per_text = written(spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans", free=True)
    discard(rows, contexts, buckets, open_contexts, bodies)
    joined = docs.join(per_text.hint("merge"), "text_key", "left").drop("text_key")
    at_text, at_found = len(rest), len(rest) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            n, removed, kept, runs = [], [], [], []
            for body, found in zip(batch.column(at_text).to_pylist(), batch.column(at_found).to_pylist(), strict=True):
                merged = merge_ranges([(f["start"], f["end"] - 1) for f in found or []])
                n.append(len(body))
                removed.append(sum(b - a + 1 for a, b in merged))
                at = [0, *(x for a, b in merged for x in (a, b + 1)), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
                runs.append([{"start": a, "end": b + 1} for a, b in merged])
            own = [batch.column(i) for i in range(len(rest))]
            new = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*rest, "n_bytes", "n_removed", "spans", "kept"])

    schema = T.StructType([*kinds, *T.StructType.fromDDL(f"n_bytes long, n_removed long, spans {_SPAN}, kept binary").fields])
    return joined.mapInArrow(cut, schema)
