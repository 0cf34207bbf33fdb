"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every run of `span - k + 1` consecutive k-grams. Equal spans of `span`
words keep the same fingerprint, so joining fingerprints finds every shared span; each match is then extended word by
word, and counts if the shared run is `span` words long. Items shorter than `span` are looked up whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquire.llm.common import ascii_words, bit_filter, gram_hashes, in_filter, portions, row_hash, signed, spread, winnow, word_hashes, written

#: Benchmark fingerprints up to this many go to every task (about 100 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Bits of the filter that spares most fingerprints the shuffle: fixed, so it never follows the benchmark's size.
_BITS = 1 << 24
_ROWS = "row_key long, kind int, h long, pos int, words array<binary>, before int, n_words long"


def _fingerprints(texts: list[bytes | None], span: int, k: int, lengths: list[int]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(words per text, [(kind, text numbers, word positions, hashes)]): kind 0 are winnowed k-grams of texts of `span`
    words or more, kind n > 0 are all n-grams, for items of n words."""
    words, bounds = word_hashes(texts, ascii_only=True)
    counts, out = np.diff(bounds), []
    for kind in (0, *lengths):
        found, at = gram_hashes(words, bounds, kind or k)
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        chosen = np.arange(len(found)) if kind else winnow(found, at, span - k + 1)
        if not kind:
            chosen = chosen[counts[owner[chosen]] >= span]
        out.append((kind, owner[chosen], chosen - at[owner[chosen]], found[chosen]))
    return counts, out


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(summary, hits). summary: the documents' columns but the text, with n_words, n_hit, n_items, item_ids (sorted as
    strings) and contaminated. hits: row_key, item_id, start, end for every shared run of words.

    Null, empty and wordless texts have no words and no windows. An item of fewer than `span` words is one window.
    Repeated documents are counted one by one, repeated items once per item_id; an item whose id is null still hits,
    as the empty id. Rows are matched by a hash of all their columns, so equal doc_ids don't mix. Other columns pass
    through, but those named like the new ones or row_key are replaced. Without documents both tables are empty.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (text, "n_words", "n_hit", "n_items", "item_ids", "contaminated", "row_key")]
    short = items.select(F.col(item_text).cast("binary").alias("text"), F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"))

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = ascii_words(value)
                for kind, _, at, found in _fingerprints([value], span, k, [len(words)] if 0 < len(words) < span else [])[1]:
                    size = kind or k
                    rows += [(name, kind, h, words[max(0, p + size - span) : p + span], min(p, span - size)) for p, h in zip(at.tolist(), signed(found).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.int32()])], names=["item_id", "kind", "h", "item_words", "item_before"])

    known = written(short.mapInArrow(item_rows, "item_id string, kind int, h long, item_words array<binary>, item_before int"), "benchmark")
    n_known = known.count()
    lengths = sorted(r["kind"] for r in known.where("kind > 0").select("kind").distinct().collect())  # fewer than `span`
    shared = spark.sparkContext.broadcast(bit_filter(known, "h", _BITS))

    source = spread(docs.select(row_hash(docs).alias("row_key"), F.col(f"`{text}`").cast("binary").alias("text")))

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = shared.value
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.int32(), pa.int64()]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in portions(len(t or b"") for t in texts):
                counts, found = _fingerprints(texts[a:b], span, k, lengths)
                rows = [(key, -1, 0, 0, None, 0, n) for key, n in zip(keys[a:b], counts.tolist(), strict=True)]
                known_words = {}
                for kind, owner, at, hashes in found:
                    hit = in_filter(filter_bits, hashes)
                    size = kind or k
                    for i, p, h in zip(owner[hit].tolist(), at[hit].tolist(), signed(hashes[hit]).tolist(), strict=True):
                        if i not in known_words:
                            known_words[i] = ascii_words(texts[a + i])
                        rows.append((keys[a + i], kind, h, p, known_words[i][max(0, p + size - span) : p + span], min(p, span - size), 0))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["row_key", "kind", "h", "pos", "words", "before", "n_words"])

    scanned = written(source.mapInArrow(doc_rows, _ROWS), "scanned")
    side = known.hint("broadcast") if n_known <= broadcast_rows else known.hint("merge")
    matched = scanned.where("kind >= 0").drop("n_words").join(side, ["kind", "h"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pydict()
            out = []
            for key, kind, pos, a, i, name, b, j in zip(*(got[c] for c in ("row_key", "kind", "pos", "words", "before", "item_id", "item_words", "item_before")), strict=True):
                size, left = kind or k, 0
                if a[i : i + size] != b[j : j + size]:
                    continue
                if kind:
                    out.append((key, name, pos, pos + size))
                    continue
                while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
                    left += 1
                while size < min(len(a) - i, len(b) - j) and a[i + size] == b[j + size]:
                    size += 1
                if left + size >= span:
                    out.append((key, name, pos - left, pos + size))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate([pa.int64(), pa.string(), pa.int32(), pa.int32()])], names=["row_key", "item_id", "start", "end"])

    hits = written(matched.mapInArrow(extend, "row_key long, item_id string, start int, end int").distinct(), "hits")
    runs = hits.select("row_key", "start", "end").distinct()
    before = Window.partitionBy("row_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = runs.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    counted = fresh.groupBy("row_key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    named = hits.groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    per_row = scanned.where("kind = -1").groupBy("row_key").agg(F.max("n_words").alias("n_words")).join(counted.hint("merge"), "row_key", "left").join(named.hint("merge"), "row_key", "left")
    identity = docs.select(row_hash(docs).alias("row_key"), *[F.col(f"`{c}`") for c in rest])
    summary = identity.join(per_row.hint("merge"), "row_key").select(
        "row_key", *[f"`{c}`" for c in rest], "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
    return summary, hits
