"""Language identification with bit-sliced Bloom filters.

One Bloom filter per language, stored bit-sliced: each slot holds a bitmask of languages, so two lookups and an AND
return every language that contains an n-gram. A text's n-grams are looked up, hits are counted per language, each
count is corrected for that filter's false positives, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquire.llm.common import mix, slices, spread, written

#: ASCII letters in lower case, bytes of other scripts kept, everything else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text looked at in one go; longer texts go through in overlapping slices, none is cut short.
_SLICE = 1 << 20


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Byte 3-grams and 4-grams of the letters of a text, with spaces between words and at both ends."""
    clean = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", dtype=np.uint8)
    for start in range(0, len(clean), _SLICE):
        b = clean[start : start + _SLICE + 3].astype(np.uint64)
        threes = (b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) if len(b) > 2 else b[:0]
        fours = threes[:-1] | b[3:] << np.uint64(24) if len(b) > 3 else b[:0]
        if start + _SLICE < len(clean):
            threes, fours = threes[:_SLICE], fours[:_SLICE]
        yield np.concatenate([threes, fours | np.uint64(1 << 40)])


@dataclass
class LanguageFilters:
    languages: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)
    false_positive: np.ndarray

    @staticmethod
    def build(by_language: dict[str, np.ndarray], slots_per_gram: int = 16, most_words: int = 1 << 25) -> LanguageFilters:
        """Filters for all languages. Beyond `most_words` words of 64 languages (256 MB) there are fewer slots for a gram
        and more false positives to correct for, not fewer languages or grams."""
        languages = sorted(by_language)
        largest = max((len(g) for g in by_language.values()), default=0)
        words = (len(languages) + 63) // 64
        size = 1 << max(10, min(int(largest * slots_per_gram - 1).bit_length(), (most_words // max(1, words)).bit_length() - 1))
        slots = np.zeros((size, words), dtype=np.uint64)
        filled = []
        for i, lang in enumerate(languages):
            for at in LanguageFilters.places(by_language[lang], size):
                slots[at, i // 64] |= np.uint64(1 << i % 64)
            filled.append(np.count_nonzero(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / size)
        return LanguageFilters(languages, slots, np.array(filled) ** 2)

    @staticmethod
    def places(found: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(found + np.uint64(0x9E3779B97F4A7C15))
        return (h & np.uint64(size - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(size - 1)).astype(np.int64)

    def decide(self, text: bytes) -> tuple[int, float]:
        """Index of the language and its share of all corrected hits (ties: first in alphabetical order)."""
        hits, total = np.zeros(len(self.languages)), 0
        for found in grams(text):
            first, second = self.places(found, len(self.slots))
            masks = self.slots[first] & self.slots[second]
            total += len(found)
            for i in range(len(self.languages)):
                hits[i] += np.count_nonzero(masks[:, i // 64] & np.uint64(1 << i % 64))
        true = np.maximum(0, (hits - total * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive))
        best = int(true.argmax())
        return best, float(true[best] / true.sum()) if true.sum() else 0.0


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 3000, least_share: float = 2e-6, contrast: float = 0.15) -> LanguageFilters:
    """Filters from labelled rows (null texts and languages take no part).

    About `per_language` rows of each language are used, chosen by a hash of the key: all of a rarer language. A gram
    enters a language's filter if its share of that language's grams is at least `least_share` and at least
    `contrast` times its share in the language where it is most common. Every language is learned, however many there are.
    Repeated rows count each time; very long texts go through in slices; an empty table learns nothing.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["count"] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return LanguageFilters.build({})
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20))
    rows = spread(sample.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[np.ndarray]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(name, []).extend(grams(value))
            for name, parts in seen.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    found = written(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    enough = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, max(2.0, least_share * n))]) if totals else F.lit(None)
    shares: dict[str, dict[int, float]] = {}
    for name, part in found.where(F.col("n") >= enough[F.col("lang")]).toPandas().groupby("lang") if totals else ():  # at most 1 / least_share a language
        shares[name] = dict(zip(part["gram"], part["n"] / part["n"].sum(), strict=True))
    most: dict[int, float] = {}
    for part in shares.values():
        for g, x in part.items():
            most[g] = max(x, most.get(g, 0))
    return LanguageFilters.build({name: np.array([g for g, x in part.items() if x >= contrast * most[g]], dtype=np.uint64) for name, part in shares.items()})


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score to every row, from its whole text alone. No shuffle.

    Other columns pass through; columns with the new names are replaced. Ties go to the first language in alphabetical
    order; repeated rows get the same answer; an empty table stays empty.

    `und` with score 0 where the text is null, empty or has no letter, or where no language was learned.
    """
    docs = spread(docs.drop(*names))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs, scores = [], []
            for value in chain.from_iterable(part.to_pylist() for part in slices(batch.column(column))):
                best, score = "und", 0.0
                if value and known.languages and any(map(str.isalpha, value)):
                    at, score = known.decide(value.encode())
                    best = known.languages[at]
                langs.append(best)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
