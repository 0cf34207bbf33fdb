"""Byte-level byte-pair encoding: token counts, encoding and decoding.

Counting merges pairs on a linked list with a heap and emits no ids: a pre-token's count is its number of first symbols
less its number of merges. Encoding resolves whole pre-tokens through a minimal perfect hash
over the vocabulary and merges the others over linked bytes. Vocabularies are read once on the driver from the given
path and broadcast; their size is fixed by the file and does not follow the data.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquire.llm.common import slices, spread

#: Pre-token pattern of the 50k byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes (by estimate) that a Python worker keeps of chunks it has met.
STORE_BYTES = 160 << 20
_SAFE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
_SPACE_BETWEEN = regex.compile(r"\s \s|\s \Z")


def chunks(text: str) -> list[str]:
    """Cut at single spaces between visible characters, where a pre-token of PATTERN always starts.

    A pre-token takes at most one leading space, so the cuts never change how either side is split; each later chunk
    keeps its space in front.
    """
    parts = text.split(" ")
    if "" in parts or _SPACE_BETWEEN.search(text):
        parts = _SAFE_SPACE.split(text)
    return [parts[0], *map(" ".__add__, parts[1:])] if len(parts) > 1 else parts


def cutter(pattern: str):
    """How texts are cut into chunks that are looked up whole: other patterns than PATTERN get the whole text."""
    return chunks if pattern == PATTERN else lambda text: [text]


class Store(dict):
    """What chunks of up to 64 characters have come to, in two generations of half the store's bytes each.

    When the younger one is full it becomes the older one, and what is asked for again moves back: frequent chunks stay.
    """

    def __init__(self, size: int = STORE_BYTES):
        self.older: dict = {}
        self.half = self.room = size // 2

    def known(self, chunk: str):
        found = self.older.get(chunk)
        return None if found is None else self.keep(chunk, found, 4)

    def keep(self, chunk: str, value, size: int = 0):
        if len(chunk) <= 64:
            self.room -= 240 + len(chunk) + 8 * size
            if self.room < 0:
                self.older = dict(self)
                self.clear()
                self.room = self.half
            self[chunk] = value
        return value


_worker: dict = {}


def _once(name: tuple, make):
    """Tables and stores that a Python worker builds once and keeps from task to task; their sizes are bounded."""
    if name not in _worker:
        _worker[name] = make()
    return _worker[name]


def merge_pairs(symbols: list[int], rank_of, shift: int, base: int) -> int:
    """Merge the lowest-ranked adjacent pair of symbols, the leftmost of several, until none has a rank.

    rank_of gives the rank of a pair packed as left << shift | right; the merged symbol is rank + base. Symbols stay at
    their places in a linked list, merged ones at their left end (the other place is set to -1). A heap holds a pair as
    rank and left place in one integer, which counts only while the pair that stands there has that rank. Returns the
    number of merges.
    """
    n, done = len(symbols), 0
    push, pop = heapq.heappush, heapq.heappop
    heap = [r * n + i for i in range(n - 1) if (r := rank_of(symbols[i] << shift | symbols[i + 1])) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    symbols.append(-1)  # stands beyond either end: a pair with it, or with a merged place, packs to a negative number
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while heap:
        entry = pop(heap)
        left = entry % n
        right = after[left]
        rank = rank_of(symbols[left] << shift | symbols[right])
        if rank is None or rank * n + left != entry:
            continue
        done += 1
        merged = symbols[left] = rank + base
        symbols[right] = -1
        end = after[left] = after[right]
        before[end] = left
        if (rank := rank_of(merged << shift | symbols[end])) is not None:
            push(heap, rank * n + left)
        previous = before[left]
        if (rank := rank_of(symbols[previous] << shift | merged)) is not None:
            push(heap, rank * n + previous)
    symbols.pop()
    return done


# --- counting -------------------------------------------------------------------------------------------------------


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in JSON vocabularies of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = dict(zip(shown, map(chr, shown), strict=True))
    return [stands.setdefault(b, chr(256 + sum(x not in shown for x in range(b)))) for b in range(256)]


def read_merges(path: str) -> tuple[dict[int, int], int, list[str]]:
    """Ranks of the packed pairs of a JSON tokenizer file (symbols: bytes, then 256 + rank of the merge that made them),
    the bits they are packed by, and its added tokens, longest first."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbol_of = {c: b for b, c in enumerate(byte_alphabet())}
    merges, shift = spec["model"]["merges"], (256 + len(spec["model"]["merges"])).bit_length()
    ranks = {}
    for rank, pair in enumerate(merges):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[symbol_of[left] << shift | symbol_of[right]] = rank
        symbol_of.setdefault(left + right, 256 + rank)
    return ranks, shift, sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)


class ChunkCounts(Store):
    """Tokens of each chunk, merging only what has not been seen: bytes less merges, for each pre-token."""

    def __init__(self, merges: dict[int, int], shift: int, pattern: str = PATTERN):
        super().__init__()
        self.rank_of, self.shift, self.split = merges.get, shift, regex.compile(pattern).findall

    def __missing__(self, chunk: str) -> int:
        known = self.known(chunk)
        if known is not None:
            return known
        pieces = self.split(chunk)
        if len(pieces) == 1 and pieces[0] == chunk:
            return self.keep(chunk, self.piece(chunk))
        return self.keep(chunk, sum(map(self.__getitem__, pieces)))

    def piece(self, piece: str) -> int:
        raw = list(piece.encode())
        return len(raw) - merge_pairs(raw, self.rank_of, self.shift, 256)


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to every row, from the JSON tokenizer file at path.

    Null or empty text has 0 bytes and 0 tokens. Strings of added tokens inside a text count as one token each, as the
    library's default is. Repeated rows are counted one by one; nothing can tie. Other columns pass through; columns with
    the new names are replaced; an empty table stays empty. No shuffle.
    """
    docs = spread(docs.drop("n_bytes", "n_tokens", "over_limit"))
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(path))
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, shift, added = shared.value
        counts, cut = _once(("counts", path, pattern), lambda: ChunkCounts(merges, shift, pattern)), cutter(pattern)
        special = regex.compile("|".join(map(regex.escape, added))) if added else None
        for batch in batches:
            tokens = []
            for value in chain.from_iterable(part.to_pylist() for part in slices(batch.column(column))):
                n, rest = 0, [value] if value else []
                if value and special and special.search(value):
                    rest = [x for x in special.split(value) if x]
                    n = len(special.findall(value))
                for part in rest:
                    n += sum(map(counts.__getitem__, cut(part)))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])
    counted = docs.mapInArrow(run, schema)
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


# --- encoding and decoding ------------------------------------------------------------------------------------------


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file; ids must run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash from the vocabulary's tokens to their ids, by hash, displace and compress.

    Keys fall into buckets by one hash; large buckets first, each bucket takes the first displacement that sends its
    keys to free slots. A lookup costs two hashes and one comparison, which tells members from strangers.
    """

    def __init__(self, tokens: list[bytes]):
        n = len(tokens)
        self.size, self.buckets = n, n // 3 + 1
        groups: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            groups.setdefault(hash_bytes(token) % self.buckets, []).append(i)
        displace, slots, free = [0] * self.buckets, [-1] * n, 0
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:  # one key: straight into the next free slot, marked by a negative displacement
                while slots[free] >= 0:
                    free += 1
                displace[bucket], slots[free] = -free - 1, members[0]
                continue
            bases = [hash_bytes(tokens[i]) for i in members]
            d = 1
            while True:
                places = [spot(b, d, n) for b in bases]
                if len(set(places)) == len(places) and all(slots[p] < 0 for p in places):
                    break
                d += 1
            displace[bucket] = d
            for p, i in zip(places, members, strict=True):
                slots[p] = i
        self.displace, self.ids, self.tokens = displace, slots, tokens

    def get(self, key: bytes) -> int | None:
        base = hash_bytes(key)
        d = self.displace[base % self.buckets]
        found = self.ids[-d - 1 if d < 0 else spot(base, d, self.size)]
        return found if found >= 0 and self.tokens[found] == key else None


def hash_bytes(key: bytes) -> int:
    """Two checksums side by side: the same in every process, unlike Python's own hash of bytes."""
    return zlib.crc32(key) << 32 | zlib.adler32(key)


def spot(base: int, displacement: int, size: int) -> int:
    h = (base ^ displacement * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 32) % size


def pair_ranks(tokens: list[bytes]) -> tuple[dict[int, int], int]:
    """Rank (and id) of what each pair of tokens makes, packed by the ids of the pair, and the bits they are packed by."""
    ids, shift = {token: i for i, token in enumerate(tokens)}, len(tokens).bit_length()
    pairs = {}
    for token, rank in ids.items():
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << shift | right] = rank
    return pairs, shift


class ChunkIds(Store):
    """Ids of each chunk and pre-token: whole pre-tokens through the perfect hash, the others by merging.

    A pre-token taken by itself is split no further, so one bounded store serves both.
    """

    def __init__(self, table: PerfectHash, pattern: str = PATTERN, size: int = STORE_BYTES):
        super().__init__(size)
        self.table, self.split, self.longest = table, regex.compile(pattern).findall, max(map(len, table.tokens), default=0)
        pairs, self.shift = pair_ranks(table.tokens)
        self.rank_of = pairs.get
        self.byte_ids = [table.get(bytes([b])) for b in range(256)]

    def __missing__(self, chunk: str) -> list[int]:
        known = self.known(chunk)
        if known is not None:
            return known
        pieces = self.split(chunk)
        if len(pieces) == 1 and pieces[0] == chunk:
            ids = self.piece(chunk)
        else:
            ids = list(chain.from_iterable(map(self.__getitem__, pieces)))
        return self.keep(chunk, ids, len(ids))

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.table.get(raw) if len(raw) <= self.longest else None
        if whole is not None:
            return [whole]
        symbols = list(map(self.byte_ids.__getitem__, raw))
        merge_pairs(symbols, self.rank_of, self.shift, 0)
        return [x for x in symbols if x >= 0]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", pattern: str = PATTERN, store_bytes: int = STORE_BYTES) -> DataFrame:
    """Add an array of token ids to every row, from the rank file at path, without special tokens.

    Null or empty text gives an empty array. Repeated rows are encoded one by one; nothing can tie. Other columns pass
    through; a column named like `ids` is replaced; an empty table stays empty.
    """
    docs = spread(docs.drop(ids))
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(path)))
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = _once(("ids", path, pattern, store_bytes), lambda: ChunkIds(shared.value, pattern, store_bytes)), cutter(pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                offsets, flat = [0], array("i")
                for value in batch.column(column).to_pylist():
                    if value:
                        flat.extend(chain.from_iterable(map(known.__getitem__, cut(value))))
                    offsets.append(len(flat))
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an array of token ids stands for (null: null); an id outside the vocabulary fails the query."""
    encoded = encoded.drop(out)
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    column = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = dict(enumerate(shared.value)).__getitem__
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found = batch.column(column)
                bounds, known = found.offsets.to_pylist(), found.is_valid().to_pylist()
                flat = found.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy().tolist()
                values = [b"".join(map(token, flat[a - bounds[0] : b - bounds[0]])) if ok else None for a, b, ok in zip(bounds, bounds[1:], known)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))
