"""Helpers that the training-data operators share: word splitting, hashing, scratch tables."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that Spark hands to a Python worker while a scratch table is written (one row at least).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: ASCII letters in lower case; every other ASCII byte that is no digit or letter becomes a space.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where a small file would leave most cores idle; larger inputs keep their splits."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one made here for a local session without it."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if spark.sparkContext.master.startswith("local["):
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        return folder
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame):
    """64-bit hash of a row's columns, those of types that Spark can't hash (maps, variants) as JSON."""
    plain = lambda f: not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
    columns = [F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields]
    return F.xxhash64(*columns)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application; results that were not yet read or written are lost."""
    _remove(spark, f"{scratch_dir(spark)}/docquire-{spark.sparkContext.applicationId}")


def slices(column: pa.Array, rows: int = 512) -> Iterator[pa.Array]:
    """Parts of a column of a batch, so that not all its values become Python objects at once."""
    for start in range(0, len(column), rows):
        yield column.slice(start, rows)


def batch_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, for the same reason."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from a sorted stream; the open run waits for the batches it goes on in."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        same = np.ones(n, dtype=bool)
        for c in columns:
            same &= c == c[-1]
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        now = pa.Table.from_batches([batch])
        if held and last != [c[0] for c in columns]:
            yield pa.concat_tables(held)
            held = []
        if cut:
            yield pa.concat_tables([*held, now.slice(0, cut)])
            held = []
        held.append(now.slice(cut))
        last = [c[-1] for c in columns]
    if held:
        yield pa.concat_tables(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys start in a sorted table, and its end."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def ragged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges from each start to its end, one range after another."""
    lengths = ends - starts
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def written(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, so a lost executor costs no recomputation.

    With `free`, the driver collects its garbage afterwards: shuffle files that only the written rows needed then go from
    the executors' disks at once, and not when memory happens to run short on the driver.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/docquire-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _note(path)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    if free:
        spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that `written` made, once everything that reads them has been written itself."""
    for table in tables:
        _remove(table.sparkSession, table.scratch_path)


#: Where the tables of a written_alone are noted; outside it a table stays, as a result that was not yet read may need it.
_made: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch tables", default=None)


def _note(path: str) -> None:
    if (made := _made.get()) is not None:
        made.append(path)


def written_alone(spark: SparkSession, make, label: str) -> DataFrame:
    """The table that make() returns, written out; every other scratch table that was made for it is removed.

    They are removed also when it fails. Tables of other queries of the session, in this thread or others, stay.
    """
    inner: list[str] = []
    token = _made.set(inner)
    kept = None
    try:
        kept = written(make(), label)
    finally:
        _made.reset(token)
        for path in inner:
            if kept is None or path != kept.scratch_path:
                _remove(spark, path)
    _note(kept.scratch_path)
    return kept


def ascii_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII bytes; null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; null has none."""
    return text.lower().split() if text else []


_SPACE_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BYTE = np.random.default_rng(4242).integers(1 << 62, dtype=np.uint64, size=256) * np.uint64(2) + np.uint64(1)
_POWER = np.ones(1 << 16, dtype=np.uint64)
_POWER[1:] = np.multiply.accumulate(np.full((1 << 16) - 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
_ODD = np.random.default_rng(20240607).integers(1 << 62, dtype=np.uint64, size=64) * np.uint64(2) + np.uint64(1)
_PORTION = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values (the finaliser of MurmurHash3, public domain)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def portions(sizes: Iterable[int], limit: int = _PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes, one row at least: what numpy works on in one go."""
    start, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if i >= start:
        yield start, i + 1


def word_hashes(texts: list[bytes | None], ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): 64-bit hashes of all words in order; text i has those from bounds[i] to bounds[i + 1].

    Words are those of ascii_words or of space_words. A word's hash is a polynomial in its bytes, summed for all words
    of all texts at once.
    """
    table = _WORD_BYTES if ascii_only else _SPACE_BYTES
    raw = np.frombuffer(b" " + b" ".join((t or b"").translate(table) for t in texts) + b" ", dtype=np.uint8)
    space = raw == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    at = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), bounds
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    letters = raw[~space]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_BYTE[letters] * _POWER[place & 0xFFFF], first)), bounds


def gram_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each run of k consecutive words of a text; texts of fewer words have none."""
    counts = np.maximum(0, np.diff(bounds) - k + 1)
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    total = words[:n] * _ODD[0]
    for j in range(1, k):
        total += words[j : j + n] * _ODD[j]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return mix(total[text[:n] == text[k - 1 :]]), np.concatenate([[0], np.cumsum(counts)])


def winnow(hashes: np.ndarray, bounds: np.ndarray, window: int, limit: int = 1 << 24) -> np.ndarray:
    """Indices of the leftmost minimum of every window of consecutive hashes of a text (of all, where it has fewer).

    Hashes are compared by their upper 40 bits, then by place, so equal windows always choose the same place. More than
    `limit` hashes (2^24 at most, the places that fit beside 40 bits) are taken in parts.
    """
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    if len(hashes) >= limit:
        inner = np.flatnonzero((bounds > 0) & (bounds < len(hashes)))
        if len(inner):  # cut between two texts, as near to the middle as can be
            half = int(inner[np.abs(bounds[inner] - len(hashes) // 2).argmin()])
            cut = int(bounds[half])
            return np.concatenate([winnow(hashes[:cut], bounds[: half + 1], window, limit), cut + winnow(hashes[cut:], bounds[half:] - cut, window, limit)])
        size = limit // 2  # one text of very many words: overlapping pieces
        parts = []
        for start in range(0, len(hashes) - window + 1, size):
            piece = hashes[start : start + size + window - 1]
            parts.append(start + winnow(piece, np.array([0, len(piece)]), window, limit))
        return np.unique(np.concatenate(parts))
    low = np.uint64((1 << 24) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    counts = np.diff(bounds)
    few = np.flatnonzero((counts > 0) & (counts < window))
    chosen = [(np.minimum.reduce(key[bounds[i] : bounds[i + 1]]) & low).astype(np.int64)[None] for i in few]
    if len(key) >= window:
        least, span = key, 1
        while span * 2 <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(key) - window + 1], least[window - span :])
        text = np.repeat(np.arange(len(counts)), counts)
        chosen.append((least[text[: len(least)] == text[window - 1 :]] & low).astype(np.int64))
    return np.unique(np.concatenate(chosen)) if chosen else np.empty(0, dtype=np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def fraction(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor: the fold a row falls into (null id: null)."""
    return F.crc32(F.col(column).cast("string")) % divisor


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of a fixed number of bits in which the 64-bit hashes of a column are set; it never follows the rows.

    It only spares work: what it lets through is joined exactly afterwards.
    """
    words = bits // 64
    slot = F.shiftrightunsigned(F.col(column), 38).bitwiseAND(words - 1)
    marks = df.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("mark")).toArrow()
    out = np.zeros(words, dtype=np.uint64)
    out[marks.column("slot").to_numpy().astype(np.int64)] = marks.column("mark").to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_filter(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word = filter_words[(hashes >> np.uint64(38) & np.uint64(len(filter_words) - 1)).astype(np.int64)]
    return (word >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node that links a, b reach, for every node with a link.

    Alternates large-star and small-star rounds until nothing changes. Every round is two map-side-combined minima and
    joins, and is written out, so neither a hub nor a long chain gathers anywhere.
    """
    pairs = lambda a, b: edges_now.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges_now = written(edges.select("a", "b").where("a <> b").distinct(), label)
    seen = None
    while True:
        both = pairs("a", "b").union(pairs("b", "a"))
        # written out, so that the join can split a hub's rows: an aggregate right below it would tie them to one task
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        before, edges_now = edges_now, written(large.where("a <> b").distinct(), label)
        discard(before, least)
        down = edges_now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, edges_now = edges_now, written(small.where("a <> b").distinct(), label)
        discard(before)
        state = edges_now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            found = edges_now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges_now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
            found = written(found, label)
            discard(edges_now)
            return found
        seen = state
