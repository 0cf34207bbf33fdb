"""Filter interaction audit: what each of five filters removes, alone and in every order.

Four filters look at a text alone; the fifth fails texts that a smaller id has too. Texts are range-partitioned by
prefixes that grow only where too many different texts share them; each prefix's texts go whole into a compressed radix
trie whose terminals hold the smallest id, and a traversal tells every text's smallest id. Each document then has a mask
of failed filters, and all orders are worked out from the counts of at most 32 masks a part.

A batch of documents sends each distinct text once and gets one answer for it, so a text that a third of all documents
repeat is one row a batch, and the answer goes back to the batch's documents by the batch's own number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquire.llm.common import portions, spread, written

FILTERS = "ABCDE"
#: Bytes of text that a range of prefixes is to hold, about.
RANGE_BYTES = 32 << 20
#: Length in bytes of a prefix, and the factor it grows by where too many different texts share it.
PREFIX, GROWTH = 8, 8
_UPPER, _SYMBOLS, _CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()
    upper, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _CONTINUED))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * upper > 10 * points) << 2
        | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3
    )


class Node:
    __slots__ = ("label", "children", "least", "members")

    def __init__(self, label: bytes):
        self.label, self.children, self.least, self.members = label, {}, None, None


class RadixTrie:
    """Whole texts as paths of labelled edges; a text's terminal holds its smallest id and who asked for it."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, member: int, least: int | None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
            elif not text.startswith(child.label, at):
                child = self.split(node, child, text, at)
            node, at = child, at + len(child.label)
        if node.members is None:
            node.members = []
        node.members.append(member)
        if least is not None and (node.least is None or least < node.least):
            node.least = least

    @staticmethod
    def split(node: Node, child: Node, text: bytes, at: int) -> Node:
        """Cut a child's edge where the text leaves it, and return the new node there."""
        label, low, high = child.label, 1, min(len(child.label), len(text) - at)
        while low < high:  # the longest common start, by halves
            half = (low + high + 1) // 2
            low, high = (half, high) if text.startswith(label[:half], at) else (low, half - 1)
        upper = node.children[label[0]] = Node(label[:low])
        child.label = label[low:]
        upper.children[label[low]] = child
        return upper

    def answers(self) -> Iterator[tuple[int, int | None]]:
        """(member, smallest id of its text) for every member, by an iterative traversal."""
        open_nodes = [self.root]
        while open_nodes:
            node = open_nodes.pop()
            open_nodes.extend(node.children.values())
            for member in node.members or ():
                yield member, node.least


def survey(docs: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """id, part, mask, piece for each row; least and text too on the first row of each distinct text of a batch, which
    all of the batch's rows with that text share the piece of."""
    rows = spread(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for whole in batches:
            for start, end in portions(pa.compute.binary_length(whole.column(2)).to_pylist(), 4 << 20):
                batch = whole.slice(start, end - start)
                ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                seen: dict[bytes, list] = {}  # piece, mask, smallest id
                rows, first = [], []
                for i, value in zip(ids, texts, strict=True):
                    known = seen.get(value)
                    first.append(value if known is None else None)
                    if known is None:
                        known = seen[value] = [number, text_mask(value), i]
                        number += 1
                    elif i is not None and (known[2] is None or i < known[2]):
                        known[2] = i
                    rows.append(known)
                least = [r[2] if t is not None else None for r, t in zip(rows, first, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array(least, pa.int64()), pa.array(first, pa.binary())],
                    names=["id", "part", "mask", "piece", "least", "text"],
                )

    return rows.mapInArrow(run, "id long, part string, mask int, piece long, least long, text binary")


def with_prefixes(texts: DataFrame, ranges: int, total: int) -> DataFrame:
    """Add prefix: the first PREFIX bytes, longer by GROWTH as often as prefixes of this length hold more than a quarter
    of a range and more than one text.

    Such prefixes are at most 4 x ranges, as they share the total between them: that bounds what is broadcast.
    """
    length, crowd = PREFIX, max(1, total // (4 * ranges))
    found = texts.withColumn("prefix", F.substring("text", 1, length)).withColumn("grown", F.lit(True))
    while True:
        sizes = found.where("grown").groupBy(F.xxhash64("prefix").alias("start")).agg(
            F.sum(F.octet_length("text") + 1).alias("size"), F.min(F.xxhash64("text")).alias("one"), F.max(F.xxhash64("text")).alias("other")
        )
        crowded = written(sizes.where((F.col("size") > crowd) & (F.col("one") != F.col("other"))).select("start"), "crowded")
        if crowded.isEmpty():
            return found.drop("grown")
        length *= GROWTH
        marked = found.withColumn("start", F.when(F.col("grown"), F.xxhash64("prefix"))).join(F.broadcast(crowded.withColumn("full", F.lit(True))), "start", "left")
        grown = F.coalesce("full", F.lit(False))
        found = marked.select("piece", "least", "text", F.when(grown, F.substring("text", 1, length)).otherwise(F.col("prefix")).alias("prefix"), grown.alias("grown"))


def smallest_ids(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """piece, first_id: the smallest id that any piece with the same text has (null: none has an id)."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    ranges = max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // range_bytes))
    # a short head and a hash: the rows that Spark samples to set the ranges stay small
    keyed = with_prefixes(texts, ranges, total).select(F.substring("prefix", 1, 32).alias("head"), F.xxhash64("prefix").alias("start"), "piece", "least", "text")
    dealt = keyed.repartitionByRange(ranges, "head", "start").sortWithinPartitions("head", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = RadixTrie(), None

        def answered() -> Iterator[pa.RecordBatch]:
            found = list(trie.answers())
            for at in range(0, len(found), 1 << 16):
                some = found[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64())], names=["piece", "first_id"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for start, piece, least, text in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in (1, 2, 3, 4)), strict=True):
                    if start != now:
                        yield from answered()
                        trie, now = RadixTrie(), start
                    trie.insert(text, piece, least)
        yield from answered()

    return dealt.mapInArrow(run, "piece long, first_id long")


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """part, mask (bit i set: filter i of FILTERS fails), n, n_good, n_toxic: the documents of each part by failed filters.

    Null texts are empty texts and null parts are ''; a null id is neither smaller nor larger than others. Rows that
    repeat count each; of rows with one id and one text none is smaller. A key with several labels has the largest. Very
    long texts go whole into a trie. Other columns are ignored; an empty table has no parts.
    """
    rows = written(survey(docs, key, part, text), "survey")
    found = written(smallest_ids(rows.where("text is not null").select("piece", "least", "text"), range_bytes), "smallest")
    late = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    judged = rows.select("id", "part", "mask", "piece").join(found.hint("merge"), "piece").select("id", "part", F.when(late, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"))
    known = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    labelled = judged.join(known.hint("merge"), "id", "left")
    return labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and what the filter of that step does after those before it, for all orders: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, and shapley (removed, summed over all orders at any step)."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(x) for x in order]
        steps += [{"filter_order": order, "step": i + 1, "bit": bit, "before": sum(bits[:i])} for i, bit in enumerate(bits)]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    per_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("m"))  # 32 at most
    rows = per_part.select("part", "m", F.inline(table))
    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    total = lambda test, value: F.aggregate(F.filter("m", test), F.lit(0).cast("long"), lambda z, x: z + value(x))
    removed = lambda column: total(lambda x: fails(x) & ~gone(x), lambda x: x[column])
    # of the orders, a document with k failed filters is removed by each of them in one of k
    orders = len(steps) // len(FILTERS)
    share = lambda x: x["n"] * (orders / F.bit_count(x["mask"])).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~gone(x), lambda x: x["n"]).alias("kept"),
        removed("n").alias("removed"),
        total(lambda x: fails(x) & gone(x), lambda x: x["n"]).alias("redundant"),
        total(lambda x: x["mask"] == F.col("bit"), lambda x: x["n"]).alias("unique_fails"),
        removed("n_good").alias("good_lost"),
        removed("n_toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


#: The same in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v (name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) AS r (i))
SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(c.toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
FROM s, c GROUP BY part, filter_order, step, bit, before
"""
