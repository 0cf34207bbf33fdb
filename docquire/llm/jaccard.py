"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups they form.

Sets are kept in one global order of shingles, frequent ones last. Two sets that reach the threshold share a shingle of
their prefixes (the first n - ceil(t n) + 1), so:

1. Sets that share a prefix shingle and aren't too unlike in size are put in one cluster. A shingle of a few sets lists
   its pairs, and a pair that is only listed so counts if it shares enough prefix shingles; a shingle of more sets makes
   a star. Rows stay in proportion to prefix rows; connected components follow. No pair that links is in two clusters.
2. Each clustered set is fetched once. A cluster's sets hang in a prefix tree, common shingles first. The tree is walked
   depth first with the overlap that every other set has with the path so far, shared by all sets below; sets whose
   remaining length can't make up the overlap that is needed are left out, and a subtree for which none is left is skipped.
3. Only what connects components is returned: a link for each set at most. Clusters too large for a task are dealt into
   slices, each walked together with the cluster's leaders; then what is outside the cluster's largest component is walked
   against every slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquire.llm.common import bit_filter, components, discard, gram_hashes, group_bounds, groups, in_filter, mix, portions, ragged, signed, slices, spread, word_hashes, written

#: Most shingles that the global order ranks by frequency; the order of the others is by hash. Any order gives the same links.
FREQUENT = 4_000_000
#: Least frequency of a ranked shingle.
RANKED = 4
#: Sets of one shingle, by its frequency, that go to one task.
PART = 16_384
#: Sets of one shingle that list their pairs; more make a star.
FEW = 12
#: Shingles (and 64 more for each set) that a task's slice of a cluster holds; one set at least.
SLICE = 1_000_000
_POOL = 1_000_000
_COUNT_BITS = 24
_BUCKET_BITS = 28
_FILTER_BITS = 1 << 26
_NONE = np.empty(0, dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct runs of k words; fewer words are one run, none give the empty set."""
    words, bounds = word_hashes(texts, ascii_only=False)
    found, at = gram_hashes(words, bounds, k)
    for i in range(len(texts)):
        n = int(bounds[i + 1] - bounds[i])
        if n >= k:
            yield np.unique(found[at[i] : at[i + 1]])
        else:
            yield gram_hashes(words[bounds[i] : bounds[i + 1]], np.array([0, n]), n)[0] if n else _NONE


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for part in slices(column):
        texts = part.to_pylist()
        for a, b in portions(len(t or b"") for t in texts):
            yield from shingle_sets(texts[a:b], k)


def set_id(shingles: np.ndarray) -> int:
    """Equal sets, equal id."""
    return int(mix(np.array([mix(shingles + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


class Order:
    """The global order: shingles outside the frequent ones by hash, then the frequent ones from rare to common.

    Frequent shingles are given by the upper bits of their hashes, and kept with their counts in one number each.
    """

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        self.known = np.sort(frequent << np.uint64(_COUNT_BITS) | np.minimum(counts, (1 << _COUNT_BITS) - 1).astype(np.uint64))

    def prefix(self, shingles: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set in the order, and how frequent each is (0 for those outside)."""
        often = np.zeros(len(shingles), dtype=np.int64)
        if len(self.known):
            low = np.uint64((1 << _COUNT_BITS) - 1)
            at = self.known[np.minimum(np.searchsorted(self.known, shingles & ~low), len(self.known) - 1)]
            often = np.where((at ^ shingles) <= low, at & low, np.uint64(0)).astype(np.int64)
        first = np.argsort(often, kind="stable")[:length]
        return shingles[first], often[first]


def _needed(a, b, percent: int):
    return -(-percent * (a + b) // (100 + percent))


def link_documents(docs: DataFrame, k: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text", slice_size: int = SLICE, part_size: int = PART) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: key, n_shingles, set_id, component_id for every row; links: a, b, set ids compared and
    found alike (a spanning subset: every component is connected by them).

    Rows with equal sets are one class. A row with no word (or null text) has 0 shingles and its own key as component;
    a null key takes part but never names a component with other keys. Ties and repeated rows can't change a component:
    it is named by its smallest key. Extra columns are ignored; an empty table gives empty results.
    """
    source = spread(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text")))
    rows, order = _survey(source, k)
    clustered = components(_stars(source, order, k, percent, part_size), "clusters").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    carriers = rows.where("n_shingles > 0").groupBy(F.col("set_id").alias("id")).agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"))
    inside = written(carriers.join(clustered.hint("merge"), "id"), "clustered")
    sizes = written(inside.groupBy("cluster").agg(F.count("*").alias("sets"), F.ceil(F.sum(F.col("n") + 64) / slice_size).alias("slices")).where("sets > 1"), "sizes")
    inside = written(inside.join(sizes.hint("merge"), "cluster").withColumn("slice", F.pmod(F.xxhash64("id"), "slices")), "sliced")
    known = _fetch(source, inside, k)
    large = inside.where("slices > 1")
    leaders = large.groupBy("cluster", F.pmod(F.xxhash64("id", F.lit("leader")), F.lit(8)).alias("c")).agg(F.min("id").alias("id"))
    led = leaders.join(sizes.hint("merge"), "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "id")
    dealt = inside.select("cluster", "slice", "id").union(led).distinct()
    tasks = dealt.select("cluster", "slice", F.lit(0).alias("other"), "id", F.col("id").alias("group"), F.lit(3).alias("role"))
    links = _walk(tasks, known, percent)
    if not sizes.where("slices > 1").isEmpty():
        links = links.union(_walk(_rest(large, links, slice_size), known, percent))
    labels = components(links, "labels").select(F.col("node").alias("id"), "component")
    discard(known)

    joined = rows.withColumn("id", F.when(F.col("n_shingles") > 0, F.col("set_id"))).join(labels.hint("merge"), "id", "left")
    joined = written(joined.select("key", "n_shingles", "set_id", F.coalesce("component", "id").alias("component")), "joined")
    named = written(joined.where("component is not null").groupBy("component").agg(F.min("key").alias("component_id")), "named")
    members = joined.join(named.hint("merge"), "component", "left").select(
        F.col("key").alias(key), "n_shingles", "set_id", F.coalesce("component_id", F.col("key")).alias("component_id")
    )
    return members, links


def _survey(source: DataFrame, k: int) -> tuple[DataFrame, object]:
    """key, n_shingles and set_id of every row, and the global order, sent to all tasks.

    Every shingle is counted over the whole table. A frequent one that isn't known as such would put sets that have nothing
    else in common in one cluster. Tasks send the upper bits of their shingles' hashes, a row for each range of them.
    """
    spark = source.sparkSession
    names = ["range", "key", "n", "id", "values", "counts"]
    low = np.uint64((1 << _BUCKET_BITS) - 1)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, size = [], 0

        def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

        def pooled() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(pool) >> np.uint64(_COUNT_BITS), return_counts=True)
            part = (values >> np.uint64(_BUCKET_BITS)).astype(np.int32)
            bounds = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
            none = pa.nulls(len(bounds) - 1, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]]), none, none, none, blobs((values & low).astype(np.uint32), bounds), blobs(np.minimum(n, 0xFFFF).astype(np.uint16), bounds)], names=names)

        for batch in batches:
            ns, ids = [], []
            for found in _sets(batch.column(1), k):
                ns.append(len(found))
                ids.append(set_id(found) if len(found) else 0)
                if len(found):
                    pool.append(found)
                    size += len(found)
                if size > _POOL:
                    yield pooled()
                    pool, size = [], 0
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(batch.num_rows, dtype=np.int32) % 4096), batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), none, none], names=names)
        if size:
            yield pooled()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of sets as they are (their ranges are negative), then the frequent shingles of each range."""
        for part in groups(batches, ["range"]):
            whole = part.column("range").to_numpy()
            rows = part.slice(0, int(np.searchsorted(whole, 0))).select(["key", "n", "id"])
            yield from rows.add_column(0, "frequent", pa.array(np.zeros(rows.num_rows, dtype=bool))).to_batches()
            part = part.slice(rows.num_rows)
            bounds = group_bounds(part, ["range"]).tolist() if part.num_rows else []
            for s, e in zip(bounds[:-1], bounds[1:]):
                yield frequent(part.slice(s, e - s))

    def frequent(part: pa.Table) -> pa.RecordBatch:
        at = part.column("range")[0].as_py()
        values, n = (np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in part.column(c)]) for c, kind in (("values", np.uint32), ("counts", np.uint16)))
        order = np.argsort(values)
        values, n = values[order], n[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        n = np.add.reduceat(n, first, dtype=np.int64)
        more = n >= RANKED
        some = int(more.sum())
        shingles = (np.uint64(at) << np.uint64(_BUCKET_BITS) | values[first[more]].astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(some, dtype=bool)), pa.nulls(some, pa.int64()), pa.array(n[more]), pa.array(shingles)], names=["frequent", "key", "n", "id"])

    dealt = source.mapInArrow(survey, "range int, key long, n long, id long, values binary, counts binary").repartition("range").sortWithinPartitions("range")
    seen = written(dealt.mapInArrow(count, "frequent boolean, key long, n long, id long"), "sets", free=True)
    often = seen.where("frequent")
    room, least = FREQUENT, 1 << 40
    for r in often.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    top = often.where(F.col("n") >= least).select("id", "n").toArrow()
    order = spark.sparkContext.broadcast(Order(top.column("id").to_numpy().view(np.uint64), top.column("n").to_numpy()))
    return seen.where("not frequent").select("key", F.col("n").alias("n_shingles"), F.col("id").alias("set_id")), order


def _stars(source: DataFrame, order, k: int, percent: int, part_size: int) -> DataFrame:
    """a, b: sets that may link through a prefix shingle, or that such sets connect.

    Sets of a shingle are sorted by size; where the next is too large for the one before it, no pair across can link. A
    set goes to a task once, however many copies the task has. The sets of a very frequent shingle are dealt into parts,
    whose first sets are joined through a node that stands for the shingle.

    What two sets share beyond their prefixes is at most what either has left there, so pairs that only met in shingles
    of few sets must have met often enough.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, seen = order.value, set()
        for whole in batches:
            for column in slices(whole.column(1)):
                found = []
                for shingles in _sets(column, k):
                    name = set_id(shingles)
                    if not len(shingles) or name in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(name)
                    n = len(shingles)
                    head, often = ordered.prefix(shingles, n - -(-percent * n // 100) + 1)
                    parts = np.maximum(1, -(-often // part_size)).astype(np.uint64)
                    salted = mix(head + np.uint64(name & 0xFFFFFFFF) % parts)
                    hot = parts > 1
                    found.append((np.where(hot, salted, head), np.where(hot, head, np.uint64(0)), np.full(len(head), name, dtype=np.int64), np.full(len(head), n, dtype=np.int32)))
                if found:
                    token, hot, ids, n = map(np.concatenate, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(signed(hot)), pa.array(ids), pa.array(n)], names=["token", "hot", "id", "n"])

    dealt = source.mapInArrow(prefixes, "token long, hot long, id long, n int").repartition("token").sortWithinPartitions("token", "n", "id")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["token"]):
            token, hot, ids, n = (part.column(c).to_numpy() for c in ("token", "hot", "id", "n"))
            once = np.r_[True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])]
            token, hot, ids, n = token[once], hot[once], ids[once], n[once].astype(np.int64)
            first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (n[:-1] * 100 < n[1:] * percent)])
            sizes = np.diff(np.append(first, len(ids)))
            many = np.repeat((sizes > FEW) | (hot[first] != 0), sizes)
            center = np.repeat(ids[first], sizes)
            joint = first[hot[first] != 0]
            shingle = signed(mix(hot[joint].view(np.uint64) + np.uint64(0x2545F4914F6CDD1D)))
            starred = many & (ids != center)
            a, b = [ids[starred], ids[joint]], [center[starred], shingle]
            x, y = [], []
            for step in range(1, FEW):  # pairs of places that are `step` apart in a run of few
                at = np.flatnonzero(~many[step:] & (np.repeat(first, sizes)[step:] == np.repeat(first, sizes)[:-step])) if step < len(ids) else first[:0]
                at = at[n[at] * 100 >= n[at + step] * percent]
                x.append(at)
                y.append(at + step)
            x, y = np.concatenate(x), np.concatenate(y)
            stars = sum(map(len, a))
            zeros = np.zeros(stars, dtype=np.int32)
            columns = [np.concatenate([*a, np.minimum(ids[x], ids[y])]), np.concatenate([*b, np.maximum(ids[x], ids[y])])]
            columns += [np.concatenate([zeros, np.minimum(n[x], n[y]).astype(np.int32)]), np.concatenate([zeros, np.maximum(n[x], n[y]).astype(np.int32)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "na", "nb"])

    met = dealt.mapInArrow(stars, "a long, b long, na int, nb int").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    left = F.ceil(F.col("nb") * percent / 100) - 1
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - F.lit(1e-9))
    return met.where((F.col("na") == 0) | (F.col("shared") + left >= needed)).select("a", "b")


def _fetch(source: DataFrame, inside: DataFrame, k: int) -> DataFrame:
    """id, tokens of the clustered sets: the texts are read again, and one row for each set is hashed (without a key, all)."""
    spark = source.sparkSession
    bits = spark.sparkContext.broadcast(bit_filter(inside, "id", _FILTER_BITS))
    key_bits = spark.sparkContext.broadcast(bit_filter(inside.where("key is not null").select(F.xxhash64("key").alias("key")), "key", _FILTER_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, carrying = bits.value, key_bits.value
        for whole in batches:
            keyed = whole.column(2).to_numpy().view(np.uint64)
            batch = whole.filter(pa.array(in_filter(carrying, keyed) | whole.column(0).is_null().to_numpy(zero_copy_only=False)))
            for column in slices(batch.column(1)):
                ids, values = [], []
                for found in _sets(column, k):
                    name = set_id(found) if len(found) else None
                    if name is not None and in_filter(allowed, np.array([name], dtype=np.int64).view(np.uint64))[0]:
                        ids.append(name)
                        values.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], names=["id", "tokens"])

    fetched = source.withColumn("hash", F.xxhash64("key")).mapInArrow(fetch, "id long, tokens binary")
    return written(fetched.groupBy("id").agg(F.first("tokens").alias("tokens")), "members")


def _rest(large: DataFrame, links: DataFrame, slice_size: int) -> DataFrame:
    """Tasks for clusters of several slices: sets outside the cluster's largest component against every slice."""
    labels = components(links, "labels").select(F.col("node").alias("id"), "component")
    marked = written(large.join(labels.hint("merge"), "id", "left").select("cluster", "slice", "slices", "id", "n", F.coalesce("component", "id").alias("group")), "marked")
    most = marked.groupBy("cluster", "group").count().groupBy("cluster").agg(F.max_by("group", F.struct("count", "group")).alias("most"))
    most = written(most, "most")
    outer = written(marked.join(most.hint("merge"), "cluster").where("group <> most").drop("most"), "outer")
    parts = written(outer.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") + 64) / slice_size).alias("parts")), "parts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = outer.join(parts.hint("merge"), "cluster").select("cluster", every("slices").alias("slice"), F.pmod(F.xxhash64("id", F.lit("outer")), "parts").alias("other"), "id", "group", F.lit(1).alias("role"))
    held = marked.join(parts.hint("merge"), "cluster").select("cluster", "slice", every("parts").alias("other"), "id", "group", F.lit(2).alias("role"))
    both = probes.union(held.select(probes.columns))
    return both.groupBy("cluster", "slice", "other", "id", "group").agg(F.sum("role").cast("int").alias("role"))


def _walk(tasks: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect components, found in each task's prefix tree."""
    dealt = written(tasks, "tasks").join(known.hint("merge"), "id").repartition("cluster", "slice", "other").sortWithinPartitions("cluster", "slice", "other", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cluster", "slice", "other"]
        for part in groups(batches, names):
            ids, group, role, tokens = part.column("id").to_numpy(), part.column("group").to_numpy(), part.column("role").to_numpy(), part.column("tokens")
            bounds = group_bounds(part, names).tolist()
            a, b = [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                sets = [np.frombuffer(tokens[i].as_buffer(), dtype=np.uint64) for i in range(s, e)]
                found = tree_links(sets, group[s:e], role[s:e] & 1 > 0, role[s:e] & 2 > 0, percent)
                a += [int(ids[s + i]) for i, _ in found]
                b += [int(ids[s + j]) for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(dealt.mapInArrow(walk, "a long, b long"), "links")


class _Join:
    """Sets of a task, their shingles in the tree's order, and which of them hold each shingle."""

    def __init__(self, sets: list[np.ndarray], group: np.ndarray, percent: int):
        self.percent, self.group, self.links = percent, np.unique(group, return_inverse=True)[1], []
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, inverse, counts = np.unique(np.concatenate(sets) if sets else _NONE, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        both = counts[inverse] > 1  # what one set alone has can't overlap and only counts by its length
        owner, place = owner[both], rank[inverse[both]]
        self.width = int(place.max()) + 1 if len(place) else 1
        self.keys = np.sort(owner * self.width + place)
        self.paths = self.keys % self.width
        self.starts = np.searchsorted(self.keys, np.arange(len(sets) + 1) * self.width)
        by_place = np.argsort(place, kind="stable")
        self.holders, self.held = owner[by_place], np.searchsorted(place[by_place], np.arange(self.width + 1))

    def path(self, i: int) -> np.ndarray:
        return self.paths[self.starts[i] : self.starts[i + 1]]

    def overlaps(self, places: np.ndarray) -> np.ndarray:
        """How many of the shingles each set has."""
        return np.bincount(self.holders[ragged(self.held[places], self.held[places + 1])], minlength=len(self.sizes))

    def left(self, some: np.ndarray, place: int) -> np.ndarray:
        """Shingles of some sets that come after a place in the order."""
        return self.starts[some + 1] - np.searchsorted(self.keys, some * self.width + place, side="right")

    def link(self, i: int, near: np.ndarray) -> None:
        """Link a set with one set of each other component among those found alike."""
        near = near[self.group[near] != self.group[i]]
        _, first = np.unique(self.group[near], return_index=True)
        for j in near[first].tolist():
            self.links.append((i, j))
            self.group[self.group == self.group[j]] = self.group[i]

    def alike(self, i: int, some: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        return some[overlap >= _needed(self.sizes[i], self.sizes[some], self.percent)]


def tree_links(sets: list[np.ndarray], group: np.ndarray, probes: np.ndarray, held: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (probe, held set) that connect what reaches the threshold; sets of one group need no link.

    A few sets are compared with all first. Every pair of sets in different components has one outside the largest, so
    where all sets are both probes and held only those outside it are put in the tree.
    """
    join = _Join(sets, group, percent)
    all_held = np.flatnonzero(held)
    if held.all() and probes.all() and len(sets) > 16:
        for i in range(0, len(sets), -(-len(sets) // 16)):
            join.link(i, join.alike(i, all_held, join.overlaps(join.path(i))))
        probes = join.group != np.bincount(join.group).argmax()
    tree = sorted(np.flatnonzero(probes).tolist(), key=lambda i: join.path(i).astype(">u4").tobytes())
    paths = [join.path(i) for i in tree]
    agree = np.zeros(max(0, len(tree) - 1), dtype=np.int64)  # shingles that neighbours in the tree share from the root on
    for i, (p, q) in enumerate(zip(paths, paths[1:])):
        n = min(len(p), len(q))
        differs = p[:n] != q[:n]
        agree[i] = differs.argmax() if differs.any() else n
    lengths, sizes = np.array([len(p) for p in paths], dtype=np.int64), join.sizes[tree]
    todo = [(0, len(tree), 0, all_held, np.zeros(len(all_held), dtype=np.int64))] if tree else []
    while todo:
        low, high, depth, alive, overlap = todo.pop()
        end = int(agree[low : high - 1].min()) if high - low > 1 else int(lengths[low])
        if end > depth:
            step = paths[low][depth:end]
            overlap = overlap + join.overlaps(step)[alive]
            rest = np.minimum(int(lengths[low:high].max()) - end, join.left(alive, int(step[-1])))
            may = overlap + rest >= _needed(int(sizes[low:high].min()), join.sizes[alive], percent)
            if high - low == 1:
                may &= join.group[alive] != join.group[tree[low]]
            alive, overlap = alive[may], overlap[may]
        if not len(alive):
            continue
        while low < high and lengths[low] == end:  # sets that end here come first below a node
            join.link(tree[low], join.alike(tree[low], alive, overlap))
            low += 1
        cuts = [low, *(np.flatnonzero(agree[low : high - 1] <= end) + low + 1).tolist(), high] if low < high else []
        todo += [(s, e, end, alive, overlap) for s, e in zip(cuts, cuts[1:])]
    return join.links
