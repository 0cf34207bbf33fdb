"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

Tokens of both sides become byte intervals. All of them are sorted by start, the running maximum of their ends is taken,
and a group breaks where a start reaches it; overlaps are expanded within groups. Links are the overlapping pairs that
end together, and a corpus-wide count of each linked id pair tells how usual a link is.

Texts are encoded whole by the two libraries and aligned a batch at a time, as arrays. Link counts meet documents by
batch: a batch asks once for each pair it holds, however many links have it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from docquire.llm.bpe import _once, byte_alphabet
from docquire.llm.common import portions, ragged, spread, written

#: Bytes of text in a batch, and of those that the libraries get at once (one row at least).
BATCH_TEXT, ENCODED_TEXT = 2 << 20, 256 << 10
_SPACE = "▁"


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group number of each interval: groups break where a start reaches the largest end before it."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), dtype=np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all overlapping A and B tokens, both sides laid end to end over the same bytes; none leaves its group."""
    starts_a, starts_b = (np.r_[0, ends[:-1]] for ends in (ends_a, ends_b))
    first, last = np.searchsorted(ends_b, starts_a, side="right"), np.searchsorted(starts_b, ends_a, side="left")
    return np.repeat(np.arange(len(ends_a)), last - first), ragged(first, last)


class Side:
    """One tokenizer: how texts become ids, the bytes of each id, and its decimal digits, flush right before a separator."""

    def __init__(self, encode, token_bytes: list[bytes]):
        self.encode, self.token_bytes = encode, token_bytes
        self.lengths = np.array(list(map(len, token_bytes)), dtype=np.int64)

    @staticmethod
    def of_json(path: str, pattern: str | None) -> Side:
        """A byte-level tokenizer's JSON file; it encodes a space and the text.

        Given the pattern that it splits texts by, tiktoken merges by the same ranks at a fraction of the time. That is
        the same where merges make ids in rising order and every token encodes to itself: then each token comes about by
        its own merge only, in any text. Other files are left to their library.
        """
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_alphabet())}
        spelled = {i: bytes(map(byte_of.get, token)) for token, i in library.get_vocab(with_added_tokens=False).items() if all(map(byte_of.__contains__, token))}
        token_bytes = [spelled.get(i, b"") for i in range(library.get_vocab_size())]
        added = library.get_added_tokens_decoder()
        ranks = {spelled[i]: i for i in sorted(spelled) if i not in added}
        with open(path, encoding="utf-8") as f:
            merges = [m if isinstance(m, str) else " ".join(m) for m in json.load(f)["model"]["merges"]]
        made = [library.token_to_id(m.replace(" ", "")) for m in merges]
        if pattern and len(ranks) == 256 + len(made) and made == sorted(set(made)) and all([x.id for x in library.model.tokenize(library.id_to_token(i))] == [i] for i in ranks.values()):
            quick = tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            return Side(lambda texts: [quick.encode_ordinary(" " + t) for t in texts], token_bytes)
        return Side(lambda texts: [e.ids for e in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], token_bytes)

    @staticmethod
    def of_pieces(path: str) -> Side:
        """A sentencepiece model; it puts a space before the text itself."""
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        spelled = [bytes([int(p[3:-1], 16)]) if library.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        return Side(lambda texts: library.encode(texts, num_threads=1), spelled)

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.token_bytes.__getitem__, ids)) == raw


class Aligner:
    """Both tokenizers and the alignment of a batch of texts."""

    def __init__(self, a_path: str, b_path: str, pattern: str | None):
        self.a, self.b = Side.of_json(a_path, pattern), Side.of_pieces(b_path)
        said = [str(i).encode() for side in (self.a, self.b) for i in range(len(side.token_bytes))]
        self.width = max(map(len, said))
        self.digits = np.frombuffer(b"".join(x.rjust(self.width) + b"," for x in said), dtype=np.uint8).reshape(len(said), self.width + 1)

    def encoded(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and B the ids of all texts in a row, and where each text's start and end; none where a text doesn't count."""
        flat, past = ([], []), ([0], [0])
        for start, end in portions([len(t or "") for t in texts], ENCODED_TEXT):
            some = [t or "" for t in texts[start:end]]
            for text, *ids in zip(some, self.a.encode(some), self.b.encode(some), strict=True):
                raw = f" {text}".encode()
                fine = text and self.a.spells(ids[0], raw) and self.b.spells(ids[1], raw)
                for side in (0, 1):
                    if fine:
                        flat[side].append(np.array(ids[side], dtype=np.int64))
                    past[side].append(past[side][-1] + (len(ids[side]) if fine else 0))
        a, b = ((np.concatenate(f) if f else np.zeros(0, np.int64), np.array(p)) for f, p in zip(flat, past, strict=True))
        return a, b

    def align(self, texts: list[str | None]):
        """For the texts: counts (A tokens, B tokens, groups), groups as text, and the linked pairs and where each text's
        start and end. Both sides' bytes are the same for every text, so all of them lie on one line."""
        (ids_a, past_a), (ids_b, past_b) = self.encoded(texts)
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        if not len(ids_a):
            none = np.zeros(len(texts), np.int64)
            return (none, none, none), pa.array([""] * len(texts), pa.string()), ids_a, np.zeros(len(texts) + 1, np.int64)
        group = coalesce(np.r_[0, ends_a[:-1], 0, ends_b[:-1]], np.r_[ends_a, ends_b])
        first_group = np.append(group[: len(ids_a)], group.max() + 1)[past_a]  # texts end at an end of both sides
        over_a, over_b = overlaps(ends_a, ends_b)
        together = ends_a[over_a] == ends_b[over_b]
        over_a, over_b = over_a[together], over_b[together]
        counts = np.diff(past_a), np.diff(past_b), np.diff(first_group)
        return counts, self.spell(ids_a, ids_b, group, past_a + past_b), ids_a[over_a] << 32 | ids_b[over_b], np.searchsorted(over_a, past_a)

    def spell(self, ids_a: np.ndarray, ids_b: np.ndarray, group: np.ndarray, past: np.ndarray) -> pa.Array:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`, made as one array of characters."""
        half = group * 2
        half[len(ids_a) :] += 1
        order = np.argsort(half, kind="stable")  # by group, A before B, then in order
        half = half[order]
        rows = self.digits[np.r_[ids_a, ids_b + len(self.a.token_bytes)][order]]
        last = rows[:-1, -1]
        last[half[1:] != half[:-1]] = ord("|")
        last[half[1:] // 2 != half[:-1] // 2] = ord(";")
        shown = rows != ord(" ")
        shown[past[1:][np.diff(past) > 0] - 1, -1] = False  # nothing after a text's last token
        ends = np.r_[0, np.cumsum(shown.sum(axis=1))][past].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(past) - 1, [None, pa.py_buffer(ends), pa.py_buffer(rows[shown])])


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", pattern: str | None = None) -> DataFrame:
    """Add n_a, n_b, n_groups and groups (`a1,a2|b1;a3|b2,b3`: ids of each group in order) to every row, and for `weigh`
    batch, links (places of the linked pairs in the batch's table) and pairs (that table, on the batch's last row).

    A is a byte-level tokenizer's JSON file, encoding a space and the text; B is a sentencepiece model that adds the space
    itself; `pattern` is how A splits texts, if known (Side.of_json). Strings of special tokens are plain text. Null and empty texts, and those for which either side's token bytes
    aren't the space and the text, have no tokens: zeros and ''. Rows that repeat count each; nothing can tie. A text is
    encoded whole, however long. Other columns pass through, those with the new names are replaced, and an empty table
    stays empty. No shuffle.
    """
    names = ["n_a", "n_b", "n_groups", "groups", "batch", "links", "pairs"]
    docs = spread(docs.drop(*names))
    column = docs.columns.index(text)
    pair_type = pa.struct([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = _once(("align", a_path, b_path, pattern), lambda: Aligner(a_path, b_path, pattern))
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(whole.column(column)), 0).to_pylist()
            for start, end in portions(sizes, BATCH_TEXT):
                batch = whole.slice(start, end - start)
                counts, groups, linked, at = known.align(batch.column(column).to_pylist())
                pairs, links = np.unique(linked, return_inverse=True)
                table = pa.StructArray.from_arrays([pa.array(pairs), pa.array(np.bincount(links, minlength=len(pairs)))], fields=list(pair_type))
                once = pa.ListArray.from_arrays(pa.array([0] * batch.num_rows + [len(pairs)], pa.int32()), table)
                places = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(links.astype(np.int32)))
                new = [*map(pa.array, counts), groups, pa.array([number] * batch.num_rows, pa.int64()), places, once]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])
                number += 1

    added = T.StructType.fromDDL("n_a long, n_b long, n_groups long, groups string, batch long, links array<int>, pairs array<struct<pair: long, n: long>>")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), n_pair (links of the corpus that have it), best (none of its B id has more)."""
    asked = aligned.select(F.explode("pairs").alias("p")).select("p.pair", "p.n")
    counts = written(asked.groupBy("pair").agg(F.sum("n").alias("n_pair")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    most = counts.groupBy("b_id").agg(F.max("n_pair").alias("most"))
    return counts.join(most.hint("merge"), "b_id").select("pair", "n_pair", (F.col("n_pair") == F.col("most")).alias("best"))


def weigh(aligned: DataFrame) -> DataFrame:
    """Replace batch, links and pairs of `align` by n_links, n_best (links whose pair has its B id's highest count, ties
    included) and count_sum (the counts of the pairs of all links). The rows are written once, so they aren't aligned twice.
    """
    rows = written(aligned, "aligned")
    counts = written(pair_counts(rows), "weighed")
    asked = rows.select(F.col("batch").alias("of"), F.explode("pairs.pair").alias("pair"))
    known = asked.join(counts.hint("merge"), "pair").select("of", "pair", "n_pair", "best")
    kept = rows.drop("pairs")
    columns = [c for c in kept.columns if c not in ("batch", "links", "n_links", "n_best", "count_sum")]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        n, best = right.column("n_pair").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
        links = left.column("links").combine_chunks()
        at = links.offsets.to_numpy().astype(np.int64)
        flat = links.values.to_numpy()[at[0] : at[-1]]
        sums = [np.r_[0, np.cumsum(values[flat])] for values in (best, n)] if len(flat) else [np.zeros(1, np.int64)] * 2
        ends = at - at[0]
        sizes = [pa.array(np.diff(x)) for x in (ends, *(s[ends] for s in sums))]
        return pa.table([*(left.column(c) for c in columns), *sizes], names=[*columns, "n_links", "n_best", "count_sum"])

    fields = [f for f in kept.schema.fields if f.name in columns]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("n_links", "n_best", "count_sum"))])
    return kept.groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(count, schema)
