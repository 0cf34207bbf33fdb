"""Conversations assembled from files that arrive: late, repeated and out-of-order turns, closing, restarts."""

import random
from datetime import datetime, timedelta

import pytest
from docquire.sources import tables
from docquire.streaming import assembly
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def minutes(n):
    return START + timedelta(minutes=n)


class Feed:
    """Files put one after another, each read by a run of its own from the same checkpoint, or all at once."""

    def __init__(self, spark, at):
        self.spark, self.at, self.n = spark, at, 0

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, assembly.TURNS).coalesce(1).write.parquet(f"{self.at}/in/{self.n}")

    def run(self, **options):
        turns = assembly.arriving(self.spark, f"{self.at}/in/*")
        assembly.start(assembly.assemble_stream(turns, **options), f"{self.at}/out", f"{self.at}/state").awaitTermination()

    def rows(self):
        return self.spark.read.parquet(f"{self.at}/out")

    def texts(self):
        return {(r["conv_id"], r["text"], r["n_turns"]) for r in assembly.latest(self.rows()).collect()}


def test_late_repeated_and_unordered_turns(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put([(1, 2, "user", "c", minutes(3)), (1, 0, "system", "a", minutes(4)), (2, 0, "user", "x", minutes(5))])
    feed.run()
    assert feed.texts() == {(1, "system: a\nuser: c", 2), (2, "user: x", 1)}
    # a late turn in between, one said again as before, one said again otherwise, one with nulls
    feed.put([(1, 1, "user", "b", minutes(1)), (2, 0, "user", "x", minutes(6)), (1, 2, "user", "other", minutes(7)), (2, 1, None, None, minutes(8))])
    feed.run()
    assert feed.texts() == {(1, "system: a\nuser: b\nuser: c", 3), (2, "user: x\n: ", 2)}
    # nothing but repeats: no conversation is emitted again
    before = feed.rows().count()
    feed.put([(1, 1, "user", "b", minutes(9)), (None, 1, "user", "b", minutes(9))])
    feed.run()
    assert feed.rows().count() == before and {r["revision"] for r in feed.rows().where("conv_id = 1").collect()} == {1, 2}


def test_first_arrival_of_a_turn_stays(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put([(1, 0, "user", "later", minutes(2)), (1, 0, "user", "earlier", minutes(1)), (1, 1, "b", "q", minutes(3)), (1, 1, "a", "q", minutes(3))])
    feed.run()
    assert feed.texts() == {(1, "user: earlier\na: q", 2)}


def test_idle_conversations_close_and_state_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    options = {"delay": "10 minutes", "idle": timedelta(minutes=30)}
    feed.put([(1, 0, "user", "a", minutes(0))])
    feed.run(**options)
    feed.put([(2, 0, "user", "z", minutes(200))])
    feed.run(**options)
    feed.put([(2, 1, "user", "y", minutes(201))])
    feed.run(**options)
    closed = [tuple(r)[0] for r in feed.rows().where("closed").select("conv_id").collect()]
    assert closed == [1]
    # behind the watermark: dropped; after closing: a conversation of its own
    feed.put([(1, 1, "user", "too late", minutes(5)), (1, 0, "user", "again", minutes(205))])
    feed.run(**options)
    assert feed.texts() == {(1, "user: a", 1), (1, "user: again", 1), (2, "user: z\nuser: y", 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_restarts_give_what_one_run_and_a_batch_give(spark, tmp_path, seed):
    rng = random.Random(seed)
    turns = [(c, t, rng.choice(["user", "assistant"]), f"text {c} {t}", minutes(rng.randrange(50))) for c in range(12) for t in range(rng.randint(1, 7))]
    rows = turns + rng.sample(turns, 10)
    rng.shuffle(rows)
    feeds = [Feed(spark, tmp_path / name) for name in ("one", "many")]
    cuts = [rows[i::4] for i in range(4)]
    for part in cuts:
        feeds[0].put(part)
        feeds[1].put(part)
        feeds[1].run()
    feeds[0].run()
    batch = tables.assemble(spark.createDataFrame([r[:4] for r in turns], "conv_id long, turn long, role string, text string"))
    want = {(r["conv_id"], r["text"], r["n_turns"]) for r in batch.collect()}
    assert feeds[0].texts() == feeds[1].texts() == want
    # the same files again from the last checkpoint: nothing new
    n = feeds[1].rows().agg(F.count("*")).first()[0]
    feeds[1].run()
    assert feeds[1].rows().count() == n
