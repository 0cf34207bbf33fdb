"""Conversations assembled turn by turn as they arrive, with state for each conversation and timers that close it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docquire.operators.publish import publish

TURNS = "conv_id long, turn long, role string, text string, arrived_at timestamp"
OUT = "conv_id long, opened timestamp, revision long, n_turns long, text string, closed boolean"


class Assembler(StatefulProcessor):
    """Keeps the turns of a conversation; every batch that brings a new one emits the whole conversation again.

    Of several rows for a turn the first to arrive stays (in one batch: by arrival, then role, then text), so repeats and
    replayed rows change nothing. A timer moves on with each new turn; when it fires, the conversation is emitted once
    more as closed and its state goes.
    """

    def __init__(self, idle: timedelta):
        self.idle_ms = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "role string, text string")
        self.header = handle.getValueState("header", "opened_ms long, latest_ms long, revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, tuple] = {}
        for part in rows:
            arrived = part["arrived_at"].astype("datetime64[ms]").astype("int64").tolist()
            for turn, role, text, at in zip(part["turn"].tolist(), part["role"], part["text"], arrived, strict=True):
                row = (at, role or "", text or "")
                if turn not in new or row < new[turn]:
                    new[turn] = row
        fresh = {turn: row for turn, row in new.items() if not self.turns.containsKey((turn,))}
        if not fresh:
            return
        for turn, (_, role, text) in fresh.items():
            self.turns.updateValue((turn,), (role, text))
        times = [row[0] for row in fresh.values()]
        opened, latest, revision = self.header.get() if self.header.exists() else (min(times), min(times), 0)
        latest = max(latest, *times)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)
        self.header.update((min(opened, *times) if revision == 0 else opened, latest, revision + 1))
        yield self.emit(key, closed=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.header.exists():
            yield self.emit(key, closed=True)
        self.turns.clear()
        self.header.clear()

    def emit(self, key, closed: bool) -> pd.DataFrame:
        opened, _, revision = self.header.get()
        lines = [f"{role}: {text}" for _, (role, text) in sorted((k[0], tuple(v)) for k, v in self.turns.iterator())]
        row = {"conv_id": key[0], "opened": pd.Timestamp(opened, unit="ms"), "revision": revision, "n_turns": len(lines), "text": "\n".join(lines), "closed": closed}
        return pd.DataFrame([row])

    def close(self) -> None:
        pass


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Turns from new Parquet files under path; rows without a conversation, turn or arrival take no part."""
    files = spark.readStream.schema(TURNS).parquet(path)
    return files.where("conv_id is not null and turn is not null and arrived_at is not null")


def assemble_stream(turns: DataFrame, delay: str = "1 hour", idle: timedelta = timedelta(hours=6)) -> DataFrame:
    """conv_id, opened, revision, n_turns, text, closed: a row for each conversation that a batch changes or closes.

    Turns may come late, repeated and in any order within the delay; text has them in turn order, as
    `sources.tables.assemble` does. Later ones are dropped. A turn after its conversation has closed opens another one.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = turns.withWatermark("arrived_at", delay).groupBy("conv_id")
    return grouped.transformWithStateInPandas(Assembler(idle), OUT, outputMode="Update", timeMode="EventTime")


def start(assembled: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's rows to out; a batch that is run again replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        publish(df.withColumn("batch", F.lit(number)), out, ["batch"])

    return assembled.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(batch).start()


def latest(published: DataFrame) -> DataFrame:
    """The last state of each conversation: its highest revision, closed or not."""
    row = F.struct("revision", "closed", "n_turns", "text")
    return published.groupBy("conv_id", "opened").agg(F.max(row).alias("r")).select("conv_id", "opened", "r.*")
