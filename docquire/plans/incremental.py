"""Summaries that merge: sums and sketches kept for each batch and group, put together for any set of them.

A batch's partial holds a Theta sketch of its texts (distinct counts; exact below 2^12 values, else within about 3% in two
of three cases) and a KLL sketch of text lengths (quantiles), so a summary of any set of batches or groups reads the few
bytes of their partials and no text again.

Where counts and quantiles must be exact at any size, exact_partials keep a row for each different text instead, by its
SHA-256, and merge in the same way.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquire.operators.publish import publish

#: Size parameters: log2 of a Theta sketch's entries, and a KLL sketch's accuracy parameter.
THETA_LOG, KLL_K = 12, 800


def partials(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, n_docs, n_chars, texts and lengths (sketches): one map-side-combined aggregate. Null texts only count as rows.
    A sketch leaves out empty strings, so texts go into it behind a sign."""
    return docs.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("n_chars"),
        F.theta_sketch_agg(F.concat(F.lit("="), text), THETA_LOG).alias("texts"),
        F.kll_sketch_agg_bigint(F.length(text).cast("long"), KLL_K).alias("lengths"),
    )


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The same columns for coarser groups, from partials alone."""
    return parts.groupBy(*by).agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_chars").alias("n_chars"),
        F.theta_union_agg("texts", THETA_LOG).alias("texts"), F.kll_merge_agg_bigint("lengths", KLL_K).alias("lengths"),
    )


def report(summary: DataFrame, by: list[str], ranks: dict[str, float] | None = None) -> DataFrame:
    """by, n_docs, n_chars, n_texts (distinct, estimated) and the quantiles of length that `ranks` names."""
    quantiles = [F.kll_sketch_get_quantile_bigint("lengths", F.lit(q)).alias(name) for name, q in (ranks or {}).items()]
    return summary.select(*by, "n_docs", "n_chars", F.theta_sketch_estimate("texts").cast("long").alias("n_texts"), *quantiles)


def exact_partials(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, digest, length, n_docs: a row for each different text of a group, null ones included, and none of the texts."""
    rows = docs.select(*by, F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("length"))
    return rows.groupBy(*by, "digest", "length").agg(F.count("*").alias("n_docs"))


def exact_merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The same columns for coarser groups, from partials alone."""
    return parts.groupBy(*by, "digest", "length").agg(F.sum("n_docs").alias("n_docs"))


def exact_report(summary: DataFrame, by: list[str], ranks: dict[str, float] | None = None) -> DataFrame:
    """What `report` gives, without estimates; a quantile is the smallest length that this share of the texts don't exceed.

    `summary` holds a text of a group once, so texts are counted for each length first. Lengths that all differ add up to
    the square of their number, so a group has far fewer of them than texts.
    """
    lengths = summary.groupBy(*by, "length").agg(F.sum("n_docs").alias("n"), F.count("digest").alias("texts"))
    known = F.when(F.col("length").isNotNull(), F.col("n"))
    group = Window.partitionBy(*by)
    upto = F.sum(known).over(group.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = lengths.withColumn("upto", upto).withColumn("known", F.sum(known).over(group))
    reached = lambda q: F.col("upto") >= F.greatest(F.ceil(F.lit(Decimal(str(q))) * F.col("known")), F.lit(1))
    return placed.groupBy(*by).agg(
        F.sum("n").alias("n_docs"), F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0)).cast("long").alias("n_chars"),
        F.sum("texts").alias("n_texts"), *(F.min(F.when(reached(q), F.col("length"))).alias(name) for name, q in (ranks or {}).items()),
    )


def start(docs: DataFrame, out: str, checkpoint: str, by: list[str]) -> StreamingQuery:
    """Keep each batch's partials under its number: a batch that is run again replaces them and changes no summary."""

    def batch(df: DataFrame, number: int) -> None:
        publish(partials(df, by).withColumn("batch", F.lit(number)), out, ["batch"])

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
