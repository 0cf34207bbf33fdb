"""Readers: each brings one table of documents to the common shape src_table, doc_key, text, lang, source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquire.functions.text import html_text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, dealt out where its files would leave most cores idle; larger tables keep their splits."""
    df, want = read(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def _shape(df: DataFrame, src: str, key: str, text, lang=None, source=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(src).alias("src_table"), F.col(key).cast("string").alias("doc_key"), text.alias("text"),
        (none if lang is None else F.col(lang)).alias("lang"), (none if source is None else source).alias("source"),
    )


def from_documents(df: DataFrame) -> DataFrame:
    return _shape(df, "documents", "doc_id", F.col("text"), "lang", F.col("source"))


def from_pages(df: DataFrame) -> DataFrame:
    return _shape(df, "pages", "page_id", html_text(F.col("html")), source=F.try_parse_url(F.col("url"), F.lit("HOST")))


def assemble(conversations: DataFrame) -> DataFrame:
    """One text per conversation: `role: text` lines in turn order. Null roles and texts count as empty."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("text"), F.count("*").alias("n_turns"))


def from_conversations(df: DataFrame) -> DataFrame:
    return _shape(assemble(df), "conversations", "conv_id", F.col("text"))


def unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three sources in one shape, without a shuffle but the one that assembles conversations."""
    docs = from_documents(read(spark, sf_dir, "documents"))
    return docs.unionByName(from_pages(read(spark, sf_dir, "pages"))).unionByName(from_conversations(read(spark, sf_dir, "conversations")))
