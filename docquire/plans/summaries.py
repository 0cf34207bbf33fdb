"""Profiles and summaries of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquire.functions.text import collapse


def profile(docs: DataFrame) -> DataFrame:
    """Length, words and distinct words of every document; null and blank texts have no words. Each text is split once."""
    split = docs.select("doc_id", F.length("text").cast("long").alias("length"), F.array_remove(F.split(collapse(F.coalesce("text", F.lit(""))), " "), "").alias("words"))
    return split.select("doc_id", "length", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


def corpus_summary(docs: DataFrame) -> DataFrame:
    """Documents and characters by language and source, with subtotals.

    Sums of (lang, source) are made first, so that only these few rows, and no texts, are repeated for the subtotals.
    """
    sizes = docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return sizes.rollup("lang", "source").agg(F.sum("n").alias("n_docs"), F.sum("chars").cast("long").alias("n_chars"))


def host_counts(pages: DataFrame) -> DataFrame:
    """Pages of each host; URLs that can't be parsed count as null."""
    return pages.groupBy(F.try_parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n_pages"))


def label_coverage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """By source: documents, labelled ones, and those of each label."""
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    joined = docs.select("doc_id", "source").join(one, "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"),
        F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("n_good"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("n_toxic"),
    )


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document row with its labels: how many, the value that all of them give (null where they differ or there is
    none), and the names of the labels that differ. Labels of ids without a document are left out; extra columns are ignored.

    Labels are reduced to a row for each id before the join, and texts take no part in it.
    """
    names = ["quality", "toxic"]
    spans = [f(n).alias(f"{w}_{n}") for n in names for f, w in ((F.min, "least"), (F.max, "most"))]
    one = labels.groupBy("doc_id").agg(F.count("*").alias("labels"), *spans)
    differ = lambda n: F.col(f"least_{n}") != F.col(f"most_{n}")
    joined = docs.select("doc_id", "lang", "source").join(one, "doc_id", "left")
    agreed = [F.when(~differ(n), F.col(f"most_{n}")).alias(n) for n in names]
    return joined.select(
        "doc_id", "lang", "source", F.coalesce("labels", F.lit(0)).cast("long").alias("n_labels"), *agreed,
        F.concat_ws(",", *(F.when(differ(n), F.lit(n)) for n in names)).alias("disputed"),
    )
