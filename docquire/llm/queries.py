"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquire.llm import align, ann, audit, bpe, chaining, decontam, jaccard, langid, licences, quality, repeats, urls
from docquire.llm.common import fraction, table


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan_licences(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(fraction("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", F.coalesce(fraction("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, _ = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return summary.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, pattern=public_tokenizers.PATTERN).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(fraction("doc_id", 3) != 1))
    return quality.score(docs, model).select("doc_id", F.coalesce(fraction("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern=public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return members.select("doc_id", "n_shingles", "component_id")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), pattern=public_tokenizers.PATTERN)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return align.weigh(aligned.withColumn("groups_sha256", digest).drop("text", "groups"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.learn(urls.labelled_urls(spark))).drop("url")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_language_id, op3_decontamination, op4_token_counts, op5_quality, op6_chained_passages, op7_suffix_array_dedup, op8_byte_bpe, op9_jaccard_join, op10_nearest_neighbours, op11_token_alignment, op12_url_filter, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op13_filter_audit": audit.SQL}
