"""Incremental intake: documents that arrive as files, each key once within the watermark, published batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquire.operators.publish import publish

SCHEMA = "src_table string, doc_key string, text string, lang string, source string, arrived_at timestamp"


def arriving(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Documents from new Parquet files under path; a key that comes again within the delay is dropped."""
    files = spark.readStream.schema(SCHEMA).parquet(path)
    return files.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["src_table", "doc_key"])


def start(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every batch to out, partitioned by source table; a batch that is run again replaces its own files."""

    def batch(df: DataFrame, number: int) -> None:
        publish(df.withColumn("batch", F.lit(number)), out, ["batch", "src_table"])

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
