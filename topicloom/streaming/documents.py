"""Structured Streaming over documents: inference with a trained model, and word counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import token_list
from topicloom.models.base import LDA


def infer_stream(model: LDA, docs: DataFrame, path: str, checkpoint: str, *, iterations: int = 20):
    """Start a query that writes (doc_id, theta) of every document of the stream docs(doc_id, words)
    to Parquet files under path. Each micro-batch is one stateless pass against the broadcast counts;
    a batch that is run again after a failure overwrites its own folder."""

    def batch(part: DataFrame, number: int) -> None:
        model.infer(part, iterations).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def word_counts(docs: DataFrame, *, time_col: str, text_col: str = "text", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, word, n): counts of a stream of texts by event-time window; events later than `late`
    behind the newest are dropped with their windows."""
    words = docs.withWatermark(time_col, late).select(time_col, F.explode(token_list(F.col(text_col))).alias("word"))
    counted = words.groupBy(F.window(time_col, window), "word").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "word", "n")
