"""Keeping term statistics current as documents arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions import text as T


def term_counts(stream: DataFrame) -> DataFrame:
    """Running (term, tf, df) of a stream (doc_id, text); a complete-mode aggregation with map-side combine."""
    w = F.filter(T.words(F.col("text")), T.not_stopword)
    each = stream.select(F.explode(F.transform(F.array_distinct(w), lambda t: F.struct(t.alias("term"), F.size(F.filter(w, lambda x: x == t)).alias("tf")))).alias("e"))
    return each.groupBy(F.col("e.term").alias("term")).agg(F.sum("e.tf").alias("tf"), F.count("*").alias("df"))


def windowed_counts(stream: DataFrame, *, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, source, n) of a stream (source, loaded_at) by event-time window; rows later than ``delay`` fall out."""
    out = stream.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", width), "source").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "source", "n")


def append_postings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's postings appended under its batch number, so that a batch that is run again replaces itself."""
    from lexmill.operators import index as I

    def write(batch: DataFrame, epoch: int) -> None:
        I.postings(I.analysed(batch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
