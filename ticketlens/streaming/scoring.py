"""Scoring and trends over a stream of tickets.

Scoring is row-local, so the batch operator runs on a stream unchanged. The trend keeps one running sum per
day until the watermark passes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ticketlens.functions import text as tx
from ticketlens.operators.sentiment import analyze_sentiment


def read_ticket_stream(spark, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New JSONL files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def score_stream(tickets: DataFrame, **options) -> DataFrame:
    return analyze_sentiment(tickets, **options)


def daily_trend_stream(scored: DataFrame, time_col: str = "created_at", score_col: str = "lex_compound", late: str = "1 day") -> DataFrame:
    """Mean score and tickets per day; a day is given out once the watermark has passed its end."""
    timed = scored.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return (
        timed.withWatermark(time_col, late)
        .groupBy(F.window(time_col, "1 day").alias("w"))
        .agg(F.avg(score_col).alias("mean"), F.count("*").alias("ticket_count"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("period"), tx.round_mean(F.col("mean")).alias("mean_compound"), "ticket_count")
    )


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet folder, each row once; ends when what is there has been read."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
