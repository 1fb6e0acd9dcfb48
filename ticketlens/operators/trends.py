"""Sentiment over time. Rows are aggregated to periods first; windows then run over the few periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketlens.functions import text as tx

# --- Fixed values ---------------------------------------------------------------------
SHIFT_WINDOW = 3
SHIFT_THRESHOLD = 0.3


def period_start(ts: Column, freq: str) -> Column:
    """``D``: the day. ``W``: the Sunday that ends the week."""
    day = F.to_date(ts)
    if freq == "D":
        return day.cast("timestamp_ntz")
    if freq == "W":
        return F.date_add(F.trunc(day, "week"), 6).cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq!r}: use 'D' or 'W'")


def period_trend(
    df: DataFrame,
    timestamp_col: str = "created_at",
    compound_col: str = "lex_compound",
    confidence_col: str = "sentiment_confidence",
    freq: str = "D",
) -> DataFrame:
    """Mean compound, mean confidence and row count per period; periods without a mean are left out."""
    return (
        tx.parse_ts(df.select(timestamp_col, compound_col, confidence_col), timestamp_col)
        .groupBy(period_start(F.col(timestamp_col), freq).alias("period"))
        .agg(
            F.avg(compound_col).alias("mean_compound"),
            F.avg(confidence_col).alias("mean_confidence"),
            F.count("*").alias("ticket_count"),
        )
        .filter("mean_compound is not null")
    )


def trend_shift(trend: DataFrame, threshold: float = SHIFT_THRESHOLD, on: str = "mean_compound") -> DataFrame:
    """Flag periods whose mean moved by more than the threshold from the period before."""
    before = F.lag(on, 1).over(W.orderBy("period"))
    change = F.round(F.abs(F.col(on) - before), 9)
    return trend.withColumn("shift_detected", F.coalesce(change > threshold, F.lit(False)))


def _trailing(window: int):
    return W.orderBy("period").rowsBetween(-(window - 1), 0)


def rolling_mean(trend: DataFrame, window: int = SHIFT_WINDOW) -> DataFrame:
    return trend.withColumn("rolling_mean", F.avg("mean_compound").over(_trailing(window)))


def rolling_std(trend: DataFrame, window: int = SHIFT_WINDOW) -> DataFrame:
    """Sample deviation over the trailing periods; 0 for a single one."""
    spread = F.stddev_samp("mean_compound").over(_trailing(window))
    return trend.withColumn("rolling_std", F.coalesce(F.nanvl(spread, F.lit(0.0)), F.lit(0.0)))


def sentiment_trend(
    df: DataFrame,
    timestamp_col: str = "created_at",
    compound_col: str = "lex_compound",
    confidence_col: str = "sentiment_confidence",
    freq: str = "D",
    shift_window: int = SHIFT_WINDOW,
    shift_threshold: float = SHIFT_THRESHOLD,
    shift_on: str = "mean",
) -> DataFrame:
    """Period trend with shift flag and rolling values. ``shift_on="rolling"`` flags on the rolling mean."""
    trend = period_trend(df, timestamp_col, compound_col, confidence_col, freq)
    trend = rolling_std(rolling_mean(trend, shift_window), shift_window)
    trend = trend_shift(trend, shift_threshold, {"mean": "mean_compound", "rolling": "rolling_mean"}[shift_on])
    rounded = {c: tx.round_mean(F.col(c)) for c in ("mean_compound", "mean_confidence", "rolling_mean", "rolling_std")}
    return trend.withColumns(rounded).select(
        "period", "mean_compound", "mean_confidence", "ticket_count", "shift_detected", "rolling_mean", "rolling_std"
    )


def daily_trend(df: DataFrame, timestamp_col: str = "created_at", score_col: str = "sentiment_score") -> DataFrame:
    """Mean score per calendar day; days without one are left out."""
    return (
        tx.parse_ts(df.select(timestamp_col, score_col), timestamp_col)
        .groupBy(F.to_date(timestamp_col).alias("day"))
        .agg(F.avg(score_col).alias("mean_score"))
        .filter("mean_score is not null")
    )
