import datetime

import pytest

from ticketlens.operators import trends as tr

SCHEMA = "created_at string, lex_compound double, sentiment_confidence double"


def test_days_gaps_bad_times_and_null_means(spark):
    rows = [
        ("2024-01-01 10:00:00", 0.1, 0.5), ("2024-01-01 12:00:00", None, 0.7), ("2024-01-02 00:00:00", None, 0.1),
        ("2024-01-05 23:59:59", 0.6, 0.1), ("garbage", 0.9, 0.9),
    ]
    out = tr.sentiment_trend(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["period"].day, r["mean_compound"], r["ticket_count"], r["shift_detected"]) for r in out] == [(1, 0.1, 2, False), (5, 0.6, 1, True)]


def test_change_of_exactly_the_threshold_is_no_shift(spark):
    rows = [("2024-01-01", 0.1, 0.0), ("2024-01-02", 0.4, 0.0), ("2024-01-03", 0.05, 0.0)]
    out = tr.sentiment_trend(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["shift_detected"] for r in out] == [False, False, True]


def test_rolling_and_shift_on_rolling(spark):
    rows = [(f"2024-01-0{i + 1}", v, 0.0) for i, v in enumerate([0.0, 0.9, 0.0, 0.0])]
    out = tr.sentiment_trend(spark.createDataFrame(rows, SCHEMA), shift_on="rolling").collect()
    assert [r["rolling_mean"] for r in out] == [0.0, 0.45, 0.3, 0.3]
    assert out[0]["rolling_std"] == 0.0
    assert [r["shift_detected"] for r in out] == [False, True, False, False]


def test_week_is_named_by_its_sunday(spark):
    rows = [("2024-01-07 23:00:00", 0.1, 0.0), ("2024-01-08 00:00:00", 0.2, 0.0)]
    out = tr.sentiment_trend(spark.createDataFrame(rows, SCHEMA), freq="W").collect()
    assert [r["period"].date() for r in out] == [datetime.date(2024, 1, 7), datetime.date(2024, 1, 14)]
    with pytest.raises(ValueError):
        tr.sentiment_trend(spark.createDataFrame(rows, SCHEMA), freq="Q")


def test_no_rows(spark):
    assert tr.sentiment_trend(spark.createDataFrame([], SCHEMA)).count() == 0
