import pytest

from ticketlens.operators import report as rp
from ticketlens.operators import tables as tb


@pytest.fixture()
def frames(spark):
    topics = spark.createDataFrame([(str(i), i % 3, f"T{i % 3}") for i in range(10)], "ticket_id string, topic int, topic_label string")
    sentiment = spark.createDataFrame(
        [(str(i), "negative" if i < 3 else "positive", -0.6 if i == 0 else 0.2) for i in range(10)],
        "ticket_id string, sentiment_label string, sentiment_score double",
    )
    entities = spark.createDataFrame(
        [("0", "Refund", "ORG"), ("1", "legal", "ORG"), ("1", "Paris", "GPE"), ("2", "Paris", "PERSON"), ("2", "Paris", "GPE"), ("9", "Legal", "ORG")],
        "ticket_id string, entity string, entity_type string",
    )
    tickets = spark.createDataFrame(
        [(str(i), f"2024-01-0{i % 3 + 1}", "Urgent" if i in (0, 5) else "low") for i in range(10)], "ticket_id string, created_at string, priority string"
    )
    return rp.ReportInputs(topics, sentiment, entities, tickets)


def test_critical_tickets_once_with_first_reason(frames):
    got = {r["ticket_id"]: r["flag_reason"] for r in frames.critical().collect()}
    assert got == {
        "0": "High negative sentiment",  # also an entity word and urgent; the score is exactly the threshold
        "1": "Expensive/critical entity mention", "9": "Expensive/critical entity mention", "5": "High priority ticket",
    }
    assert [r["number"] for r in rp.critical_alerts(frames.critical()).collect()] == [1, 2, 3, 4]


def test_more_than_twenty_flags(spark):
    many = spark.createDataFrame([(f"{i:03}", "negative", -0.9) for i in range(30)], "ticket_id string, sentiment_label string, sentiment_score double")
    critical = rp.critical_tickets(many, None, None)
    assert critical.count() == 30
    assert [r["ticket_id"] for r in rp.critical_alerts(critical).collect()] == [f"{i:03}" for i in range(20)]


def test_summary(frames):
    row = rp.executive_summary(frames).first().asDict()
    assert row == {
        "total_tickets": 10, "positive": 7, "neutral": 0, "negative": 3, "avg_sentiment": 0.12, "top_topic": "T0", "top_topic_count": 4,
        "top_topic_pct": "40.0%", "critical_count": 4, "critical_pct": "40.0%",
    }


def test_total_counts_the_largest_table_unless_told(frames, spark):
    frames.entities = spark.createDataFrame([("0", "x", "ORG")] * 25, "ticket_id string, entity string, entity_type string")
    assert rp.executive_summary(frames).first()["total_tickets"] == 25
    assert rp.executive_summary(frames, total="tickets").first()["total_tickets"] == 10


def test_negative_share_of_exactly_thirty_percent_is_no_finding(frames):
    texts = [r["recommendation"] for r in rp.recommendations(frames).orderBy("ord").collect()]
    assert len(texts) == 3
    assert texts[0] == "Focus resources on 'T0' — the leading complaint category accounting for 40.0% of all tickets (4 tickets)."
    assert texts[1].startswith("4 tickets (40.0%) were flagged") and texts[2].startswith("The top 3 complaint categories cover 100.0%")


def test_two_topics_and_negative_mean(frames):
    frames.topics = frames.topics.filter("topic < 2")
    frames.sentiment = frames.sentiment.withColumn("sentiment_score", -frames.sentiment.sentiment_score)
    texts = [r["recommendation"] for r in rp.recommendations(frames).collect()]
    assert not any("top 3" in t for t in texts) and any("average sentiment is negative (-0.12)" in t for t in texts)


def test_nothing_to_recommend(spark):
    empty = rp.ReportInputs(None, spark.createDataFrame([], tb.SENTIMENT_SCHEMA), None)
    assert [r["recommendation"] for r in rp.recommendations(empty).collect()] == [rp.ADVICE_NONE]
    row = rp.executive_summary(empty).first()
    assert (row["top_topic"], row["top_topic_pct"], row["avg_sentiment"], row["total_tickets"]) == ("N/A", "0.0%", None, 0)


def test_pie(spark):
    rows = [(str(n), f"t{k:02}") for k in range(11) for n in range(20 - k)]
    topics = spark.createDataFrame(rows, "ticket_id string, topic_label string")
    pie = {r["topic_label"]: r["count"] for r in rp.pie_with_other(topics).collect()}
    assert pie["Other"] == 12 + 11 + 10 and len(pie) == 9 and sum(pie.values()) == len(rows)
    few = rp.pie_with_other(topics.filter("topic_label < 't08'"))
    assert few.count() == 8 and few.filter("topic_label = 'Other'").count() == 0


def test_type_cooccurrence_is_the_matrix_product(frames, spark):
    got = {(r["type_a"], r["type_b"]): r["count"] for r in rp.type_cooccurrence(frames.entities).collect()}
    # Paris: GPE in two tickets, PERSON in one; Refund, legal and Legal: ORG in one each.
    assert got == {
        ("GPE", "GPE"): 4, ("GPE", "PERSON"): 2, ("PERSON", "GPE"): 2, ("PERSON", "PERSON"): 1, ("ORG", "ORG"): 3,
        ("GPE", "ORG"): 0, ("ORG", "GPE"): 0, ("PERSON", "ORG"): 0, ("ORG", "PERSON"): 0,
    }
    assert rp.type_cooccurrence(frames.entities.filter("entity_type = 'ORG'")).count() == 0
    assert rp.type_cooccurrence(frames.entities.filter("entity = 'Paris'")).count() == 0


def test_sentiment_by_topic_and_trend(frames):
    by_topic = rp.sentiment_by_topic(frames.topics, frames.sentiment).collect()
    assert [(r["topic_label"], round(r["mean_score"], 4), r["sign"]) for r in by_topic] == [("T0", 0.0, 0), ("T1", 0.2, 1), ("T2", 0.2, 1)]
    trend = rp.report_sentiment_trend(frames.sentiment, frames.tickets).collect()
    assert [r["day"].day for r in trend] == [1, 2, 3]
    assert rp.report_sentiment_trend(frames.sentiment, None).count() == 0


def test_merged(frames):
    merged = tb.merged_with_entity_flag(frames.topics, frames.sentiment, frames.entities)
    assert merged.count() == 10 and merged.filter("has_entities").count() == 4
    assert tb.merged_with_entity_flag(None, frames.sentiment, frames.entities) is frames.sentiment
    assert tb.merged_with_entity_flag(None, None, frames.entities) is frames.entities
    assert tb.merged_with_entity_flag(frames.topics.limit(0), frames.sentiment, None) is frames.sentiment
    assert tb.merged_with_entity_flag(None, frames.sentiment.limit(0), frames.entities) is frames.entities


def test_merged_computes_each_table_once(spark, frames):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    once = [t.mapInArrow(counted, t.schema).groupBy(*t.columns).count().filter("count > 0").drop("count") for t in (frames.sentiment, frames.entities)]
    rows = frames.sentiment.count() + frames.entities.count()
    assert tb.merged_with_entity_flag(frames.topics, *once).filter("has_entities").count() == 4
    assert seen.value == rows
    empty = tb.merged_with_entity_flag(frames.topics, frames.sentiment.limit(0), frames.entities.limit(0))
    assert empty.columns == frames.topics.columns


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("a",)], "x string")
    assert [tuple(r) for r in rp.value_counts(df, "x").collect()] == [("a", 2), ("b", 2)]
    assert rp.value_counts(df, "nope").count() == 0


@pytest.mark.parametrize("gone", ["topics", "sentiment", "entities", "tickets"])
def test_facts_with_one_table_missing(frames, gone):
    setattr(frames, gone, None)
    rows = rp.report_facts(frames).collect()
    missing = {r["name"] for r in rows if r["status"] == "no_data"}
    expected = {
        "topics": {"topic_bar", "topic_pie", "topic_words", "sentiment_by_topic"},
        "sentiment": {"sentiment_distribution", "sentiment_trend", "sentiment_by_topic", "topic_words"},
        "entities": {"entity_bar", "entity_by_type", "entity_heatmap", "topic_words"},
        "tickets": {"sentiment_trend", "topic_words", "period"},
    }[gone]
    assert missing == expected
    assert {r["section"] for r in rows} == {0, 1, 2, 3, 4, 5, 6}


def test_section_switches(frames):
    names = {r["name"] for r in rp.report_facts(frames, include_wordclouds=False, include_heatmaps=False).collect()}
    assert "topic_words" not in names and "entity_heatmap" not in names


def test_report_period(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-05",), ("2024-01-08",)], "d string").selectExpr("cast(d as timestamp_ntz) as created_at")
    assert tb.report_period(df).count() == 2
    assert tb.report_period(df, None).count() == 3
    assert tb.report_period(df, 2, end="2024-01-06 00:00:00").count() == 2


def test_enrichment_joins_by_id(spark):
    tickets = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "y")], "ticket_id string, text string")
    topics = spark.createDataFrame([("a", 1), ("c", 2)], "ticket_id string, topic int")
    info = spark.createDataFrame([(1, "one")], "topic int, name string")
    got = {r["ticket_id"]: (r["topic"], r["topic_label"]) for r in tb.build_enriched(tickets, topics, info).collect()}
    assert got == {"a": (1, "one"), "b": (-1, "Unknown"), "c": (2, "Unknown")}
    labels = {r["topic_label"] for r in tb.topics_for_report(topics, info).collect()}
    assert labels == {"one", "Topic_2"}
    assert tb.topics_for_report(None, None, spark).columns == ["ticket_id", "topic", "topic_label"]
    assert tb.sentiment_for_report(None, spark).count() == 0 and tb.entities_for_report(None, spark).count() == 0
