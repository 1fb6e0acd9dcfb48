"""The tables of the weekly report. Inputs: topics, sentiment, entities, tickets, each keyed by ticket_id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.functions.wordlists import (
    CRITICAL_ENTITY_WORDS, CRITICAL_PRIORITIES, ENTITY_TYPES, FLAG_REASONS, TEXT_COLUMNS, TIME_COLUMNS, TOPIC_COLUMNS,
)
from ticketlens.operators.topics import topic_word_counts
from ticketlens.operators.trends import daily_trend
from ticketlens.session import small_table

# --- Fixed values ---------------------------------------------------------------------
REPORT_TITLE = "Weekly Customer Support Intelligence Report"
CRITICAL_AT_MOST = -0.6
TOPIC_BAR, PIE_TOPICS, ENTITY_BAR, TYPE_BAR, ALERTS = 12, 8, 15, 10, 20
OTHER = "Other"
NO_TOPIC = "N/A"
NEGATIVE_SHARE = 30
LEADING_TOPICS = 3
ADVICE_LEADING = "Focus resources on '%s' — the leading complaint category accounting for %s of all tickets (%,d tickets)."
ADVICE_NEGATIVE_MEAN = (
    "Overall average sentiment is negative (%.2f). "
    "Investigate systemic service gaps driving customer dissatisfaction."
)
ADVICE_CRITICAL = (
    "%d tickets (%s) were flagged as critical. "
    "Prioritise immediate follow-up and root-cause analysis on these."
)
ADVICE_NEGATIVE_SHARE = (
    "Negative sentiment accounts for %.1f%% of tickets — above the 30%% threshold. "
    "Recommend an urgent cross-functional review."
)
ADVICE_TOP_THREE = (
    "The top 3 complaint categories cover %.1f%% of tickets. "
    "Tackling these will yield the highest impact."
)
ADVICE_NONE = "Insufficient data to generate automated recommendations. Continue data collection."


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of non-null values, most frequent first. A missing column gives no rows."""
    if col not in df.columns:
        return df.sparkSession.createDataFrame([], "value string, count bigint")
    return (
        df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def topic_column(topics: DataFrame) -> str:
    return tx.first_present(topics, TOPIC_COLUMNS) or "topic_label"


def topic_counts(topics: DataFrame) -> DataFrame:
    counts = value_counts(topics, topic_column(topics))
    return counts.select(F.col("value").cast("string").alias("topic_label"), "count")


def topic_bar(topics: DataFrame, n: int = TOPIC_BAR) -> DataFrame:
    return topic_counts(topics).orderBy(F.desc("count"), "topic_label").limit(n)


def pie_with_other(topics: DataFrame, n: int = PIE_TOPICS) -> DataFrame:
    """The n largest topics, the rest summed as Other, and shares of the total as text."""
    counts = topic_counts(topics)
    top = counts.orderBy(F.desc("count"), "topic_label").limit(n)
    totals = counts.agg(F.sum("count").alias("total"), F.count("*").alias("labels"))
    rest = totals.filter(F.col("labels") > n).select(
        F.lit(OTHER).alias("topic_label"), (F.col("total") - top.agg(F.sum("count")).scalar()).alias("count")
    )
    total = totals.select("total").scalar()
    return append_other(top, rest).withColumn("share", tx.pct(F.col("count"), total))


def append_other(top: DataFrame, rest: DataFrame) -> DataFrame:
    return top.unionByName(rest)


def sentiment_distribution(sentiment: DataFrame) -> DataFrame:
    return value_counts(sentiment, "sentiment_label").select(F.col("value").alias("sentiment_label"), "count")


def sentiment_with_timestamp(sentiment: DataFrame, tickets: DataFrame | None) -> DataFrame | None:
    """Sentiment with a time column named created_at: its own, or that of the tickets. None without any."""
    own = tx.first_present(sentiment, TIME_COLUMNS)
    if own is not None:
        return sentiment.withColumnRenamed(own, "created_at")
    other = tx.first_present(tickets, TIME_COLUMNS) if tickets is not None else None
    if other is None:
        return None
    return sentiment.join(tickets.select("ticket_id", F.col(other).alias("created_at")), "ticket_id", "left")


def report_sentiment_trend(sentiment: DataFrame, tickets: DataFrame | None) -> DataFrame:
    dated = sentiment_with_timestamp(sentiment, tickets)
    if dated is None or "sentiment_score" not in sentiment.columns:
        return sentiment.sparkSession.createDataFrame([], "day date, mean_score double")
    return daily_trend(dated).orderBy("day")


def topic_sentiment_join(topics: DataFrame, sentiment: DataFrame) -> DataFrame:
    label = F.col(topic_column(topics)).cast("string").alias("topic_label")
    return topics.select("ticket_id", label).join(sentiment.select("ticket_id", "sentiment_score"), "ticket_id")


def sentiment_by_topic(topics: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Mean score per topic, lowest first, with its sign."""
    means = topic_sentiment_join(topics, sentiment).groupBy("topic_label").agg(F.avg("sentiment_score").alias("mean_score"))
    return (
        means.filter("mean_score is not null and topic_label is not null")
        .withColumn("sign", F.signum(F.round("mean_score", 9)).cast("int"))
        .orderBy(F.round("mean_score", 9), "topic_label")
    )


def entity_bar(entities: DataFrame, n: int = ENTITY_BAR) -> DataFrame:
    counts = value_counts(entities, "entity").withColumnRenamed("value", "entity")
    return counts.orderBy(F.desc("count"), "entity").limit(n)


def entity_by_type(entities: DataFrame, n: int = TYPE_BAR) -> DataFrame:
    counts = value_counts(entities, "entity_type").withColumnRenamed("value", "entity_type")
    return counts.orderBy(F.desc("count"), "entity_type").limit(n)


def type_entity_pivot(entities: DataFrame) -> DataFrame:
    """(entity_type, entity, tickets): distinct tickets, kept long."""
    once = entities.filter("entity is not null and entity_type is not null").select("entity_type", "entity", "ticket_id").distinct()
    return once.groupBy("entity_type", "entity").agg(F.count("ticket_id").alias("tickets"))


def type_cooccurrence(entities: DataFrame, types: Sequence[str] = ENTITY_TYPES) -> DataFrame:
    """(type_a, type_b, count): over entity texts, the product of their ticket counts under both types.

    Counts are laid out as one column per type and entity text, so the matrix is a set of plain sums: no
    self-join and no pairs of rows. Empty unless two types and two texts are there.
    """
    types = sorted(types)
    columns = [F.sum(F.when(F.col("entity_type") == t, F.col("tickets"))).alias(f"t{i}") for i, t in enumerate(types)]
    wide = type_entity_pivot(entities).filter(F.col("entity_type").isin(types)).groupBy("entity").agg(*columns)
    present = [F.max(F.col(f"t{i}").isNotNull()).alias(f"has{i}") for i in range(len(types))]
    sums = [
        F.sum(F.coalesce(f"t{i}", F.lit(0)) * F.coalesce(f"t{j}", F.lit(0))).alias(f"s{i}_{j}")
        for i in range(len(types)) for j in range(i, len(types))
    ]
    totals = wide.agg(F.count("*").alias("texts"), *present, *sums)
    cells = F.array(*[
        F.struct(
            F.lit(types[i]).alias("type_a"), F.lit(types[j]).alias("type_b"),
            F.col(f"s{min(i, j)}_{max(i, j)}").alias("count"), (F.col(f"has{i}") & F.col(f"has{j}")).alias("present"),
        )
        for i in range(len(types)) for j in range(len(types))
    ])
    kinds = sum((F.col(f"has{i}").cast("int") for i in range(len(types))), F.lit(0))
    return totals.filter((F.col("texts") >= 2) & (kinds >= 2)).select(F.inline(cells)).filter("present").drop("present")


def critical_tickets(
    sentiment: DataFrame | None, entities: DataFrame | None, tickets: DataFrame | None, threshold: float = CRITICAL_AT_MOST
) -> DataFrame:
    """Tickets flagged by score, entity word or priority; each once, with its first reason.

    Rows of one ticket are reduced to the smallest (source, tie) before the shuffle.
    """
    frames = []
    if sentiment is not None and "sentiment_score" in sentiment.columns:
        frames.append(sentiment.filter(F.col("sentiment_score") <= threshold).select("ticket_id", F.lit(0).alias("source"), "sentiment_score"))
    if entities is not None and "entity" in entities.columns:
        frames.append(
            entities.filter(tx.keyword_in(F.col("entity"), CRITICAL_ENTITY_WORDS)).select("ticket_id", F.lit(1).alias("source"), "entity")
        )
    if tickets is not None and "priority" in tickets.columns:
        frames.append(
            tickets.filter(tx.keyword_in(F.col("priority"), CRITICAL_PRIORITIES)).select("ticket_id", F.lit(2).alias("source"), "priority")
        )
    some = next(t for t in (sentiment, entities, tickets) if t is not None)
    if not frames:
        return some.sparkSession.createDataFrame([], "ticket_id string, flag_reason string")
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return first_flag_per_ticket(union)


def first_flag_per_ticket(flags: DataFrame) -> DataFrame:
    details = [c for c in flags.columns if c not in ("ticket_id", "source")]
    first = flags.groupBy("ticket_id").agg(F.min(F.struct("source", *details)).alias("f"))
    reason = F.element_at(F.array(*[F.lit(r) for r in FLAG_REASONS]), F.col("f.source") + 1)
    return first.select("ticket_id", reason.alias("flag_reason"), *[f"f.{c}" for c in details], F.col("f.source").alias("source_rank"))


def critical_alerts(critical: DataFrame, n: int = ALERTS) -> DataFrame:
    """The first flagged tickets, numbered."""
    first = critical.orderBy("source_rank", "ticket_id").limit(n)
    return first.select(
        F.row_number().over(W.orderBy("source_rank", "ticket_id")).alias("number"),
        F.col("ticket_id").cast("string").alias("ticket_id"), F.col("flag_reason").alias("reason"),
    )


@dataclass
class ReportInputs:
    """The four tables of a report; None stands for a stage that gave nothing."""

    topics: DataFrame | None
    sentiment: DataFrame | None
    entities: DataFrame | None
    tickets: DataFrame | None = None
    threshold: float = CRITICAL_AT_MOST

    @property
    def spark(self):
        return next(t for t in (self.topics, self.sentiment, self.entities, self.tickets) if t is not None).sparkSession

    def critical(self) -> DataFrame:
        return critical_tickets(self.sentiment, self.entities, self.tickets, self.threshold)


def executive_summary(inputs: ReportInputs, total: str = "largest") -> DataFrame:
    """One row with the headline numbers. ``total="tickets"`` counts tickets instead of the largest table."""
    one = inputs.spark.range(1)

    def rows(df: DataFrame | None) -> Column:
        return F.lit(0).cast("bigint") if df is None else df.agg(F.count("*")).scalar()

    n_tickets = rows(inputs.tickets)
    if total == "tickets":
        counted = n_tickets
    else:
        largest = F.greatest(rows(inputs.topics), rows(inputs.sentiment), rows(inputs.entities))
        counted = F.when(largest > 0, largest).otherwise(n_tickets)
    if inputs.sentiment is None:
        mood = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("positive", "neutral", "negative")], F.lit(None).cast("double").alias("avg"))
    else:
        mean = F.avg("sentiment_score") if "sentiment_score" in inputs.sentiment.columns else F.lit(None).cast("double")
        mood = inputs.sentiment.agg(
            *[F.count_if(F.coalesce(F.col("sentiment_label") == c, F.lit(False))).alias(c) for c in ("positive", "neutral", "negative")],
            tx.round_mean(mean, 3).alias("avg"),
        ).select(F.struct("*")).scalar()
    if inputs.topics is None:
        top = F.lit(None).cast("struct<topic_label:string,count:bigint>")
    else:
        first = topic_counts(inputs.topics).orderBy(F.desc("count"), "topic_label").limit(1)
        top = first.select(F.struct("topic_label", "count")).scalar()
    critical = inputs.critical().agg(F.count("*")).scalar()
    picked = one.select(counted.alias("total_tickets"), mood.alias("mood"), top.alias("top"), critical.alias("critical_count"))
    return picked.select(
        "total_tickets", "mood.positive", "mood.neutral", "mood.negative", F.col("mood.avg").alias("avg_sentiment"),
        F.coalesce("top.topic_label", F.lit(NO_TOPIC)).alias("top_topic"),
        F.coalesce("top.count", F.lit(0)).alias("top_topic_count"),
        tx.pct(F.coalesce("top.count", F.lit(0)), F.col("total_tickets")).alias("top_topic_pct"),
        "critical_count", tx.pct(F.col("critical_count"), F.col("total_tickets")).alias("critical_pct"),
    )


def recommendations(inputs: ReportInputs, total: str = "largest", summary: DataFrame | None = None) -> DataFrame:
    """(ord, recommendation) from threshold rules over the summary row."""
    row = summary if summary is not None else executive_summary(inputs, total)
    if inputs.topics is None:
        top = F.lit(None).cast("struct<labels:bigint,covered:bigint>")
    else:
        leading = topic_counts(inputs.topics).orderBy(F.desc("count"), "topic_label").limit(LEADING_TOPICS)
        top = leading.agg(F.struct(F.count("*").alias("labels"), F.sum("count").alias("covered"))).scalar()
    row = row.withColumn("_top", top)
    whole = F.nullif(F.col("total_tickets"), F.lit(0))
    negative = F.coalesce(F.col("negative") / whole * 100, F.lit(0.0))
    covered = F.coalesce(F.col("_top.covered") / whole * 100, F.lit(0.0))
    rules = F.array_compact(F.array(
        F.when(
            F.col("top_topic") != NO_TOPIC,
            F.format_string(ADVICE_LEADING, "top_topic", "top_topic_pct", "top_topic_count"),
        ),
        F.when(F.col("avg_sentiment") < 0, F.format_string(ADVICE_NEGATIVE_MEAN, F.round("avg_sentiment", 2))),
        F.when(F.col("critical_count") > 0, F.format_string(ADVICE_CRITICAL, "critical_count", "critical_pct")),
        F.when(negative > NEGATIVE_SHARE, F.format_string(ADVICE_NEGATIVE_SHARE, F.round(negative, 1))),
        F.when(F.col("_top.labels") >= LEADING_TOPICS, F.format_string(ADVICE_TOP_THREE, F.round(covered, 1))),
    ))
    listed = F.when(F.size(rules) > 0, rules).otherwise(F.array(F.lit(ADVICE_NONE)))
    return row.select(F.posexplode(listed).alias("ord", "recommendation")).withColumn("ord", F.col("ord") + 1)


# --- Fixed values: report sections, with what is written where one has no rows ---------
SECTIONS = (
    (0, "period", "No period"),
    (1, "executive_summary", "No data available"),
    (2, "topic_bar", "No topic data available"),
    (2, "topic_pie", "No topic data available"),
    (2, "topic_words", "No words to count"),
    (3, "sentiment_distribution", "No sentiment labels available"),
    (3, "sentiment_trend", "Insufficient data for daily trend"),
    (3, "sentiment_by_topic", "Insufficient data for topic-sentiment comparison"),
    (4, "entity_bar", "No entity data available"),
    (4, "entity_by_type", "No entity type data available"),
    (4, "entity_heatmap", "Not enough variety for entity co-occurrence heatmap"),
    (5, "critical_alerts", "No critical alerts this period."),
    (6, "recommendations", "No recommendations"),
)


def report_facts(
    inputs: ReportInputs,
    title: str = REPORT_TITLE,
    total: str = "largest",
    include_wordclouds: bool = True,
    include_heatmaps: bool = True,
    types: Sequence[str] = ENTITY_TYPES,
    days: int | None = None,
) -> DataFrame:
    """The report as one table: (section, name, ord, key, value, number, status, title).

    Sections without rows are listed with status ``no_data``. ``days`` is the period that the inputs were cut to; None means that they
    hold everything, so that the heading names their first and last day.
    """
    parts: list[DataFrame] = []

    def add(name: str, df: DataFrame, key: Column, value: Column, number: Column, order: list) -> None:
        at = F.row_number().over(W.orderBy(*order))
        parts.append(
            df.select(
                F.lit(name).alias("name"), at.alias("ord"), key.cast("string").alias("key"),
                value.cast("string").alias("value"), number.cast("double").alias("number"),
            )
        )

    none = F.lit(None)
    if inputs.tickets is not None and "created_at" in inputs.tickets.columns:
        span = report_period_facts(inputs.tickets, days).filter("period_end is not null")
        ends = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(c).alias("k"), F.col(c).alias("v")) for i, c in enumerate(span.columns)])
        add("period", span.select(F.inline(ends)), F.col("k"), F.col("v"), none, ["n"])
    summary = executive_summary(inputs, total)
    fields = [c for c in summary.columns]
    numeric = {c for c in fields if c not in ("top_topic", "top_topic_pct", "critical_pct")}
    lines = F.array(*[
        F.struct(
            F.lit(i + 1).alias("n"), F.lit(c).alias("k"), F.col(c).cast("string").alias("v"),
            (F.col(c) if c in numeric else none).cast("double").alias("x"),
        )
        for i, c in enumerate(fields)
    ])
    add("executive_summary", summary.select(F.inline(lines)), F.col("k"), F.col("v"), F.col("x"), ["n"])
    if inputs.topics is not None:
        by_count = [F.desc("count"), "topic_label"]
        add("topic_bar", topic_bar(inputs.topics), F.col("topic_label"), none, F.col("count"), by_count)
        pie = pie_with_other(inputs.topics).withColumn("rest", F.col("topic_label") == OTHER)
        add("topic_pie", pie, F.col("topic_label"), F.col("share"), F.col("count"), ["rest", *by_count])
        text_source = inputs.topics if tx.first_present(inputs.topics, TEXT_COLUMNS) else inputs.tickets
        text_col = tx.first_present(text_source, TEXT_COLUMNS) if text_source is not None else None
        if include_wordclouds and text_col is not None:
            words = topic_word_counts(
                inputs.topics, None if text_source is inputs.topics else inputs.tickets,
                label_col=topic_column(inputs.topics), text_col=text_col,
            )
            key = F.concat_ws(": ", "topic_label", "word")
            add("topic_words", words, key, none, F.col("count"), ["topic_label", "rank"])
    if inputs.sentiment is not None:
        add(
            "sentiment_distribution", sentiment_distribution(inputs.sentiment), F.col("sentiment_label"), none, F.col("count"),
            [F.desc("count"), "sentiment_label"],
        )
        add("sentiment_trend", report_sentiment_trend(inputs.sentiment, inputs.tickets), F.col("day"), none, tx.round_mean(F.col("mean_score")), ["day"])
    if inputs.sentiment is not None and inputs.topics is not None:
        add(
            "sentiment_by_topic", sentiment_by_topic(inputs.topics, inputs.sentiment), F.col("topic_label"), F.col("sign"),
            tx.round_mean(F.col("mean_score")), [F.round("mean_score", 9), "topic_label"],
        )
    if inputs.entities is not None:
        add("entity_bar", entity_bar(inputs.entities), F.col("entity"), none, F.col("count"), [F.desc("count"), "entity"])
        add("entity_by_type", entity_by_type(inputs.entities), F.col("entity_type"), none, F.col("count"), [F.desc("count"), "entity_type"])
        if include_heatmaps:
            add(
                "entity_heatmap", type_cooccurrence(inputs.entities, types), F.concat_ws(" x ", "type_a", "type_b"), none, F.col("count"),
                ["type_a", "type_b"],
            )
    add("critical_alerts", critical_alerts(inputs.critical()), F.col("ticket_id"), F.col("reason"), none, ["number"])
    add("recommendations", recommendations(inputs, total, summary), none, F.col("recommendation"), none, ["ord"])

    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part)
    skipped = {n for n, on in (("topic_words", include_wordclouds), ("entity_heatmap", include_heatmaps)) if not on}
    listed = [s for s in SECTIONS if s[1] not in skipped]
    sections = small_table(inputs.spark, listed, "section int, name string, missing string")
    return sections.join(facts, "name", "left").select(
        "section", "name", F.coalesce("ord", F.lit(1)).alias("ord"), "key",
        F.when(F.col("ord").isNull(), F.col("missing")).otherwise(F.col("value")).alias("value"), "number",
        F.when(F.col("ord").isNull(), "no_data").otherwise("ok").alias("status"), F.lit(title).alias("title"),
    )


def report_period_facts(tickets: DataFrame, days: int | None = None) -> DataFrame:
    """(period_start, period_end): the span named in the header of the report, the last ``days`` or, with None, first to last day. One row, of nulls
    if no ticket has a time."""
    at = F.to_date(F.col("created_at").try_cast("timestamp_ntz"))
    start = F.min(at) if days is None else F.date_sub(F.max(at), days)
    return tickets.agg(start.alias("period_start"), F.max(at).alias("period_end"))
