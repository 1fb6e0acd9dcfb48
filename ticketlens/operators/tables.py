"""Whole-table operators: column mapping, validation, enrichment, report inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.session import materialise

# --- Fixed values ---------------------------------------------------------------------
UNKNOWN_TOPIC = "Unknown"
OUTLIER = -1
REPORT_DAYS = 7
SENTIMENT_COLUMNS = ("sentiment_label", "sentiment_confidence", "lex_compound", "model_score", "is_critical")

TOPICS_SCHEMA = "ticket_id string, topic int, topic_label string"
SENTIMENT_SCHEMA = "ticket_id string, sentiment_label string, sentiment_score double"
ENTITIES_SCHEMA = "ticket_id string, entity string, entity_type string"


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


def map_columns(
    df: DataFrame, ticket_id: str = "ticket_id", text: str = "text", created_at: str = "created_at", priority: str | None = "priority"
) -> DataFrame:
    """Rename configured columns to the standard names; time and priority may be absent."""
    require_columns(df, [ticket_id, text])
    names = {ticket_id: "ticket_id", text: "text", created_at: "created_at"}
    if priority:
        names[priority] = "priority"
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and old != new})


def validate_tickets(df: DataFrame, text_col: str = "text", observation: Observation | None = None) -> DataFrame:
    """Strip the text, drop missing and blank texts, then whole-row duplicates.

    An observation receives the number of rows read and of rows with text, without a second pass.
    """
    require_columns(df, [text_col])
    if observation is not None:
        df = df.observe(observation, F.count("*").alias("rows_in"), F.count_if(tx.has_text(F.col(text_col))).alias("rows_with_text"))
    return tx.drop_blank(df, text_col).distinct()


def validation_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: rows given, kept and dropped by ``validate_tickets``."""
    kept = validate_tickets(df, text_col).agg(F.count("*").alias("kept_rows"))
    return kept.withColumn("initial_rows", df.agg(F.count("*")).scalar()).withColumn(
        "dropped_rows", F.col("initial_rows") - F.col("kept_rows")
    )


def enrich_topic(tickets: DataFrame, topics: DataFrame) -> DataFrame:
    """Attach the topic; tickets without one get -1."""
    return tickets.join(topics.select("ticket_id", "topic"), "ticket_id", "left").withColumn(
        "topic", F.coalesce("topic", F.lit(OUTLIER))
    )


def topic_label_map(df: DataFrame, info: DataFrame, fallback: str | None = UNKNOWN_TOPIC) -> DataFrame:
    """Attach the topic name. Without a fallback text, an unnamed topic becomes ``Topic_<number>``."""
    names = info.select("topic", F.col("name").alias("topic_label"))
    other = F.lit(fallback) if fallback is not None else F.concat(F.lit("Topic_"), F.col("topic").cast("string"))
    return df.join(names, "topic", "left").withColumn("topic_label", F.coalesce("topic_label", other))


def enrich_sentiment(tickets: DataFrame, sentiment: DataFrame) -> DataFrame:
    columns = [c for c in SENTIMENT_COLUMNS if c in sentiment.columns]
    return tickets.join(sentiment.select("ticket_id", *columns), "ticket_id", "left")


def build_enriched(
    tickets: DataFrame,
    topics: DataFrame | None = None,
    info: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """Tickets with topic, topic label, sentiment columns and, when given, the entity arrays."""
    # The narrow tables meet first, so that the texts are joined once.
    beside = None if topics is None else topics.select("ticket_id", "topic")
    if entities is not None:
        arrays = entities.select("ticket_id", "entities")
        beside = arrays if beside is None else beside.join(arrays, "ticket_id", "full")
    out = tickets if beside is None else tickets.join(beside, "ticket_id", "left")
    if topics is not None:
        out = out.withColumn("topic", F.coalesce("topic", F.lit(OUTLIER)))
        out = topic_label_map(out, info) if info is not None else out.withColumn("topic_label", F.lit(UNKNOWN_TOPIC))
    if sentiment is not None:
        out = enrich_sentiment(out, sentiment)
    added = [c for c in out.columns if c not in tickets.columns]
    return out.select(*tickets.columns, *added)


def merged_with_entity_flag(topics: DataFrame | None, sentiment: DataFrame | None, entities: DataFrame | None) -> DataFrame | None:
    """Topics with sentiment beside them and a flag for tickets that have entities. Without topics, the first of sentiment and
    entities that has rows. No table and an empty one are the same."""
    if topics is None or topics.isEmpty():
        return next((t for t in (sentiment, entities) if t is not None and not t.isEmpty()), None)
    # What is joined is written first: to ask for one row of a table that is still to be computed costs most of the computation.
    out = topics
    if sentiment is not None and "sentiment_label" in sentiment.columns:
        keep = [c for c in ("ticket_id", "sentiment_label", "sentiment_score") if c in sentiment.columns]
        scores = materialise(sentiment.select(keep), "merged-scores")
        if not scores.isEmpty():
            out = out.join(scores, "ticket_id", "left")
    if entities is not None:
        with_any = materialise(entities.select("ticket_id").distinct(), "merged-ids")
        if not with_any.isEmpty():
            with_any = with_any.withColumn("_any", F.lit(True))
            out = out.join(with_any, "ticket_id", "left").withColumn("has_entities", F.col("_any").isNotNull()).drop("_any")
    return out


def topics_for_report(df: DataFrame | None, info: DataFrame | None, spark=None) -> DataFrame:
    if df is None:
        return spark.createDataFrame([], TOPICS_SCHEMA)
    if info is None:
        labelled = df.withColumn("topic_label", F.concat(F.lit("Topic_"), F.col("topic").cast("string")))
    else:
        labelled = topic_label_map(df, info, None)
    return labelled.select("ticket_id", F.col("topic").cast("int").alias("topic"), "topic_label")


def sentiment_for_report(df: DataFrame | None, spark=None, score_col: str = "lex_compound") -> DataFrame:
    if df is None:
        return spark.createDataFrame([], SENTIMENT_SCHEMA)
    return df.select("ticket_id", "sentiment_label", F.col(score_col).alias("sentiment_score"))


def entities_for_report(df: DataFrame | None, spark=None) -> DataFrame:
    if df is None:
        return spark.createDataFrame([], ENTITIES_SCHEMA)
    return df.select("ticket_id", "entity", "entity_type")


def report_period(df: DataFrame, days: int | None = REPORT_DAYS, end=None, time_col: str = "created_at") -> DataFrame:
    """Rows of the last days before ``end`` (default: the latest time in the table). None keeps all rows."""
    if days is None:
        return df
    last = F.lit(end).cast("timestamp_ntz") if end is not None else df.agg(F.max(time_col)).scalar()
    return df.filter(F.col(time_col) > last - F.make_dt_interval(days=F.lit(days)))
