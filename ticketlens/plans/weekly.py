"""The weekly run: load, topics, sentiment, entities, enriched table, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.functions.wordlists import ENTITY_TYPES
from ticketlens.operators import entities as en
from ticketlens.operators import report as rp
from ticketlens.operators import sentiment as se
from ticketlens.operators import tables as tb
from ticketlens.operators import topic_model as tm
from ticketlens.operators import topics as tp
from ticketlens.sources import writers
from ticketlens.plans.manifest import Manifest, file_fingerprint, table_fingerprint
from ticketlens.sources.readers import scan_tickets


@dataclass
class WeeklyConfig:
    """Settings of a run with their defaults."""

    report_title: str = rp.REPORT_TITLE
    reporting_period_days: int | None = None
    ticket_id_col: str = "ticket_id"
    text_col: str = "text"
    timestamp_col: str = "created_at"
    priority_col: str | None = "priority"
    topic_counts: tuple[int, ...] = (5, 10, 20)
    n_topics: int | None = None
    n_components: int = tm.N_COMPONENTS
    min_topic_size: int = tm.MIN_CLUSTER_SIZE
    hybrid_alpha: float = se.HYBRID_ALPHA
    critical_threshold: float = se.CRITICAL_BELOW
    entity_types: tuple[str, ...] = ENTITY_TYPES
    critical_money_threshold: float = en.HIGH_VALUE
    with_entities: bool = True
    include_wordclouds: bool = True
    include_heatmaps: bool = True
    continue_on_error: bool = True
    sentiment_model: Callable[[DataFrame], DataFrame] | None = None
    names: DataFrame | None = None
    fmt: str = "parquet"
    csv_multi_line: bool = True
    resume: bool = False
    model_version: str = ""


@dataclass
class WeeklyResult:
    n_tickets: int = 0
    paths: dict[str, str] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)


def run_weekly(spark: SparkSession, source: str | DataFrame, output: str, config: WeeklyConfig | None = None) -> WeeklyResult:
    """Run all stages and write their tables below ``output``.

    Each stage is written before the next one reads it, so an error shows in the stage that caused it and a
    lost executor costs one stage at most. A failed stage is recorded and the later ones go on without its
    table; a failed load ends the run.

    Runs with ``resume`` note each finished stage. Such a run takes the tables that an earlier one into ``output`` finished from the same input and
    settings as they are, so that it goes on behind the last stage of a killed run. Inputs are compared by the names, lengths and times of files, or by the rows
    of a table. A model cannot be compared: change ``model_version`` with it. A run without ``resume`` makes everything anew.
    """
    cfg = config or WeeklyConfig()
    result = WeeklyResult()

    done = Manifest(spark, f"{output}/manifest")

    def known(name: str, settings: object, *needs: str) -> str | None:
        """None if the stage's table can be taken as it is, else the key to record when it is written."""
        key = done.key(name, settings, *needs)
        if cfg.resume and done.holds(name, key):
            result.reused.append(name)
            return None
        done.start(name)
        return key

    def finish(name: str, key: str) -> None:
        if cfg.resume:
            done.finish(name, key)

    def stage(name: str, build: Callable[[], DataFrame], settings: object, *needs: str) -> DataFrame | None:
        path = f"{output}/stages/{name}"
        try:
            key = known(name, settings, *needs)
            if key is not None:
                build().write.mode("overwrite").parquet(path)
                finish(name, key)
            return spark.read.parquet(path)
        except Exception as error:  # noqa: BLE001 - any failure of a stage is reported, not raised
            done.failed(name)
            if not cfg.continue_on_error:
                raise
            result.errors.append(f"{name} failed: {str(error).splitlines()[0][:300]}")
            return None

    def sink(name: str, write: Callable[[], object], settings: object, *needs: str) -> None:
        try:
            key = known(name, [settings, cfg.fmt], *needs)
            if key is not None:
                write()
                finish(name, key)
            result.paths[name] = f"{output}/{name}"
        except Exception as error:  # noqa: BLE001
            if not cfg.continue_on_error:
                raise
            result.errors.append(f"{name} failed: {str(error).splitlines()[0][:300]}")

    def load() -> None:
        raw = scan_tickets(spark, source, None, *columns, cfg.csv_multi_line) if isinstance(source, str) else tb.map_columns(source, *columns)
        raw = raw.withColumn("text", tx.fill_text(F.col("text")))
        if "created_at" in raw.columns and dict(raw.dtypes)["created_at"] == "string":
            raw = raw.withColumn("created_at", F.try_to_timestamp("created_at").cast("timestamp_ntz"))
        raw.write.mode("overwrite").parquet(f"{output}/stages/tickets")

    try:
        columns = (cfg.ticket_id_col, cfg.text_col, cfg.timestamp_col, cfg.priority_col)
        print_of = file_fingerprint(spark, source) if isinstance(source, str) else table_fingerprint(source) if cfg.resume else []
        key = known("tickets", [print_of, columns, cfg.csv_multi_line])
        if key is not None:
            load()
            finish("tickets", key)
        tickets = spark.read.parquet(f"{output}/stages/tickets")
        result.n_tickets = tickets.count()
    except Exception as error:  # noqa: BLE001
        result.errors.append(f"load failed: {str(error).splitlines()[0][:300]}")
        return result

    def topics() -> DataFrame:
        model = tm.fit_topics(tickets, ks=cfg.topic_counts, n_components=cfg.n_components)
        found = tm.assign_topics(tickets, model, min_cluster_size=cfg.min_topic_size)
        if cfg.n_topics is None:
            return found
        weights = tp.c_tf_idf(tp.term_counts(tickets.join(found, "ticket_id")))
        return tp.reduce_topics(found, tp.topic_similarity(weights), cfg.n_topics)

    def info() -> DataFrame:
        keywords = tp.topic_keywords(tp.c_tf_idf(tp.term_counts(tickets.join(assigned, "ticket_id"))))
        return tp.topic_info(assigned, keywords)

    def sentiment() -> DataFrame:
        # Row-local: the scores are written beside the tickets, and the enriched table needs no join for them.
        return se.analyze_sentiment(
            tickets, model=cfg.sentiment_model, alpha=cfg.hybrid_alpha, critical_threshold=cfg.critical_threshold,
        )

    def mentions() -> DataFrame:
        return en.entity_mentions(en.require_texts(tickets), cfg.names, cfg.entity_types, flat=False)

    fitted = [cfg.topic_counts, cfg.n_components, cfg.min_topic_size, cfg.n_topics]
    listed = [table_fingerprint(cfg.names) if cfg.resume else [], cfg.entity_types]
    assigned = stage("topics", topics, fitted, "tickets")
    named = stage("topic_info", info, [], "tickets", "topics") if assigned is not None else None
    if named is not None:
        sink("topic_summary", lambda: writers.write_topic_summary(named, f"{output}/topic_summary", cfg.fmt), [], "topic_info")
    model = [getattr(cfg.sentiment_model, "__qualname__", str(type(cfg.sentiment_model))), cfg.model_version]
    scored = stage("sentiment", sentiment, [cfg.hybrid_alpha, cfg.critical_threshold, model], "tickets")
    arrays = stage("entities", mentions, listed, "tickets")
    found = None if arrays is None else en.flat_mentions(arrays)
    if found is not None:
        critical = en.critical_entities(found, tickets, high_value=cfg.critical_money_threshold)
        sink("entity_summary", lambda: writers.write_entity_summary(found, f"{output}/entity_summary", critical, cfg.fmt), [cfg.critical_money_threshold], "tickets", "entities")

    def enriched() -> DataFrame:
        return tb.build_enriched(tickets if scored is None else scored, assigned, named, None, arrays if cfg.with_entities else None)

    every = ("tickets", "topics", "topic_info", "sentiment", "entities")
    sink("enriched_tickets", lambda: writers.write_enriched(enriched(), f"{output}/enriched_tickets", cfg.fmt), cfg.with_entities, *every)

    def report() -> None:
        inputs = rp.ReportInputs(
            topics=tb.topics_for_report(assigned, named) if assigned is not None else None,
            sentiment=tb.sentiment_for_report(scored) if scored is not None else None,
            entities=tb.entities_for_report(found) if found is not None else None,
            tickets=tickets.select(*[c for c in ("ticket_id", "created_at", "priority", "text") if c in tickets.columns]),
            threshold=cfg.critical_threshold,
        )
        if cfg.reporting_period_days is not None and "created_at" in tickets.columns:
            inputs.tickets = tb.report_period(inputs.tickets, cfg.reporting_period_days)
            ids = inputs.tickets.select("ticket_id")
            for name in ("topics", "sentiment", "entities"):
                table = getattr(inputs, name)
                if table is not None:
                    setattr(inputs, name, table.join(ids, "ticket_id", "left_semi"))
        facts = rp.report_facts(
            inputs, cfg.report_title, include_wordclouds=cfg.include_wordclouds, include_heatmaps=cfg.include_heatmaps,
            types=cfg.entity_types, days=cfg.reporting_period_days,
        )
        writers.write_report(facts, f"{output}/report")

    shown = [cfg.report_title, cfg.reporting_period_days, cfg.critical_threshold, cfg.include_wordclouds, cfg.include_heatmaps, cfg.entity_types]
    sink("report", report, shown, *every)
    return result
