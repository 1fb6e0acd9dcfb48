"""The query catalog: each entry is a Spark query over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import text as tx
from ticketlens.functions.wordlists import LEXICON, NEGATIONS
from ticketlens.operators import density as dn
from ticketlens.operators import entities as en
from ticketlens.operators import grammar as gr
from ticketlens.operators import keywords as kw
from ticketlens.operators import model as md
from ticketlens.operators import report as rp
from ticketlens.operators import sentiment as se
from ticketlens.operators import tables as tb
from ticketlens.operators import tagger as tg
from ticketlens.operators import topic_model as tm
from ticketlens.operators import topics as tp
from ticketlens.operators import trends as tr
from ticketlens.plans import oracle as orc
from ticketlens.plans.oracle import _clean, _hybrid, _label, _mean, _pct, _strip, compose
from ticketlens.plans.weekly import WeeklyConfig, run_weekly
from ticketlens.session import materialise, scratch_path, small_table, spread
from ticketlens.sources import readers, writers
from ticketlens.sources.sample import CATEGORIES, CHANNELS, ticket_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Types of the given tables that are read by most queries, so that no file has to be opened to find them.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


class Source:
    """The given tables and the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def tickets(self) -> DataFrame:
        t = self.table
        return ticket_source(spread(t("orders")), t("customer"), t("supplier"), t("part"), t("nation"))

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"))

    @cached_property
    def messy(self) -> DataFrame:
        """Tickets with missing, blank, short and untidy texts mixed in."""
        n = F.substring("ticket_id", 5, 20).cast("bigint")
        kind = F.col("n") % 10
        text = (
            F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, "   ").when(kind == 3, " x ")
            .when(kind == 4, F.concat(F.lit("\t"), "text", F.lit("\n\n")))
            .when(kind == 5, F.replace("text", F.lit(" "), F.lit("\u00a0 ")))
            .when(kind == 6, F.concat(F.lit("\x01"), "text", F.lit("\x7f")))
            .when(kind == 7, " ab").otherwise(F.col("text"))
        )
        return self.tickets.select("ticket_id", "created_at", n.alias("n"), "text").withColumn("text", text)

    @cached_property
    def scored(self) -> DataFrame:
        return se.analyze_sentiment(self.tickets)

    @cached_property
    def names(self) -> DataFrame:
        extra = small_table(self.spark, [("legal",), ("safety",), ("harbour street depot",)], "name string")
        return en.gazetteer(
            (self.table("part"), "p_name", "PRODUCT"), (self.table("nation"), "n_name", "GPE"), (self.table("supplier"), "s_name", "ORG"),
            (self.table("customer"), "c_name", "PERSON"), (extra, "name", "ORG"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        return en.entity_mentions(self.tickets, self.names)

    @cached_property
    def labelled(self) -> DataFrame:
        """Tickets with category and channel as their topic."""
        def number(col: str, values: list[str]):
            out = F.when(F.col(col) == values[0], 0)
            for i, v in enumerate(values[1:], 1):
                out = out.when(F.col(col) == v, i)
            return out

        topic = number("category", [c for c, _, _ in CATEGORIES]) * 5 + number("channel", [c for c, _ in CHANNELS])
        return self.tickets.withColumns({"topic": topic.cast("int"), "topic_label": F.concat_ws("/", "category", "channel")})

    @cached_property
    def topics(self) -> DataFrame:
        return self.labelled.select("ticket_id", "topic", "topic_label")

    @cached_property
    def sentiment(self) -> DataFrame:
        return tb.sentiment_for_report(self.scored)

    @cached_property
    def entities(self) -> DataFrame:
        return tb.entities_for_report(self.mentions)

    @cached_property
    def ticket_terms(self) -> DataFrame:
        return tp.term_counts(self.labelled)

    @cached_property
    def embedded(self) -> DataFrame:
        return spread(self.table("embeddings")).select("vec_id", F.col("label").alias("topic"), "embedding")

    @cached_property
    def embedded_texts(self) -> DataFrame:
        docs = self.documents.select(F.col("doc_id").alias("vec_id"), "text")
        return self.embedded.join(docs, "vec_id")

    @cached_property
    def centroids(self) -> DataFrame:
        return tm.topic_centroids(self.embedded)

    def written(self) -> Source:
        """The same source with its tickets written, for queries that take several tables from them."""
        base = Source(self.spark, self.folder)
        base.tickets = materialise(self.tickets, "tickets")
        return base

    def inputs(self, written: bool = False) -> rp.ReportInputs:
        """Report inputs; written ones are computed once for all the sections that read them."""
        if not written:
            return rp.ReportInputs(self.topics, self.sentiment, self.entities, self.tickets.select("ticket_id", "created_at", "priority", "text"))
        base = self.written()
        sentiment = materialise(base.sentiment, "sentiment")
        entities = materialise(base.entities, "entities")
        return rp.ReportInputs(base.topics, sentiment, entities, base.tickets.select("ticket_id", "created_at", "priority", "text"))


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Source(spark, folder))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return build

    return register


def _round(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: tx.round_mean(F.col(c), digits) for c in cols})


_TICKET_COLS = "ticket_id, text, created_at, priority, channel, category"


# --- Sources and sinks ------------------------------------------------------------------

def _text_time(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))


def _typed(df: DataFrame) -> DataFrame:
    return tx.parse_ts(df).select("ticket_id", "text", "created_at", "priority", "channel", "category")


@query("ticket_source", f"SELECT {_TICKET_COLS} FROM tickets")
def _(s):
    return s.tickets


_LINES = "SELECT ticket_id, replace(text, ' ', chr(10)) AS text, created_at, priority, channel, category FROM tickets"


@query("scan_csv", _LINES)
def _(s):
    path = scratch_path(s.spark, "tickets") + ".csv"
    lines = _text_time(s.tickets).withColumn("text", F.replace("text", F.lit(" "), F.lit("\n")))
    lines.write.option("header", True).option("escape", '"').csv(path)
    return _typed(readers.scan_csv(s.spark, path, readers.TICKET_SCHEMA))


@query("scan_json", f"SELECT {_TICKET_COLS} FROM tickets")
def _(s):
    # Every file is one JSON array of some thousand records; the number of files grows with the table.
    path = scratch_path(s.spark, "tickets") + ".json"
    files = max(s.table("orders").count() // 5000, 2)
    rows = _text_time(s.tickets).select(F.pmod(F.xxhash64("ticket_id"), F.lit(files)).alias("part"), F.struct("*").alias("r"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("part").text(path)
    return _typed(readers.scan_json(s.spark, path, readers.TICKET_SCHEMA))


@query("scan_jsonl", f"SELECT {_TICKET_COLS} FROM tickets")
def _(s):
    path = scratch_path(s.spark, "tickets") + ".jsonl"
    _text_time(s.tickets).write.json(path)
    return _typed(readers.scan_jsonl(s.spark, path, readers.TICKET_SCHEMA))


_KEPT = f"SELECT DISTINCT ticket_id, created_at, n, {_strip('text')} AS text FROM messy WHERE length({_strip('text')}) > 0"


@query("load_tickets", _KEPT)
def _(s):
    path = scratch_path(s.spark, "tickets") + ".parquet"
    s.messy.write.parquet(path)
    return readers.load_tickets(s.spark, path)


@query("require_columns", f"SELECT {_TICKET_COLS} FROM tickets")
def _(s):
    return tb.require_columns(s.tickets, ["ticket_id", "text"])


@query("map_columns", "SELECT CAST(doc_id AS VARCHAR) AS ticket_id, text, lang AS priority, source, n_chars FROM documents")
def _(s):
    docs = s.documents.withColumn("doc_id", F.col("doc_id").cast("string"))
    return tb.map_columns(docs, ticket_id="doc_id", text="text", created_at="seen_at", priority="lang")


@query("load_enriched", """SELECT 'sentiment' AS part, ticket_id, sentiment_label AS a, CAST(NULL AS VARCHAR) AS b, lex_compound AS n FROM scored
  UNION ALL SELECT 'topics', ticket_id, topic_label, NULL, topic FROM (SELECT r.ticket_id, 'T' || r.topic AS topic_label, r.topic FROM r_topics r)
  UNION ALL SELECT 'tickets', ticket_id, text, priority, NULL FROM tickets
  UNION ALL SELECT 'entities', ticket_id, entity, entity_type, NULL FROM mentions""")
def _(s):
    path = scratch_path(s.spark, "enriched")
    s = s.written()
    writers.write_enriched(_enriched(s, en.extract_entities(s.tickets, s.names)), path)
    inputs = readers.load_enriched(s.spark, path)
    none = F.lit(None)
    parts = [
        inputs.sentiment.select(F.lit("sentiment").alias("part"), "ticket_id", F.col("sentiment_label").alias("a"), none.cast("string").alias("b"), F.col("sentiment_score").alias("n")),
        inputs.topics.select(F.lit("topics"), "ticket_id", "topic_label", none.cast("string"), F.col("topic").cast("double")),
        inputs.tickets.select(F.lit("tickets"), "ticket_id", "text", "priority", none.cast("double")),
        inputs.entities.select(F.lit("entities"), "ticket_id", "entity", "entity_type", none.cast("double")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_ENRICHED = f"""SELECT {_TICKET_COLS}, r.topic, 'T' || r.topic AS topic_label, sentiment_label, sentiment_confidence, lex_compound,
  model_score, is_critical FROM scored s JOIN r_topics r USING (ticket_id)"""


def _enriched(s, spans: DataFrame | None = None) -> DataFrame:
    info = s.topics.select("topic", F.concat(F.lit("T"), F.col("topic").cast("string")).alias("name")).distinct()
    # Row-local: the scores come beside the tickets, so that no second copy of them is joined.
    out = tb.build_enriched(s.scored, s.topics, info, None, spans)
    return out.select(*s.tickets.columns, "topic", "topic_label", *tb.SENTIMENT_COLUMNS, *(["entities"] if spans is not None else []))


@query("write_enriched", _ENRICHED)
def _(s):
    path = scratch_path(s.spark, "enriched")
    writers.write_enriched(_enriched(s.written()), path)
    return s.spark.read.parquet(path)


def _info(s) -> DataFrame:
    return tp.topic_info(s.topics, tp.topic_keywords(tp.c_tf_idf(s.ticket_terms)))


@query("write_topic_summary", "SELECT topic, \"count\", name, keywords FROM tt_info")
def _(s):
    path = scratch_path(s.spark, "topic_summary")
    writers.write_topic_summary(_info(s), path, "csv")
    words = F.array_join(F.from_json("keywords", "array<string>"), " | ").alias("keywords")
    return readers.scan_csv(s.spark, path).select(F.col("topic").cast("int").alias("topic"), F.col("count").cast("bigint").alias("count"), "name", words)


@query("write_entity_summary", "SELECT entity, entity_type, n AS \"count\" FROM entity_n")
def _(s):
    path = scratch_path(s.spark, "entity_summary")
    writers.write_entity_summary(s.mentions, path)
    return s.spark.read.parquet(path)


@query("write_report", "SELECT ord, recommendation FROM recs")
def _(s):
    path = scratch_path(s.spark, "report")
    run = writers.write_report(rp.recommendations(s.inputs(written=True)), path)
    return s.spark.read.parquet(path).filter(F.col("run_id") == run).select("ord", "recommendation")


# --- Projections, filters, scalar functions ----------------------------------------------

@query("fill_text", "SELECT ticket_id, coalesce(text, '') AS text FROM messy")
def _(s):
    return s.messy.select("ticket_id", tx.fill_text(F.col("text")).alias("text"))


@query("nfkc")
def _(s):
    return s.documents.select("doc_id", tx.nfkc(F.col("text")).alias("text"))


@query("strip_control", f"SELECT ticket_id, regexp_replace(text, '{orc._CONTROL}', '', 'g') AS text FROM messy")
def _(s):
    return s.messy.select("ticket_id", tx.strip_control(F.col("text")).alias("text"))


@query("collapse_ws", f"SELECT doc_id, {orc._collapse('text')} AS text FROM documents")
def _(s):
    return s.documents.select("doc_id", tx.collapse_ws(F.col("text")).alias("text"))


@query("is_analyzable", f"SELECT ticket_id, length({_clean('text')}) > 0 AS analyzable FROM messy")
def _(s):
    return s.messy.select("ticket_id", tx.is_analyzable(tx.clean(F.col("text"))).alias("analyzable"))


@query("min_length", f"SELECT ticket_id, {_strip('text')} AS text FROM messy WHERE length({_strip('text')}) >= 3")
def _(s):
    return tx.min_length(s.messy, tp.MIN_TEXT_LENGTH).select("ticket_id", "text")


@query("drop_blank", f"SELECT ticket_id, {_strip('text')} AS text FROM messy WHERE length({_strip('text')}) > 0")
def _(s):
    return tx.drop_blank(s.messy).select("ticket_id", "text")


@query("complaint_context", f"SELECT ticket_id, ({orc._has_complaint} OR contains(lower(text), 'late')) AS complaint FROM tickets")
def _(s):
    return s.tickets.select("ticket_id", tx.complaint_context(F.col("text"), ["late"]).alias("complaint"))


_AMOUNTS = "SELECT ticket_id, entity || CASE WHEN length(ticket_id || entity) % 3 = 0 THEN '.5' ELSE '' END AS entity FROM money"


@query("parse_money", f"SELECT ticket_id, entity, round(TRY_CAST(regexp_replace(entity, '[^0-9.]', '', 'g') AS DOUBLE), 2) AS amount FROM ({_AMOUNTS})")
def _(s):
    found = en.pattern_entities(s.tickets).filter("entity_type = 'MONEY'")
    odd = F.when(F.length(F.concat("ticket_id", "entity")) % 3 == 0, ".5").otherwise("")
    found = found.select("ticket_id", F.concat("entity", odd).alias("entity"))
    return found.withColumn("amount", F.round(tx.parse_money(F.col("entity")), 2))


@query("money_pattern", "SELECT ticket_id, entity AS amount FROM money")
def _(s):
    return s.tickets.select("ticket_id", F.explode(tx.money_matches(F.col("text"))).alias("amount"))


@query("critical_flag", "SELECT ticket_id, lex_compound, is_critical FROM scored")
def _(s):
    return s.scored.select("ticket_id", "lex_compound", se.critical_flag(F.col("lex_compound")).alias("is_critical"))


@query("preview", "SELECT doc_id, substr(text, 1, 120) AS preview FROM documents")
def _(s):
    return s.documents.select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("parse_ts", """SELECT ticket_id, created_at FROM messy WHERE n % 10 <> 3""")
def _(s):
    text = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    return tx.parse_ts(s.messy.select("ticket_id", F.when(F.col("n") % 10 == 3, "not a time").otherwise(text).alias("created_at")))


@query("pct", f"""SELECT category, {_pct("count(*) FILTER (priority = 'urgent' AND category <> 'returns')", "count(*) FILTER (category <> 'returns')")} AS share
  FROM tickets GROUP BY 1""")
def _(s):
    counted = F.col("category") != "returns"
    counts = s.tickets.groupBy("category").agg(
        F.count_if(counted & (F.col("priority") == "urgent")).alias("part"), F.count_if(counted).alias("whole")
    )
    return counts.select("category", tx.pct(F.col("part"), F.col("whole")).alias("share"))


@query("round_scores", "SELECT event_id, round(value, 1) AS value_1, round(value / 7, 3) AS value_3, round(value / 7, 4) AS value_4 FROM events")
def _(s):
    value = F.col("value")
    return s.table("events").select(
        "event_id", F.round(value, 1).alias("value_1"), F.round(value / 7, 3).alias("value_3"), F.round(value / 7, 4).alias("value_4")
    )


@query("first_present_column", "SELECT ticket_id AS id, text AS body FROM tickets")
def _(s):
    col = tx.first_present(s.tickets, ("text_clean", "text", "ticket_text", "body"))
    return s.tickets.select(F.col("ticket_id").alias("id"), F.col(col).alias("body"))


@query("keyword_filters", """SELECT ticket_id, priority FROM tickets WHERE lower(priority) IN ('critical', 'urgent', 'p1')""")
def _(s):
    from ticketlens.functions.wordlists import CRITICAL_PRIORITIES

    return s.tickets.filter(tx.keyword_in(F.upper("priority"), CRITICAL_PRIORITIES)).select("ticket_id", "priority")


@query("report_projections", """SELECT r.ticket_id, r.topic, 'Topic_' || r.topic AS topic_label, sentiment_label, lex_compound AS sentiment_score
  FROM r_topics r JOIN scored s USING (ticket_id)""")
def _(s):
    return tb.topics_for_report(s.topics.drop("topic_label"), None).join(tb.sentiment_for_report(s.scored), "ticket_id")


@query("report_period", """SELECT ticket_id, created_at FROM tickets WHERE created_at > (SELECT max(created_at) FROM tickets) - INTERVAL 7 DAY""")
def _(s):
    return tb.report_period(s.tickets).select("ticket_id", "created_at")


# --- Joins ------------------------------------------------------------------------------

_SOME_TOPICS = "(SELECT ticket_id, topic FROM r_topics WHERE topic % 5 <> 4)"


def _some_topics(s) -> DataFrame:
    return s.topics.filter(F.col("topic") % 5 != 4).select("ticket_id", "topic")


@query("enrich_topic", f"SELECT t.ticket_id, t.category, coalesce(r.topic, -1) AS topic FROM tickets t LEFT JOIN {_SOME_TOPICS} r USING (ticket_id)")
def _(s):
    return tb.enrich_topic(s.tickets.select("ticket_id", "category"), _some_topics(s))


@query("topic_label_map", f"""SELECT ticket_id, x.topic, coalesce(i.name, 'Unknown') AS topic_label, coalesce(i.name, 'Topic_' || x.topic) AS report_label
  FROM (SELECT t.ticket_id, coalesce(r.topic, -1) AS topic FROM tickets t LEFT JOIN {_SOME_TOPICS} r USING (ticket_id)) x
  LEFT JOIN (SELECT DISTINCT topic, topic_label AS name FROM r_topics WHERE topic < 10) i ON i.topic = x.topic""")
def _(s):
    info = s.topics.filter("topic < 10").select("topic", F.col("topic_label").alias("name")).distinct()
    enriched = tb.enrich_topic(s.tickets.select("ticket_id"), _some_topics(s))
    labelled = tb.topic_label_map(enriched, info).withColumnRenamed("topic_label", "first_label")
    return tb.topic_label_map(labelled, info, None).select(
        "ticket_id", "topic", F.col("first_label").alias("topic_label"), F.col("topic_label").alias("report_label")
    )


@query("enrich_sentiment", f"""SELECT t.ticket_id, t.priority, s.sentiment_label, s.sentiment_confidence, s.lex_compound, s.model_score, s.is_critical
  FROM tickets t LEFT JOIN scored s USING (ticket_id)""")
def _(s):
    return tb.enrich_sentiment(s.tickets.select("ticket_id", "priority"), s.scored)


@query("attach_ticket_id", "SELECT ticket_id, entity, entity_type FROM mentions")
def _(s):
    arrays = en.extract_entities(s.tickets, s.names)
    return arrays.select("ticket_id", F.inline("entities")).select("ticket_id", F.col("text").alias("entity"), F.col("label").alias("entity_type"))


@query("merged_with_entity_flag", """SELECT r.ticket_id, r.topic, r.topic_label, s.sentiment_label, s.sentiment_score,
  EXISTS (SELECT 1 FROM r_entities e WHERE e.ticket_id = r.ticket_id) AS has_entities FROM r_topics r LEFT JOIN r_sentiment s USING (ticket_id)""")
def _(s):
    return tb.merged_with_entity_flag(s.topics, s.sentiment, s.entities)


@query("sentiment_with_timestamp", """SELECT s.ticket_id, s.sentiment_label, s.sentiment_score, t.created_at FROM r_sentiment s LEFT JOIN tickets t USING (ticket_id)""")
def _(s):
    return rp.sentiment_with_timestamp(s.sentiment, s.tickets)


@query("topic_sentiment_join", """SELECT r.ticket_id, r.topic_label, s.sentiment_score FROM r_topics r JOIN r_sentiment s USING (ticket_id)""")
def _(s):
    return rp.topic_sentiment_join(s.topics, s.sentiment)


@query("topic_text_join", """SELECT r.ticket_id, r.topic_label, t.text FROM r_topics r LEFT JOIN tickets t USING (ticket_id)
  WHERE r.topic_label IN (SELECT topic_label FROM topic_n ORDER BY n DESC, topic_label LIMIT 6)""")
def _(s):
    top = rp.topic_bar(s.topics, 6).select("topic_label")
    return s.topics.join(top, "topic_label", "left_semi").join(s.tickets.select("ticket_id", "text"), "ticket_id", "left").select(
        "ticket_id", "topic_label", "text"
    )


_KEYWORDS = ["refund", "charge", "Broken", "damaged", "login", "stuck", "parcel", "no such word"]
_LABELS = ["money", "money", "goods", "goods", "app", "app", "delivery", "nothing"]
_KW = ", ".join(f"('{k}', '{v}')" for k, v in zip(_KEYWORDS, _LABELS))
_MATCH = f"scored s JOIN (VALUES {_KW}) AS k(keyword, topic) ON contains(lower(s.text), lower(k.keyword))"


@query("keyword_contains_join", f"SELECT s.ticket_id, k.topic, k.keyword FROM {_MATCH}")
def _(s):
    return se.keyword_matches(s.tickets.select("ticket_id", "text"), _KEYWORDS, _LABELS).drop("text")


# Names of several tables as keywords, some of them shorter than the grams they are filed under.
_KEYWORD_TABLE = """(SELECT DISTINCT p_name AS keyword, 'part' AS topic FROM part UNION SELECT s_name, 'supplier' FROM supplier UNION SELECT c_name, 'customer' FROM customer
  UNION SELECT n_name, 'nation' FROM nation UNION SELECT lower(o_orderstatus) || substr(o_orderpriority, 3, 2), 'code' FROM orders UNION SELECT right(p_brand, 2), 'brand' FROM part)"""


def _keyword_table(s) -> DataFrame:
    def part(table: str, column, topic: str) -> DataFrame:
        return s.table(table).select(F.expr(column).alias("keyword"), F.lit(topic).alias("topic"))

    parts = [part("part", "p_name", "part"), part("supplier", "s_name", "supplier"), part("customer", "c_name", "customer"), part("nation", "n_name", "nation"),
             part("orders", "lower(o_orderstatus) || substr(o_orderpriority, 3, 2)", "code"), part("part", "right(p_brand, 2)", "brand")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query("keyword_table_join", f"SELECT t.ticket_id, k.topic, k.keyword FROM tickets t JOIN {_KEYWORD_TABLE} k ON contains(lower(t.text), lower(k.keyword))")
def _(s):
    return kw.keyword_table_matches(s.tickets.select("ticket_id", "text"), _keyword_table(s)).drop("text")


@query("keyword_table_breakdown", f"""SELECT topic, {_mean('sum(c) / sum(n)')} AS mean_compound, {_mean('sum(f) / sum(n)')} AS mean_confidence, CAST(sum(n) AS BIGINT) AS "count"
  FROM (SELECT k.topic, s.sentiment_label, count(*) AS n, sum(s.lex_compound) AS c, sum(s.sentiment_confidence) AS f
    FROM scored s JOIN {_KEYWORD_TABLE} k ON contains(lower(s.text), lower(k.keyword)) GROUP BY 1, 2) GROUP BY 1""")
def _(s):
    return se.topic_sentiment_breakdown(s.scored, _keyword_table(s)).drop("label_distribution")


@query("entity_pair_join", "SELECT DISTINCT a.ticket_id, a.entity AS entity_a, b.entity AS entity_b FROM mentions a JOIN mentions b ON a.ticket_id = b.ticket_id AND a.entity < b.entity")
def _(s):
    return en.entity_pairs(s.mentions)


# --- Aggregations -----------------------------------------------------------------------

@query("value_counts", "SELECT source AS value, count(*) AS \"count\" FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(s):
    return rp.value_counts(s.table("documents"), "source")


@query("entity_counts", "SELECT entity, entity_type, n AS \"count\" FROM entity_n")
def _(s):
    return en.entity_counts(s.mentions)


@query("type_distribution", "SELECT entity_type, count(*) AS \"count\" FROM mentions GROUP BY 1")
def _(s):
    return en.type_distribution(s.mentions)


@query("entity_totals", """SELECT (SELECT count(*) FROM entity_n) AS total_unique_entities, (SELECT count(*) FROM mentions) AS total_mentions,
  (SELECT count(*) FROM tickets) AS n_documents_processed""")
def _(s):
    return en.entity_totals(s.mentions, s.tickets)


@query("co_occurrence", """SELECT entity_a, entity_b, count(*) AS "count" FROM (
  SELECT DISTINCT a.ticket_id, a.entity AS entity_a, b.entity AS entity_b FROM mentions a JOIN mentions b ON a.ticket_id = b.ticket_id AND a.entity < b.entity) GROUP BY 1, 2""")
def _(s):
    return en.co_occurrence(en.entity_mentions(s.tickets, s.names, flat=False))


@query("entity_summary", """SELECT n.entity, n.entity_type, n.n AS "count", c.reason FROM entity_n n LEFT JOIN critical_e c
  ON c.entity = n.entity AND c.entity_type = n.entity_type""")
def _(s):
    mentions = materialise(s.mentions, "mentions")
    return en.entity_summary(mentions, en.critical_entities(mentions, s.tickets))


@query("topic_sentiment_breakdown", f"""SELECT topic, {_mean('sum(c) / sum(n)')} AS mean_compound, {_mean('sum(f) / sum(n)')} AS mean_confidence,
  CAST(sum(n) AS BIGINT) AS "count", string_agg(sentiment_label || '=' || n, ',' ORDER BY sentiment_label) AS label_distribution
  FROM (SELECT k.topic, s.sentiment_label, count(*) AS n, sum(s.lex_compound) AS c, sum(s.sentiment_confidence) AS f FROM {_MATCH} GROUP BY 1, 2) GROUP BY 1""")
def _(s):
    found = se.topic_sentiment_breakdown(s.scored, _KEYWORDS, _LABELS)
    pairs = F.transform(F.map_entries("label_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return found.withColumn("label_distribution", F.array_join(pairs, ","))


_BY_TOPIC = "SELECT r.topic_label, avg(s.sentiment_score) AS m FROM r_topics r JOIN r_sentiment s USING (ticket_id) GROUP BY 1"


@query("sentiment_by_topic", f"SELECT topic_label, {_mean('m')} AS mean_score, CAST(sign(round(m, 9)) AS INTEGER) AS sign FROM ({_BY_TOPIC})")
def _(s):
    return _round(rp.sentiment_by_topic(s.topics, s.sentiment), "mean_score")


@query("daily_trend", f"SELECT CAST(ts AS DATE) AS day, {_mean('avg(value)')} AS mean_score FROM events GROUP BY 1")
def _(s):
    return _round(tr.daily_trend(s.table("events"), "ts", "value"), "mean_score")


@query("period_trend", f"""SELECT CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS TIMESTAMP) AS period, {_mean('avg(value)')} AS mean_compound,
  {_mean('avg(user_id)')} AS mean_confidence, count(*) AS ticket_count FROM events GROUP BY 1""")
def _(s):
    return _round(tr.period_trend(s.table("events"), "ts", "value", "user_id", "W"), "mean_compound", "mean_confidence")


@query("type_entity_pivot", "SELECT entity_type, entity, tickets FROM per_type")
def _(s):
    return rp.type_entity_pivot(s.entities)


@query("type_cooccurrence", "SELECT type_a, type_b, n AS \"count\" FROM heat")
def _(s):
    return rp.type_cooccurrence(s.entities)


@query("pie_with_other", f"SELECT topic_label, n AS \"count\", {_pct('n', 'sum(n) OVER ()')} AS share FROM pie")
def _(s):
    return rp.pie_with_other(s.topics)


_SUMMARY = """SELECT total_tickets, positive, neutral, negative, avg_sentiment, top_topic, top_topic_count, top_topic_pct, critical_count, critical_pct FROM summary"""


@query("executive_summary", _SUMMARY)
def _(s):
    return rp.executive_summary(s.inputs(written=True))


@query("dedupe_exact", f"""SELECT a.initial_rows, b.kept_rows, a.initial_rows - b.kept_rows AS dropped_rows
  FROM (SELECT count(*) AS initial_rows FROM documents) a CROSS JOIN (
    SELECT count(*) AS kept_rows FROM (SELECT DISTINCT {_strip('text')}, lang, source FROM documents WHERE length({_strip('text')}) > 0)) b""")
def _(s):
    return tb.validation_counts(s.documents.select("text", "lang", "source"))


# --- Windows ----------------------------------------------------------------------------

_DAILY = """SELECT CAST(CAST(created_at AS DATE) AS TIMESTAMP) AS period, avg(lex_compound) AS m, avg(sentiment_confidence) AS f, count(*) AS n
  FROM scored GROUP BY 1"""


def _daily(s) -> DataFrame:
    return tr.period_trend(s.scored)


@query("trend_shift", f"""SELECT period, {_mean('m')} AS mean_compound, coalesce(round(abs(m - lag(m) OVER (ORDER BY period)), 9) > 0.3, false) AS shift_detected FROM ({_DAILY})""")
def _(s):
    return _round(tr.trend_shift(_daily(s)), "mean_compound").select("period", "mean_compound", "shift_detected")


@query("rolling_mean", f"""SELECT period, {_mean('avg(m) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling_mean FROM ({_DAILY})""")
def _(s):
    return _round(tr.rolling_mean(_daily(s)), "rolling_mean").select("period", "rolling_mean")


@query("rolling_std", f"""SELECT period, {_mean('coalesce(stddev_samp(m) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0)')} AS rolling_std FROM ({_DAILY})""")
def _(s):
    return _round(tr.rolling_std(_daily(s)), "rolling_std").select("period", "rolling_std")


@query("first_flag_per_ticket", "SELECT ticket_id, flag_reason, source_rank FROM critical_t")
def _(s):
    return s.inputs().critical().select("ticket_id", "flag_reason", "source_rank")


# --- Sorts, limits, top-k ---------------------------------------------------------------

@query("top_entities", "SELECT entity, entity_type, n AS \"count\" FROM entity_n ORDER BY n DESC, entity, entity_type LIMIT 20")
def _(s):
    return en.top_entities(s.mentions)


@query("topic_top12", "SELECT topic_label, n AS \"count\" FROM topic_n ORDER BY n DESC, topic_label LIMIT 12")
def _(s):
    return rp.topic_bar(s.topics)


@query("entity_top15", "SELECT entity, count(*) AS \"count\" FROM r_entities GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(s):
    return rp.entity_bar(s.entities)


@query("entity_type_top10", "SELECT entity_type, count(*) AS \"count\" FROM r_entities GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s):
    return rp.entity_by_type(s.entities)


_ALERTS = "SELECT row_number() OVER (ORDER BY source_rank, ticket_id) AS number, ticket_id, flag_reason AS reason FROM critical_t ORDER BY source_rank, ticket_id LIMIT 20"


@query("critical_alerts", f"SELECT CAST(number AS INTEGER) AS number, ticket_id, reason FROM ({_ALERTS})")
def _(s):
    return rp.critical_alerts(s.inputs().critical())


@query("critical_entities_sorted", "SELECT entity, entity_type, reason, frequency FROM critical_e")
def _(s):
    return en.critical_entities_sorted(en.critical_entities(s.mentions, s.tickets))


@query("top_topics_for_words", "SELECT topic_label, n AS \"count\" FROM topic_n ORDER BY n DESC, topic_label LIMIT 6")
def _(s):
    return rp.topic_bar(s.topics, 6)


# --- Set operations ---------------------------------------------------------------------

@query("critical_tickets", "SELECT ticket_id, flag_reason, sentiment_score, entity, priority, source_rank FROM critical_t")
def _(s):
    return s.inputs(written=True).critical()


@query("append_other", "SELECT topic_label, n AS \"count\" FROM pie")
def _(s):
    counts = rp.topic_counts(s.topics)
    top = counts.orderBy(F.desc("count"), "topic_label").limit(8)
    rest = counts.join(top.select("topic_label"), "topic_label", "left_anti").agg(F.sum("count").alias("count"))
    return rp.append_other(top, rest.select(F.lit(rp.OTHER).alias("topic_label"), "count"))


# --- Sentiment --------------------------------------------------------------------------

@query("lexicon_sentiment", "SELECT id AS ticket_id, lex_pos, lex_neg, lex_neu, lex_compound FROM t_scores")
def _(s):
    cleaned = s.tickets.select("ticket_id", tx.clean(F.col("text")).alias("clean"))
    return se.lexicon_sentiment(cleaned).drop("clean")


@query("phrase_sentiment", "SELECT id AS ticket_id, lex_pos, lex_neg, lex_neu, lex_compound FROM p_scores")
def _(s):
    ends = F.get(F.array(*[F.lit(p) for p in orc.PHRASED]), (F.substring("ticket_id", 5, 20).cast("bigint") % len(orc.PHRASED)).cast("int"))
    phrased = s.tickets.select("ticket_id", F.concat(F.rtrim(F.col("text"), F.lit(".!?")), F.lit("."), ends).alias("text"))
    return se.lexicon_sentiment(phrased.select("ticket_id", tx.clean(F.col("text")).alias("clean")), phrases=se.PHRASES).drop("clean")


@query("lexicon_sentiment_documents", "SELECT id AS doc_id, lex_pos, lex_neg, lex_neu, lex_compound FROM d_scores")
def _(s):
    return se.lexicon_sentiment(s.documents.select("doc_id", tx.clean(F.col("text")).alias("clean"))).drop("clean")


@query("lexicon_join_sentiment", "SELECT id AS ticket_id, lex_pos, lex_neg, lex_neu, lex_compound FROM t_scores")
def _(s):
    lexicon = small_table(s.spark, list(LEXICON.items()), "token string, valence double")
    cleaned = s.tickets.select("ticket_id", tx.clean(F.col("text")).alias("clean"))
    return se.lexicon_join_sentiment(cleaned, lexicon, negations=NEGATIONS)


def _classifier(s):
    """A classifier of insulting documents, the only labelled opinion in the given tables."""
    labelled = s.documents.join(s.table("labels"), "doc_id").select(tx.clean(F.col("text")).alias("clean"), F.col("toxic").alias("label"))
    return md.classifier_scores(md.fit_text_classifier(labelled))


@query("model_sentiment")
def _(s):
    cleaned = s.documents.select("doc_id", tx.clean(F.col("text")).alias("clean"))
    scored = _classifier(s)(cleaned)
    return scored.select("doc_id", "model_label", F.round("model_score", 4).alias("model_score"))


_INSULTS = ("trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid")


def _load_word_model():
    def predict(texts):
        hits = [sum(w in t.lower() for w in _INSULTS) for t in texts]
        return [("NEGATIVE", 0.5 + 0.5 * min(h, 4) / 4) if h else ("POSITIVE", 0.5) for h in hits]

    return predict


_HITS = " + ".join(f"CAST(contains(lower(clean), '{w}') AS INTEGER)" for w in _INSULTS)


@query("model_sentiment_user", f"""SELECT id AS doc_id, CASE WHEN h > 0 THEN 'negative' ELSE 'positive' END AS model_label,
  0.5 + 0.5 * least(h, 4) / 4 AS model_score FROM (SELECT id, {_HITS} AS h FROM d_src)""")
def _(s):
    cleaned = s.documents.select("doc_id", tx.clean(F.col("text")).alias("clean"))
    return md.user_model_scores(_load_word_model)(cleaned).drop("clean")


def _load_length_model():
    def predict(texts):
        letters = [sum(map(len, t.split())) for t in texts]
        return [("NEGATIVE" if n % 3 == 0 else "POSITIVE", 0.5 + n % 11 / 22) for n in letters]

    return predict


@query("model_sentiment_windows", f"""SELECT id AS doc_id, first(label ORDER BY round(s, 6) DESC, label) AS model_label,
  {_mean('first(s ORDER BY round(s, 6) DESC, label) / sum(size)', 6)} AS model_score FROM (
  SELECT id, label, sum(size * score) AS s, sum(size) AS size FROM (
    SELECT id, greatest(len(part), 1) AS size, CASE WHEN n % 3 = 0 THEN 'negative' ELSE 'positive' END AS label, 0.5 + n % 11 / 22.0::DOUBLE AS score FROM (
      SELECT id, part, CAST(coalesce(list_sum([length(x) FOR x IN part]), 0) AS BIGINT) AS n FROM (
        SELECT id, ws[i * 48 + 1 : i * 48 + 64] AS part FROM (
          SELECT id, ws, unnest(range(CAST(greatest(ceil((len(ws) - 64) / 48), 0) AS BIGINT) + 1)) AS i FROM (
            SELECT id, regexp_extract_all(clean, '[^ ]+') AS ws FROM d_src)))))
  GROUP BY 1, 2) GROUP BY 1""")
def _(s):
    cleaned = s.documents.select("doc_id", tx.clean(F.col("text")).alias("clean"))
    return _round(md.windowed_model_scores(_load_length_model, md.token_spans("[^ ]+"), size=64, overlap=16)(cleaned).drop("clean"), "model_score", digits=6)


_BY_PRIORITY = "CASE priority WHEN 'urgent' THEN 'negative' WHEN 'high' THEN 'negative' WHEN 'low' THEN 'positive' END"
_PRIORITY_SCORE = "CASE priority WHEN 'urgent' THEN 0.9::DOUBLE WHEN 'high' THEN 0.6::DOUBLE WHEN 'low' THEN 0.8::DOUBLE END"


def _priority_model(df: DataFrame) -> DataFrame:
    p = F.col("priority")
    return df.withColumns({
        "model_label": F.when(p.isin("urgent", "high"), "negative").when(p == "low", "positive"),
        "model_score": F.when(p == "urgent", 0.9).when(p == "high", 0.6).when(p == "low", 0.8),
    })


_H = _hybrid("lex_compound", "coalesce(ml, 'neutral')", "coalesce(ms, 0)")


@query("hybrid_score", f"""SELECT ticket_id, {_label('h')} AS sentiment_label, round(least(abs(h), 1), 4) AS sentiment_confidence, coalesce(ms, 0) AS model_score
  FROM (SELECT *, {_H} AS h FROM (SELECT *, {_BY_PRIORITY} AS ml, {_PRIORITY_SCORE} AS ms FROM scored))""")
def _(s):
    cleaned = s.tickets.select("ticket_id", "priority", tx.clean(F.col("text")).alias("clean"))
    scored = se.hybrid_score(_priority_model(se.lexicon_sentiment(cleaned)))
    return scored.select("ticket_id", "sentiment_label", "sentiment_confidence", "model_score")


@query("sentiment_fallback", f"""SELECT m.ticket_id, CASE WHEN length(c.clean) = 0 THEN 'neutral' ELSE {_label('(0.4::DOUBLE * x.lex_compound)')} END AS sentiment_label,
  CASE WHEN length(c.clean) = 0 THEN 0 ELSE round(abs(0.4::DOUBLE * x.lex_compound), 4) END AS sentiment_confidence, x.lex_compound, x.lex_compound < -0.7 AS is_critical
  FROM messy m JOIN m_src c ON c.id = m.ticket_id JOIN m_scores x ON x.id = m.ticket_id""")
def _(s):
    return se.analyze_sentiment(s.messy).select("ticket_id", "sentiment_label", "sentiment_confidence", "lex_compound", "is_critical")


@query("analyze_sentiment", f"SELECT {_TICKET_COLS}, sentiment_label, sentiment_confidence, lex_compound, model_score, lex_pos, lex_neg, lex_neu, is_critical FROM scored")
def _(s):
    return se.analyze_sentiment(s.tickets)


@query("analyze_sentiment_model")
def _(s):
    scored = se.analyze_sentiment(s.documents.select("doc_id", "text"), model=_classifier(s))
    return scored.drop("text")


_FIRST = f"(SELECT id, {_HITS} AS h FROM d_src)"
_FIRST_MODEL = f"(SELECT id, CASE WHEN h > 0 THEN 'negative' ELSE 'positive' END AS ml, 0.5 + 0.5 * least(h, 4) / 4 AS ms FROM {_FIRST})"


@query("analyze_one", f"""SELECT id AS doc_id, {_label('h')} AS sentiment_label, round(least(abs(h), 1), 4) AS sentiment_confidence, lex_compound,
  round(ms, 4) AS model_score, lex_compound < -0.7 AS is_critical
  FROM (SELECT s.id, s.lex_compound, ms, {_hybrid('s.lex_compound', 'ml', 'ms')} AS h FROM d_scores s JOIN {_FIRST_MODEL} USING (id))""")
def _(s):
    # The rule for single texts over all documents.
    model = md.user_model_scores(_load_word_model)
    scored = se.analyze_sentiment(s.documents.select("doc_id", "text"), model=model)
    return scored.select("doc_id", "sentiment_label", "sentiment_confidence", "lex_compound", "model_score", "is_critical")


@query("sentiment_alerts", """SELECT ticket_id, sentiment_label AS label, sentiment_confidence AS confidence, lex_compound, model_score,
  substr(text, 1, 120) AS preview FROM scored WHERE is_critical""")
def _(s):
    return se.sentiment_alerts(s.scored)


@query("sentiment_trend", f"""SELECT period, {_mean('m')} AS mean_compound, {_mean('f')} AS mean_confidence, n AS ticket_count,
  coalesce(round(abs(m - lag(m) OVER o), 9) > 0.3, false) AS shift_detected,
  {_mean('avg(m) OVER w')} AS rolling_mean, {_mean('coalesce(stddev_samp(m) OVER w, 0)')} AS rolling_std
  FROM ({_DAILY}) WINDOW o AS (ORDER BY period), w AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(s):
    return tr.sentiment_trend(s.scored)


# --- Entities ---------------------------------------------------------------------------

@query("extract_entities", """SELECT t.ticket_id, coalesce(string_agg(m.entity || '|' || m.entity_type || '|' || m."start" || '|' || m."end", ';' ORDER BY m."start"), '') AS entities
  FROM tickets t LEFT JOIN mentions m USING (ticket_id) GROUP BY 1""")
def _(s):
    spans = F.transform("entities", lambda e: F.concat_ws("|", e["text"], e["label"], e["start"].cast("string"), e["end"].cast("string")))
    return en.extract_entities(s.tickets, s.names).select("ticket_id", F.array_join(spans, ";").alias("entities"))


@query("pattern_entities", "SELECT ticket_id, entity, entity_type, \"start\", \"end\" FROM patterns")
def _(s):
    return en.pattern_entities(s.tickets)


@query("gazetteer_entities", "SELECT ticket_id, entity, entity_type, \"start\", \"end\" FROM named")
def _(s):
    return en.gazetteer_entities(s.tickets, s.names)


_TICKET_FORMS = r"\$[0-9]+\.[0-9]{2}|[0-9]+\.[0-9]{2} (?:USD|dollars)|[0-9]{4}-[0-9]{2}-[0-9]{2}|last year"


@query("grammar_entities", f"""SELECT ticket_id, entity, CASE WHEN entity LIKE '____-__-__' OR entity = 'last year' THEN 'DATE' ELSE 'MONEY' END AS entity_type, "start", "start" + length(entity) AS "end",
  CASE WHEN entity = 'last year' THEN strftime(day - INTERVAL 1 YEAR, '%Y-%m-%d') WHEN entity LIKE '____-__-__' THEN entity ELSE regexp_extract(entity, '[0-9.]+') || ' USD' END AS value
  FROM (SELECT ticket_id, day, found[i] AS entity,
      list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS "start"
    FROM (SELECT ticket_id, day, found, pieces, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT ticket_id, CAST(created_at AS DATE) AS day, regexp_extract_all(text, '{_TICKET_FORMS}') AS found, regexp_split_to_array(text, '{_TICKET_FORMS}') AS pieces FROM tickets)))""")
def _(s):
    return gr.grammar_entities(s.tickets)


# Spellings of dates and amounts: Spark's form, the same in SQL, type, and the value in SQL.
_FORMS = (
    (lambda: F.date_format("d", "MMMM d, yyyy"), "strftime(d, '%B %-d, %Y')", "DATE", "strftime(d, '%Y-%m-%d')"),
    (lambda: F.date_format("d", "d MMM yyyy"), "strftime(d, '%-d %b %Y')", "DATE", "strftime(d, '%Y-%m-%d')"),
    (lambda: F.date_format("d", "MM/dd/yyyy"), "strftime(d, '%m/%d/%Y')", "DATE", "strftime(d, '%Y-%m-%d')"),
    (lambda: F.date_format("d", "dd.MM.yyyy"), "strftime(d, '%d.%m.%Y')", "DATE", "strftime(d, '%Y-%m-%d')"),
    (lambda: F.date_format("d", "MMM yyyy"), "strftime(d, '%b %Y')", "DATE", "strftime(d, '%Y-%m')"),
    (lambda: F.lit("last Friday"), "'last Friday'", "DATE", "strftime(d - (CASE WHEN isodow(d) > 5 THEN isodow(d) - 5 ELSE isodow(d) + 2 END)::INT, '%Y-%m-%d')"),
    (lambda: F.concat(F.col("n").cast("string"), F.lit(" days ago")), "n || ' days ago'", "DATE", "strftime(d - n::INT, '%Y-%m-%d')"),
    (lambda: F.lit("in three months"), "'in three months'", "DATE", "strftime(d + INTERVAL 3 MONTH, '%Y-%m-%d')"),
    (lambda: F.concat(F.lit("$"), F.format_number(F.col("n") * 1000 + 7, 0), F.lit(".50")), "'$' || format('{:,}', n * 1000 + 7) || '.50'", "MONEY", "(n * 1000 + 7) || '.50 USD'"),
    (lambda: F.concat(F.lit("€"), F.col("n").cast("string")), "'€' || n", "MONEY", "n || '.00 EUR'"),
    (lambda: F.concat(F.col("n").cast("string"), F.lit(" euros")), "n || ' euros'", "MONEY", "n || '.00 EUR'"),
    (lambda: F.concat(F.lit("$"), F.col("n").cast("string"), F.lit(".2 million")), "'$' || n || '.2 million'", "MONEY", "n || '200000.00 USD'"),
    (lambda: F.concat(F.lit("GBP "), F.col("n").cast("string")), "'GBP ' || n", "MONEY", "n || '.00 GBP'"),
    (lambda: F.lit("two hundred and five dollars"), "'two hundred and five dollars'", "MONEY", "'205.00 USD'"),
)


def _forms_sql() -> str:
    def case(k: int) -> str:
        return f"CASE key % {len(_FORMS)} " + " ".join(f"WHEN {i} THEN {form[k]}" for i, form in enumerate(_FORMS)) + " END"

    dates = sum(f[2] == "DATE" for f in _FORMS)
    kind = f"CASE WHEN key % {len(_FORMS)} < {dates} THEN 'DATE' ELSE 'MONEY' END"
    return f"""SELECT key, entity, entity_type, 12 AS "start", 12 + length(entity) AS "end", value FROM (
  SELECT key, {case(1)} AS entity, {kind} AS entity_type, {case(3)} AS value
  FROM (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d, o_orderkey % 29 + 2 AS n FROM orders))"""


@query("grammar_forms", _forms_sql())
def _(s):
    orders = s.table("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 29 + 2).alias("n"))
    form = F.lit(None)
    for i, (build, *_) in reversed(list(enumerate(_FORMS))):
        form = F.when(F.col("key") % len(_FORMS) == i, build()).otherwise(form)
    texts = orders.select("key", "d", F.concat(F.lit("We wrote on "), form, F.lit(", and 4 of us waited.")).alias("text"))
    return gr.grammar_entities(texts, "key", "text", "d")


@query("tagged_entities")
def _(s):
    return tg.tagged_entities(s.tickets, tg.train_tagger(s.tickets, s.names))


@query("target_types", "SELECT ticket_id, entity, entity_type FROM mentions WHERE entity_type IN ('MONEY', 'GPE')")
def _(s):
    return en.target_types(s.mentions, ["MONEY", "GPE"]).select("ticket_id", "entity", "entity_type")


@query("entity_mentions", "SELECT ticket_id, entity, entity_type, \"start\", \"end\" FROM mentions")
def _(s):
    return s.mentions


@query("critical_entities", "SELECT entity, entity_type, reason, frequency FROM critical_e")
def _(s):
    return en.critical_entities(s.mentions, s.tickets)


@query("entity_report", """SELECT 'top' AS part, entity AS a, entity_type AS b, n FROM (SELECT * FROM entity_n ORDER BY n DESC, entity, entity_type LIMIT 20)
  UNION ALL SELECT 'type', entity_type, NULL, count(*) FROM mentions GROUP BY 2
  UNION ALL SELECT 'critical', entity, reason, frequency FROM critical_e
  UNION ALL SELECT 'totals', 'mentions', NULL, count(*) FROM mentions
  UNION ALL SELECT 'totals', 'unique', NULL, count(*) FROM entity_n
  UNION ALL SELECT 'totals', 'documents', NULL, count(*) FROM tickets
  UNION ALL SELECT 'pairs', entity_a, entity_b, count(*) FROM (
    SELECT DISTINCT a.ticket_id, a.entity AS entity_a, b.entity AS entity_b FROM mentions a JOIN mentions b ON a.ticket_id = b.ticket_id AND a.entity < b.entity) GROUP BY 2, 3
  UNION ALL SELECT 'table', entity, entity_type, n FROM entity_n""")
def _(s):
    parts = en.entity_report(materialise(s.mentions, "mentions"), s.tickets)
    none = F.lit(None).cast("string")
    rows = [
        parts["top_entities"].select(F.lit("top").alias("part"), F.col("entity").alias("a"), F.col("entity_type").alias("b"), F.col("count").alias("n")),
        parts["type_distribution"].select(F.lit("type"), "entity_type", none, "count"),
        parts["critical_entities"].select(F.lit("critical"), "entity", "reason", "frequency"),
        *[parts["totals"].select(F.lit("totals"), F.lit(k), none, c) for k, c in
          (("mentions", "total_mentions"), ("unique", "total_unique_entities"), ("documents", "n_documents_processed"))],
        parts["co_occurrence"].select(F.lit("pairs"), "entity_a", "entity_b", "count"),
        parts["entity_table"].select(F.lit("table"), "entity", "entity_type", "count"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


# --- Topics -----------------------------------------------------------------------------

@query("term_counts", "SELECT topic, term, tf, df FROM tt_tf")
def _(s):
    return s.ticket_terms


@query("term_counts_documents", "SELECT topic, term, tf, df FROM dt_tf")
def _(s):
    return tp.term_counts(s.documents, "lang")


def _ticket_keywords(s) -> DataFrame:
    return tp.topic_keywords(tp.c_tf_idf(s.ticket_terms))


@query("topic_keywords", f"SELECT topic, \"rank\", term, {_mean('weight', 6)} AS weight FROM tt_kw")
def _(s):
    return _round(_ticket_keywords(s), "weight", digits=6)


@query("topic_keywords_documents", f"SELECT topic, \"rank\", term, {_mean('weight', 6)} AS weight FROM dt_kw")
def _(s):
    return _round(tp.topic_keywords(tp.c_tf_idf(tp.term_counts(s.documents, "lang"))), "weight", digits=6)


@query("topic_info", "SELECT topic, \"count\", name, keywords FROM tt_info")
def _(s):
    return _info(s).withColumn("keywords", F.array_join("keywords", " | "))


@query("topic_frequencies", f"SELECT topic, count(*) AS \"count\" FROM (SELECT coalesce(r.topic, -1) AS topic FROM tickets t LEFT JOIN {_SOME_TOPICS} r USING (ticket_id)) GROUP BY 1")
def _(s):
    return tp.topic_frequencies(tb.enrich_topic(s.tickets.select("ticket_id"), _some_topics(s)))


@query("topic_outliers", f"SELECT count(*) AS n_outliers FROM tickets t LEFT JOIN {_SOME_TOPICS} r USING (ticket_id) WHERE r.topic IS NULL")
def _(s):
    return tp.topic_outliers(tb.enrich_topic(s.tickets.select("ticket_id"), _some_topics(s)))


_REP = f"""SELECT topic, CAST(rn AS INTEGER) AS "rank", vec_id, {_mean('sim', 6)} AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(sim, 9) DESC, vec_id) AS rn FROM sims WHERE label = topic) WHERE rn <= 5"""


@query("representative_docs", _REP)
def _(s):
    return _round(tm.representative_docs(s.embedded, s.centroids, id_col="vec_id"), "similarity", digits=6)


@query("topic_summary", """SELECT c.topic, c.topic || '_' || array_to_string(k.words[1:4], '_') AS name, array_to_string(k.words, ' | ') AS keywords, c.n AS "count", r.docs AS representative_docs
  FROM (SELECT label AS topic, count(*) AS n FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY 1) c
  JOIN (SELECT topic, list(term ORDER BY "rank") AS words FROM et_kw GROUP BY 1) k USING (topic)
  JOIN (SELECT topic, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rn) AS docs FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(sim, 9) DESC, vec_id) AS rn FROM sims WHERE label = topic) WHERE rn <= 5 GROUP BY 1) r USING (topic)""")
def _(s):
    texts = s.embedded_texts
    info = tp.topic_info(texts.select("topic"), tp.topic_keywords(tp.c_tf_idf(tp.term_counts(texts))))
    close = tm.representative_docs(s.embedded, s.centroids, id_col="vec_id").withColumn("text", F.col("vec_id").cast("string"))
    summary = tp.topic_summary(info, close)
    return summary.select(
        "topic", "name", F.array_join("keywords", " | ").alias("keywords"), "count", F.array_join("representative_docs", ",").alias("representative_docs")
    )


@query("topic_probability", f"""SELECT vec_id, {_mean('max(exp(sim)) FILTER (topic = label) / sum(exp(sim))', 6)} AS probability FROM sims GROUP BY vec_id""")
def _(s):
    return _round(tm.topic_probability(s.embedded, s.centroids, "topic").select("vec_id", "probability"), "probability", digits=6)


@query("predict_topics", f"""SELECT d.doc_id AS vec_id, coalesce(b.topic, -1) AS topic, coalesce(array_to_string(k.words, ' | '), '') AS keywords,
  coalesce({_mean('b.p', 6)}, 0) AS probability
  FROM documents d LEFT JOIN (SELECT vec_id, arg_max(topic, sim) AS topic, max(exp(sim)) / sum(exp(sim)) AS p FROM sims GROUP BY vec_id) b ON b.vec_id = d.doc_id
  LEFT JOIN (SELECT topic, list(term ORDER BY "rank") AS words FROM et_kw GROUP BY 1) k USING (topic)""")
def _(s):
    keywords = tp.topic_keywords(tp.c_tf_idf(tp.term_counts(s.embedded_texts)))
    texts = s.documents.select(F.col("doc_id").alias("vec_id"), "text").join(s.embedded, "vec_id", "left")
    found = tm.predict_topics(texts, s.centroids, keywords, id_col="vec_id")
    return _round(found, "probability", digits=6).withColumn("keywords", F.array_join("keywords", " | "))


@query("topic_similarity", f"""SELECT a.topic AS topic_a, b.topic AS topic_b, {_mean('sum(a.weight * b.weight) / any_value(a.norm * b.norm)')} AS similarity
  FROM (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY topic)) AS norm FROM tt_w) a
  JOIN (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY topic)) AS norm FROM tt_w) b ON a.term = b.term AND a.topic <= b.topic GROUP BY 1, 2""")
def _(s):
    return _round(tp.topic_similarity(tp.c_tf_idf(s.ticket_terms)), "similarity")


@query("topic_bar_data", f"SELECT topic, \"rank\", term, {_mean('weight', 6)} AS weight FROM tt_kw WHERE topic < 8 AND \"rank\" <= 8")
def _(s):
    return _round(tp.topic_bar_data(_ticket_keywords(s)), "weight", digits=6)


@query("rerank_keywords")
def _(s):
    """Word vectors are means of the vectors of the documents that hold the word."""
    texts = s.embedded_texts
    keywords = tp.topic_keywords(tp.c_tf_idf(tp.term_counts(texts)))
    holders = tp.with_terms(texts, "text").select(F.explode(F.array_distinct("terms")).alias("topic"), "embedding")
    holders = holders.join(keywords.select(F.col("term").alias("topic")).distinct(), "topic", "left_semi")
    term_vectors = (
        holders.groupBy("topic").agg(tm.vector_to_array(tm.Summarizer.mean(tm.array_to_vector(F.col("embedding").cast("array<double>")))).alias("vector"))
        .withColumnRenamed("topic", "term")
    )
    ranked = tp.rerank_keywords(keywords, term_vectors, s.centroids.withColumnRenamed("centroid", "vector"))
    return _round(ranked, "weight", "closeness")


@query("topic_hierarchy")
def _(s):
    return tp.topic_hierarchy(tp.topic_similarity(tp.c_tf_idf(s.ticket_terms)))


@query("reduce_topics")
def _(s):
    reduced = tp.reduce_topics(s.topics.select("ticket_id", "topic"), tp.topic_similarity(tp.c_tf_idf(s.ticket_terms)), 5)
    return reduced


def _vectors(s) -> DataFrame:
    return s.embedded.select("vec_id", tm.array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))


def _reduced(s) -> DataFrame:
    vectors = _vectors(s)
    return tm.reduce_dims(vectors, tm.fit_reducer(vectors)).select("vec_id", "reduced")


@query("embed")
def _(s):
    docs = s.documents.select("doc_id", "text")
    return tm.embed(docs, tm.fit_embedder(docs)).select("doc_id", tm.vector_to_array("vector").alias("embedding"))


def _load_encoder():
    import numpy as np

    def encode(texts):
        # Letter frequencies: a stand-in for a sentence encoder.
        out = np.zeros((len(texts), 26), dtype="float32")
        for row, text in enumerate(texts):
            codes = np.frombuffer(str(text or "").lower().encode("ascii", "ignore"), dtype="uint8")
            codes = codes[(codes >= 97) & (codes <= 122)] - 97
            out[row] = np.bincount(codes, minlength=26) / max(len(codes), 1)
        return out

    return encode


@query("embed_user", """SELECT doc_id, list_transform(range(26), lambda i: CAST((length(l) - length(replace(l, chr(CAST(97 + i AS INTEGER)), '')))::DOUBLE
  / greatest(length(regexp_replace(l, '[^a-z]', '', 'g')), 1) AS FLOAT)) AS embedding FROM (SELECT doc_id, lower(coalesce(text, '')) AS l FROM documents)""")
def _(s):
    return tm.embed_with(s.documents.select("doc_id", "text"), _load_encoder).select("doc_id", "embedding")


@query("reduce_dims")
def _(s):
    return _reduced(s).select("vec_id", tm.vector_to_array("reduced").alias("reduced"))


@query("cluster_topics")
def _(s):
    reduced = materialise(_reduced(s), "reduced")
    return tm.cluster_topics(reduced, tm.fit_clusters(reduced), "vec_id")


@query("cluster_topics_density")
def _(s):
    return tm.density_topics(_reduced(s), 0.25, "vec_id")


@query("cluster_topics_varying_density")
def _(s):
    return dn.varying_density_topics(_reduced(s), "vec_id")


@query("assign_topics")
def _(s):
    model = tm.fit_topics(s.documents)
    return tm.assign_topics(s.documents, model, "doc_id")


@query("topic_map")
def _(s):
    return tm.topic_map(s.centroids)


# --- Report tables ----------------------------------------------------------------------

@query("report_sentiment_distribution", "SELECT sentiment_label, count(*) AS \"count\" FROM scored GROUP BY 1")
def _(s):
    return rp.sentiment_distribution(s.sentiment)


@query("report_sentiment_trend", f"""SELECT CAST(t.created_at AS DATE) AS day, {_mean('avg(s.sentiment_score)')} AS mean_score
  FROM r_sentiment s JOIN tickets t USING (ticket_id) GROUP BY 1""")
def _(s):
    return _round(rp.report_sentiment_trend(s.sentiment, s.tickets), "mean_score")


@query("recommendations", "SELECT ord, recommendation FROM recs")
def _(s):
    return rp.recommendations(s.inputs(written=True))


_WORDS = """SELECT topic_label, t AS word, count(*) AS n, row_number() OVER (PARTITION BY topic_label ORDER BY count(*) DESC, t) AS rn
  FROM tt_tok k JOIN r_topics r ON r.ticket_id = k.id WHERE topic_label IN (SELECT topic_label FROM topic_n ORDER BY n DESC, topic_label LIMIT 6) GROUP BY 1, 2"""


@query("topic_word_counts", f"SELECT topic_label, CAST(rn AS INTEGER) AS \"rank\", word, n AS \"count\" FROM ({_WORDS}) WHERE rn <= 50")
def _(s):
    return tp.topic_word_counts(s.topics, s.tickets)


@query("empty_section_markers", f"""SELECT * FROM (VALUES (4, 'entity_bar', 'No entity data available'), (4, 'entity_by_type', 'No entity type data available'),
  (4, 'entity_heatmap', 'Not enough variety for entity co-occurrence heatmap')) AS v(section, name, value)
  WHERE EXISTS (SELECT 1 FROM tickets)""")
def _(s):
    # A run whose entity stage gave nothing.
    inputs = s.inputs(written=True)
    inputs.entities = None
    return rp.report_facts(inputs).filter("status = 'no_data'").select("section", "name", "value")


def _facts_sql() -> str:
    def part(name: str, sql: str) -> str:
        return f"SELECT '{name}' AS name, ord, key, value, number FROM ({sql})"

    fields = ("total_tickets", "positive", "neutral", "negative", "avg_sentiment", "top_topic", "top_topic_count", "top_topic_pct", "critical_count", "critical_pct")
    text = ("top_topic", "top_topic_pct", "critical_pct")
    rows = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{f}' AS key, CAST({f} AS VARCHAR) AS value, {'NULL' if f in text else f'CAST({f} AS DOUBLE)'} AS number FROM summary"
        for i, f in enumerate(fields, 1)
    )
    num = "row_number() OVER (ORDER BY {})"
    n, d = "CAST(n AS DOUBLE) AS number", "NULL AS value"
    span = "(SELECT CAST(min(created_at) AS DATE) AS first, CAST(max(created_at) AS DATE) AS last FROM tickets)"
    sections = [
        part("period", f"SELECT 1 AS ord, 'period_start' AS key, CAST(first AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS number FROM {span} UNION ALL SELECT 2, 'period_end', CAST(last AS VARCHAR), NULL FROM {span}"),
        part("executive_summary", rows),
        part("topic_bar", f"SELECT {num.format('n DESC, topic_label')} AS ord, topic_label AS key, {d}, {n} FROM topic_n ORDER BY n DESC, topic_label LIMIT 12"),
        part("topic_pie", f"SELECT {num.format('topic_label = ' + chr(39) + 'Other' + chr(39) + ', n DESC, topic_label')} AS ord, topic_label AS key, {_pct('n', 'sum(n) OVER ()')} AS value, {n} FROM pie"),
        part("topic_words", f"SELECT {num.format('topic_label, rn')} AS ord, topic_label || ': ' || word AS key, {d}, {n} FROM ({_WORDS}) WHERE rn <= 50"),
        part("sentiment_distribution", f"SELECT {num.format('n DESC, sentiment_label')} AS ord, sentiment_label AS key, {d}, {n} FROM (SELECT sentiment_label, count(*) AS n FROM r_sentiment GROUP BY 1)"),
        part("sentiment_trend", f"SELECT {num.format('day')} AS ord, CAST(day AS VARCHAR) AS key, {d}, {_mean('m')} AS number FROM (SELECT CAST(created_at AS DATE) AS day, avg(sentiment_score) AS m FROM r_sentiment JOIN tickets USING (ticket_id) GROUP BY 1)"),
        part("sentiment_by_topic", f"SELECT {num.format('round(m, 9), topic_label')} AS ord, topic_label AS key, CAST(CAST(sign(round(m, 9)) AS INTEGER) AS VARCHAR) AS value, {_mean('m')} AS number FROM ({_BY_TOPIC})"),
        part("entity_bar", f"SELECT {num.format('n DESC, entity')} AS ord, entity AS key, {d}, {n} FROM (SELECT entity, count(*) AS n FROM r_entities GROUP BY 1) ORDER BY n DESC, entity LIMIT 15"),
        part("entity_by_type", f"SELECT {num.format('n DESC, entity_type')} AS ord, entity_type AS key, {d}, {n} FROM (SELECT entity_type, count(*) AS n FROM r_entities GROUP BY 1)"),
        part("entity_heatmap", f"SELECT {num.format('type_a, type_b')} AS ord, type_a || ' x ' || type_b AS key, {d}, {n} FROM heat"),
        part("critical_alerts", f"SELECT number AS ord, ticket_id AS key, reason AS value, CAST(NULL AS DOUBLE) AS number FROM ({_ALERTS})"),
        part("recommendations", "SELECT ord, NULL AS key, recommendation AS value, CAST(NULL AS DOUBLE) AS number FROM recs"),
    ]
    listed = " ".join(f"WHEN '{name}' THEN {no}" for no, name, _m in rp.SECTIONS)
    union = "\nUNION ALL ".join(sections)
    return f"""SELECT CASE name {listed} END AS section, name, CAST(ord AS INTEGER) AS ord, key, value, number, 'ok' AS status, '{rp.REPORT_TITLE}' AS title FROM ({union})"""


@query("report_facts", _facts_sql())
def _(s):
    facts = rp.report_facts(s.inputs(written=True))
    return facts.select("section", "name", "ord", "key", "value", "number", "status", "title")


@query("report_period_facts", """SELECT 'all' AS period, CAST(min(created_at) AS DATE) AS period_start, CAST(max(created_at) AS DATE) AS period_end FROM tickets
  UNION ALL SELECT n || ' days', CAST(CAST(max(created_at) AS DATE) - n * INTERVAL 1 DAY AS DATE), CAST(max(created_at) AS DATE) FROM tickets, (VALUES (7), (30)) d(n) GROUP BY n""")
def _(s):
    parts = [rp.report_period_facts(s.tickets, d).select(F.lit("all" if d is None else f"{d} days").alias("period"), "*") for d in (None, 7, 30)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- Whole run --------------------------------------------------------------------------

@query("run_weekly")
def _(s):
    output = scratch_path(s.spark, "weekly")
    result = run_weekly(s.spark, s.tickets, output, WeeklyConfig(names=s.names))
    if result.errors:
        raise RuntimeError("; ".join(result.errors))
    return s.spark.read.parquet(f"{output}/report")
