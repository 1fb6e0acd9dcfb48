"""A corpus pipeline of five operators: quality rules, near-dedup, secret scans, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketlens.llm.mixing import mix
from ticketlens.llm.neardup import keep_one
from ticketlens.llm.pieces import encode_documents
from ticketlens.llm.quality import keep_good
from ticketlens.llm.queries import piece_model
from ticketlens.llm.secrets import redact
from ticketlens.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a null, empty or blank text is one. A null source is a host of its own. Repeated rows stay or go
    together; an empty table stays empty. Other columns are kept."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays, with all rows of that id. Texts without words and rows without an id
    that are alone stay; an empty table stays empty. Other columns are kept."""
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become a marker. A null or empty text stays; rows with equal id and text get equal texts; an empty
    table stays empty. Other columns are kept, ``n_chars`` is set anew."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Texts without words have no size and go; a null source is a source; an
    empty table stays empty. Other columns are kept."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per mixed document with its ids. A null or empty text has the end id alone; repeated rows get equal ids; an empty table gives no
    rows."""
    return encode_documents(docs, piece_model, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SentencePiece ids cannot be computed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
