"""Ticket readers. Known columns get their types from a schema; extra columns pass through."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.sources.splitting import csv_records, json_records
from ticketlens.operators.tables import ENTITIES_SCHEMA, SENTIMENT_COLUMNS, map_columns, require_columns, validate_tickets

TICKET_COLUMNS = ("ticket_id", "text", "created_at", "priority", "channel", "category")
TICKET_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TICKET_COLUMNS])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True, split: bool = True) -> DataFrame:
    """CSV with a header and quoted line breaks. Large files are read by many tasks; all files must have one header, which must name the
    columns of ``schema`` in order. Lines end in ``\\n`` or ``\\r\\n``. ``split=False`` reads each file in one piece; ``multi_line=False``
    lets Spark split at every line break, which tears quoted ones."""
    if split and multi_line:
        names, rows = csv_records(spark, path)
        if schema is None:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        elif names and [n.lower() for n in names] != [f.name.lower() for f in schema]:
            raise ValueError(f"the header {names} does not name the columns {schema.names}")
        if not len(schema):
            return spark.createDataFrame([], schema)
        options = {"quote": '"', "escape": '"', "multiLine": "true"}
        return rows.select(F.from_csv("record", _ddl(schema), options).alias("r")).select("r.*")
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    if schema is not None:
        return reader.schema(schema).option("enforceSchema", False).csv(path)
    return reader.csv(path)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None, split: bool = True) -> DataFrame:
    """One JSON document of records per file. With a schema, large files are read by many tasks; without one, or with ``split=False``, each file is
    read in one piece, as its columns are not known before."""
    if split and schema is not None:
        parsed = json_records(spark, path).select(F.from_json("record", schema, {"primitivesAsString": "true"}).alias("r"))
        return parsed.select("r.*")
    return _json(spark, schema).option("multiLine", True).json(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON record per line; large files are split."""
    return _json(spark, schema).json(path)


def _json(spark: SparkSession, schema: T.StructType | None):
    reader = spark.read.option("primitivesAsString", True)
    return reader.schema(schema) if schema is not None else reader


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


_READERS = {".csv": scan_csv, ".json": scan_json, ".jsonl": scan_jsonl, ".parquet": scan_parquet}


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def scan_tickets(
    spark: SparkSession, path: str, schema: T.StructType | None = None, ticket_id: str = "ticket_id", text: str = "text",
    created_at: str = "created_at", priority: str | None = "priority", multi_line: bool = True,
) -> DataFrame:
    """Read by suffix, check the required columns and rename configured ones to the standard names. ``multi_line`` is that of CSV files."""
    return map_columns(_by_suffix(spark, path, schema, multi_line), ticket_id, text, created_at, priority)


def load_tickets(spark: SparkSession, path: str, text_col: str = "text", schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Read by suffix and validate: blank texts and whole-row duplicates are dropped. ``multi_line`` is that of CSV files."""
    return validate_tickets(require_columns(_by_suffix(spark, path, schema, multi_line), [text_col]), text_col)


def _by_suffix(spark: SparkSession, path: str, schema: T.StructType | None, multi_line: bool) -> DataFrame:
    suffix = PurePosixPath(path).suffix.lower()
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if suffix not in _READERS:
        raise ValueError(f"unsupported suffix {suffix!r}: use one of {sorted(_READERS)}")
    if suffix == ".csv":
        return scan_csv(spark, path, schema, multi_line)
    return _READERS[suffix](spark, path, schema)


def load_enriched(spark: SparkSession, path: str):
    """Report inputs from an enriched table written earlier; nothing is scored again."""
    from ticketlens.operators.report import ReportInputs

    enriched = scan_parquet(spark, path)
    require_columns(enriched, ["ticket_id", "topic", "topic_label", *SENTIMENT_COLUMNS])
    if "entities" in enriched.columns:
        entities = enriched.select("ticket_id", F.inline("entities")).select(
            "ticket_id", F.col("text").alias("entity"), F.col("label").alias("entity_type")
        )
    else:
        entities = spark.createDataFrame([], ENTITIES_SCHEMA)
    return ReportInputs(
        topics=enriched.select("ticket_id", "topic", "topic_label"),
        sentiment=enriched.select("ticket_id", "sentiment_label", F.col("lex_compound").alias("sentiment_score")),
        entities=entities,
        tickets=enriched.select(*[c for c in TICKET_COLUMNS if c in enriched.columns]),
    )
