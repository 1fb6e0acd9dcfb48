"""Writers of the result tables. Every table is written by all tasks; nothing passes through the driver."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators.entities import entity_summary

FORMATS = ("parquet", "csv", "json")


def _write(df: DataFrame, path: str, fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}: use one of {FORMATS}")
    if fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        flat = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)}
        df.withColumns(flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_enriched(enriched: DataFrame, path: str, fmt: str = "parquet") -> str:
    return _write(enriched, path, fmt)


def write_topic_summary(info: DataFrame, path: str, fmt: str = "parquet") -> str:
    return _write(info, path, fmt)


def write_entity_summary(mentions: DataFrame, path: str, critical: DataFrame | None = None, fmt: str = "parquet") -> str:
    """Counts per entity and type; an empty mention table gives an empty summary."""
    return _write(entity_summary(mentions, critical), path, fmt)


def write_report(facts: DataFrame, path: str, run_id: str | None = None, fmt: str = "parquet") -> str:
    """Add one run to the report table, which is partitioned by run."""
    run_id = run_id or f"{datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
    # A report is a few hundred rows: one file per run.
    facts.withColumn("generated_at", F.lit(run_id)).repartition(1).write.mode("overwrite").format(fmt).save(f"{path}/run_id={run_id}")
    return run_id
