"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import materialise

_BROADCAST_ROWS = 200_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column of ``taken`` has."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a written table of narrow rows whose counted size is below a bound; beyond it the join is by shuffle."""
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Join this table by shuffle. For tables that grow with the documents and are not counted: Spark sizes them by the files that they come
    from, far too low after an explode or where columns compress well, and would broadcast them through the driver."""
    return df.hint("merge")


def components(links: DataFrame, name: str) -> DataFrame:
    """Smallest node that each node of ``links`` (a, b) can reach, as (node, label).

    Every round takes the least label among the neighbours and then the label of that label, so the number of rounds
    grows with the logarithm of the longest path. Each round is a written table. Only nodes with a link are returned.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(both.filter("a <> b"), f"{name}-edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{name}-labels")
    nodes = labels.count()
    while True:
        known = small(labels, nodes)
        near = (
            edges.join(known, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        step = known.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = step.join(shuffled(jump), "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old")
        after = materialise(after, f"{name}-labels")
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
