"""Session helpers: local session for tests, shared scratch space, intermediate tables."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "*", app: str = "ticketlens") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ticketlens-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/ticketlens/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application wrote to the shared folder. Call it when its results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that was started without it on its path. Once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_ticketlens_shipped", False):
        return
    sc._ticketlens_shipped = True
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ticketlens-package-"), "ticketlens.zip")  # the driver serves it from here
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as package:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table that arrives in fewer files than there are cores; others are left as they are. Splits do not count: a row group is
    read whole by one task, so that of the splits of a large file some are empty and some hold several row groups."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions())) if len(df.inputFiles()) < cores else df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a constant of the plan. Unlike rows handed over from Python, their size is known to the
    planner, so that joins with them need no shuffle."""
    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    fields = ", ".join(field.strip().replace(" ", ": ", 1) for field in schema.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))
