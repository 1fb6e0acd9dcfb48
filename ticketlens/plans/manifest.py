"""A manifest of finished stages, so that a run that was killed goes on where it stopped.

A stage's key is a hash of its name, the settings that it depends on, and the keys of the stages it reads; the first stage's key holds
the input's fingerprint. The key is written, by renaming a finished file, only after the stage's table is complete. A later run takes a
table as it is if its key is the same, and makes it anew otherwise; so changed settings redo only what depends on them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """Keys of finished stages below ``root``. Files are reached through Spark's file systems, so that the folder may lie in any store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.keys: dict[str, str | None] = {}

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def key(self, name: str, settings: object, *needs: str) -> str:
        """The key of a stage. A needed stage that failed counts as such, so that what was made without it is made anew when it succeeds."""
        text = json.dumps([name, settings, [[n, self.keys.get(n)] for n in needs]], sort_keys=True, default=str)
        self.keys[name] = hashlib.sha256(text.encode()).hexdigest()
        return self.keys[name]

    def failed(self, name: str) -> None:
        self.keys[name] = None

    def holds(self, name: str, key: str) -> bool:
        """Whether the stage was finished under this key."""
        path, fs = self._path(name)
        if not fs.exists(path):
            return False
        return self.spark.read.text(path.toString()).first()[0] == key

    def start(self, name: str) -> None:
        """Forget the stage, before its table is written."""
        path, fs = self._path(name)
        fs.delete(path, True)

    def finish(self, name: str, key: str) -> None:
        """Remember the stage, after its table was written."""
        self.start(name)
        path, fs = self._path(name)
        draft, _ = self._path(f"_{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(key.encode()))
        out.close()
        if not fs.rename(draft, path):
            raise OSError(f"could not record the end of {name}")


def file_fingerprint(spark: SparkSession, path: str) -> list:
    """Names, lengths and times of the files of a path, in order of their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found, out = fs.listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def table_fingerprint(df: DataFrame | None) -> list:
    """Number of rows and a sum of their hashes, whatever their order; for tables that are not files."""
    if df is None:
        return []
    row = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    return [df.schema.simpleString(), row.n, str(row.h)]
