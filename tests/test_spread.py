import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ticketlens.session import spread


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file of one row group has many splits, of which all but one are empty."""
    pq.write_table(pa.table({"id": list(range(20000))}), tmp_path / "t.parquet")
    cores = spark.sparkContext.defaultParallelism
    options = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        table = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert table.rdd.getNumPartitions() >= cores
        rows = [r["n"] for r in spread(table).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(rows) == 20000 and len(rows) >= cores and max(rows) <= 2 * 20000 / cores


def test_many_files_are_left_alone(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(cores).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert spread(table) is table
