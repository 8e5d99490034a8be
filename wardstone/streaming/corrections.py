"""Exact counts over a stream with late records: partial counts by batch, merged when read.

A watermark drops what comes too late. Here each batch leaves the counts of its own records, of
whatever age, in a folder named by its number; the same batch come again replaces that folder, so
nothing is counted twice. A sum over the folders is the exact count of all that has arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def partial_counts(batch: DataFrame, key: str, at: str = "at", width: str = "1 minute") -> DataFrame:
    """start, key, n of one batch. Records without a time are in the window null."""
    start = F.when(F.col(at).isNotNull(), F.window(F.coalesce(at, F.timestamp_seconds(F.lit(0))), width).start)
    return batch.groupBy(start.alias("start"), key).agg(F.count(F.lit(1)).alias("n"))


def fold_batch(batch: DataFrame, path: str, number: int, key: str, at: str = "at", width: str = "1 minute") -> None:
    """Leave a batch's counts below path; batches up to the last compaction are in its sums already and are passed over."""
    if number > _compacted(batch.sparkSession, path):
        partial_counts(batch, key, at, width).write.mode("overwrite").parquet(f"{path}/partial/batch={number}")


def merged_counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """start, key, n over everything that has been folded. key is a string column."""
    upto = _compacted(spark, path)
    rows = _read(spark, f"{path}/partial/batch=*", f"{path}/partial", key).where(F.col("batch") > upto).drop("batch")
    if upto >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/sums/upto={upto}"))
    return rows.groupBy("start", key).agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, path: str, key: str, upto: int) -> None:
    """Sum the folders of batches up to this one, which are done, into one; readers go on with the old ones until it is whole.

    Folders that are in the sums are deleted after it. A run that fails before leaves all as it was.
    """
    was = _compacted(spark, path)
    if upto <= was:
        return
    rows = _read(spark, f"{path}/partial/batch=*", f"{path}/partial", key).where((F.col("batch") > was) & (F.col("batch") <= upto)).drop("batch")
    if was >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/sums/upto={was}"))
    rows.groupBy("start", key).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/sums/upto={upto}")
    fs, root = _files(spark, path)
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/partial/batch=*")) or []:
        if int(status.getPath().getName().split("=")[1]) <= upto:
            fs.delete(status.getPath(), True)


def start_counts(records: DataFrame, path: str, checkpoint: str, key: str, at: str = "at", width: str = "1 minute", every: str | None = "60 seconds") -> StreamingQuery:
    """Fold every batch of a stream. Without `every` all that has landed is taken and the query ends."""
    writer = records.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, path, number, key, at, width)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _read(spark: SparkSession, pattern: str, base: str, key: str) -> DataFrame:
    schema = StructType.fromDDL(f"start timestamp, {key} string, n long, batch long")
    fs, _ = _files(spark, base)
    if not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(pattern)


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _compacted(spark: SparkSession, path: str) -> int:
    """The last batch in the newest whole sums; -1 without any."""
    fs, root = _files(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sums/upto=*/_SUCCESS")) or []
    return max((int(s.getPath().getParent().getName().split("=")[1]) for s in found), default=-1)
