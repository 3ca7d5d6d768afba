"""Ingest of annotation outputs as a stream of JSON-line files.

A restart continues from the checkpoint; a file is read once; repeated ids within
the watermark are dropped, and each batch is merged into a table with the latest
row of each id, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotations import OUTPUT, upsert


def stream_outputs(spark: SparkSession, folder: str, watermark: str = "1 day") -> DataFrame:
    """New output lines with ingest_time; ids repeated within the watermark are dropped."""
    lines = spark.readStream.schema(OUTPUT).json(folder)
    timed = lines.withColumn("ingest_time", F.col("_metadata.file_modification_time"))
    return timed.withWatermark("ingest_time", watermark).dropDuplicatesWithinWatermark(["custom_id"])


def merge_into(stream: DataFrame, target: str, checkpoint: str, key: str = "custom_id", recency: str = "ingest_time") -> StreamingQuery:
    """Start merging a stream into versions of a parquet table below target; the newest version is the table."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = current(spark, target, before=epoch)
        merged = upsert(old, batch, key, recency) if old is not None else upsert(batch.limit(0), batch, key, recency)
        merged.write.mode("overwrite").parquet(f"{target}/v={epoch:08d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (before an epoch), or None."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = sorted(n for n in found if n.startswith("v=") and (before is None or int(n[2:]) < before))
    return spark.read.parquet(f"{target}/{found[-1]}") if found else None


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream by tumbling window and a key, late rows within the watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
