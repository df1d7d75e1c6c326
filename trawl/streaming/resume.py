"""Resumable appends: a stream's new rows reach a table once, whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Parts by key hash in which a target is kept.
PARTS = 64


def append_once(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Write the stream's rows to ``target``, each key once: a batch keeps one row per key and leaves out keys that are already there. Progress is kept in ``checkpoint``, so a stopped job goes on where it ended.

    The target is partitioned by key hash (column ``part``), and a batch reads only the keys of the parts that its own keys fall in. Rows without a key are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
        done = existing(batch.sparkSession, target)
        if done is not None:
            touched = [r[0] for r in fresh.select("part").distinct().collect()]  # at most PARTS rows
            fresh = fresh.join(done.filter(F.col("part").isin(touched)).select(key), key, "left_anti")
        fresh.write.mode("append").partitionBy("part").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, group, n): counts per window of event time; rows later than the watermark are dropped by the engine."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), group, "n")
