"""Streams that can be stopped and started: new keys appended once, late repeats left out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append the rows whose key the sink does not hold yet, each key once; a batch that runs again adds nothing."""
    schema = stream.schema

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        spark = batch.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            fresh = fresh.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", os.fspath(checkpoint)).trigger(availableNow=True).start()


def batch_stats(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Completions, mean reward and gate rate of each window of `ts`; rows later than `late` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("reward").alias("reward_mean"), F.avg(F.col("gate").isNotNull().cast("int")).alias("gate_rate"))
