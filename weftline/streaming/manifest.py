"""Streaming form of the append-only manifest: an extension, for scoring files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scored_stream(spark: SparkSession, folder: str, schema: T.StructType, group: str, value: str) -> DataFrame:
    """Running count and mean by group over JSON files that arrive in a folder."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def append_new(spark: SparkSession, folder: str, schema: T.StructType, key: str, out: str, checkpoint: str):
    """Appends rows with unseen keys of arriving files to a Parquet table, and ends when all are read."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            # Only the key column is read, and only keys that arrive again come back from the table.
            seen = spark.read.schema(schema).parquet(out).select(key).join(F.broadcast(fresh.select(key)) if fresh.count() <= 100_000 else fresh.select(key), key, "left_semi")
            fresh = fresh.join(seen, key, "left_anti")
        fresh.write.mode("append").parquet(out)

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
