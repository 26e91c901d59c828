"""Run logs as streams: append-only JSON lines in, deduplicated rows and windowed roll-ups out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, form: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)


def first_per_key(stream: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_rollup(stream: DataFrame, at: str, group: str, value: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count, mean and sum of a value per time window and group; late rows count until the watermark passes."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), group)
    out = w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), group, "n", "mean", "total")


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends the rows of each batch whose key isn't stored yet; a batch that is replayed adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fresh = batch.dropDuplicates(keys)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
