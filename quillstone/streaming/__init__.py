"""The same expressions over streams, with late and repeated documents handled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.pipeline import ExtractConfig, extract
from quillstone.runtime import ensure_checkpoint_dir, table


def extract_stream(df: DataFrame, key: str, event_time: str, delay: str = "1 hour", config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """Records of a stream of documents, each document once within the watermark."""
    return extract(df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]), config)


def counts_by_window(df: DataFrame, event_time: str, *keys: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Documents per window and keys; rows later than the watermark are left out when streamed."""
    return df.withWatermark(event_time, delay).groupBy(F.window(event_time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; files that come later are read as they appear."""
    # a pattern, since a stream takes a folder or a pattern but no single file
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4()}"


def append_rows(df: DataFrame) -> DataFrame:
    """Runs an appending stream over all files there are and gives its rows, which lie in the shared checkpoint folder."""
    at = _folder(df.sparkSession)
    query = df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")


def complete_rows(df: DataFrame) -> DataFrame:
    """Runs a streamed aggregate over all files there are; each batch replaces the result."""
    at = _folder(df.sparkSession)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows")

    query = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")
