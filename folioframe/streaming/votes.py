"""Decisions over arriving candidates. The batch library has no streams; this adapter runs its vote
on each micro-batch and keeps, per block, the decision of the candidates seen so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = "paper string, block string, seq int, engine string, family string, content string, run_at timestamp"


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CANDIDATE).parquet(folder)


def family_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Distinct readings per block and day window; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark("run_at", late).groupBy(F.window("run_at", "1 day"), "paper", "block").agg(F.approx_count_distinct("family").alias("families"), F.count(F.lit(1)).alias("candidates"))


def start(stream: DataFrame, target: str, checkpoint: str):
    """Append finished windows to a Parquet folder, once over what is there."""
    return family_counts(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
