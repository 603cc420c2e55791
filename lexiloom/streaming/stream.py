"""Structured Streaming form of the stateless curation steps, with exact deduplication inside a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dedup import exact_key
from ..plans.pipeline import PipelineConfig, clean, label


def documents(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def curated_stream(df: DataFrame, cfg: PipelineConfig, time_col: str, lateness: str = "1 day") -> DataFrame:
    """Cleaned and labelled documents that pass, the first of each canonical text within the watermark.

    The state holds one key per text seen inside the watermark, so it is bounded by the lateness allowed.
    """
    done = label(clean(df, cfg), cfg).where("reject_reason is null")
    return done.withColumn("_key", exact_key("text")).withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def outcome_windows(df: DataFrame, cfg: PipelineConfig, time_col: str, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Documents per source and outcome in event-time windows; rows later than the watermark are left out."""
    done = label(clean(df, cfg), cfg)
    outcome = F.coalesce("reject_reason", F.lit("passed")).alias("outcome")
    return done.withWatermark(time_col, lateness).groupBy(F.window(time_col, window).alias("w"), "source", outcome).agg(F.count("*").alias("n")).select("w.start", "w.end", "source", "outcome", "n")


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Start the stream into Parquet; with ``once`` it ends when what is there has been read."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
