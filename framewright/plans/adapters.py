"""Plain relational tables seen as the engine's canonical tables.

Every user's events are a job: an event is a frame whose picture is its value, so neighbouring frames differ by how far
the value moves.  Every conversation is a transcript.  Every vector's signs are a screenshot's hashes.  The clock of the
events is hours, so their parameters are scaled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators import change
from framewright.params import DEFAULT, Params

#: The events' usual gap is some hours where a video's is a second.
CLOCK = 10_800.0
EVENTS: Params = DEFAULT.scaled(CLOCK, max_stable_gap=3_600.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_quality from events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")
    w = Window.partitionBy("job_id").orderBy("us", "event_id")
    black = (F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0)
    x = e.select(
        "job_id", F.row_number().over(w).cast("bigint").alias("index"), ((F.col("us") - F.min("us").over(Window.partitionBy("job_id"))) / 1e6).alias("timestamp_seconds"),
        F.concat(F.lit("frames/"), F.col("event_id").cast("string")).alias("source_path"), F.concat(F.lit("small/"), F.col("event_id").cast("string")).alias("processed_path"),
        (~((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0))).alias("is_valid"), (F.col("value") / 500.0).alias("level"),
        F.when(black, 0.01).otherwise(F.col("value") / 500.0 * 0.9 + 0.06).alias("brightness"), ((F.col("event_id") % 89) / 178.0).alias("contrast"),
        (F.col("event_id") % 307).cast("double").alias("sharpness_score"), ((F.col("event_id") % 53) / 530.0).alias("edge_density"), F.when(black, 1.0).otherwise(0.0).alias("black_pixel_ratio"),
        ((F.col("event_id") % 65) / 64.0).alias("entropy"),
    )
    return change.quality_flags(x)


def differences(frames: DataFrame, p: Params = EVENTS) -> DataFrame:
    """Scored pairs: the four metrics are the step of the level, each in its own measure."""
    step = F.abs(F.col("level") - F.col("previous_level"))
    capped = lambda c: F.least(F.lit(1.0), c)
    keep = {"pixel_difference": capped(step), "ssim_difference": capped(step * 0.9), "phash_difference": capped(step * 1.1), "edge_difference": capped(step * 0.8)}
    return change.score_pairs(change.adjacent_frames(frames, keep), p)
