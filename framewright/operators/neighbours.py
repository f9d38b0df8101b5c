"""Temporal neighbours: the frames before and after a candidate that show best how the picture came to be and goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ranges import points_in
from framewright.params import DEFAULT, Params


def choose(candidates: DataFrame, frames: DataFrame, segments: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(job_id, candidate_id, role, frame): at most one frame before (PREVIOUS) and after (NEXT).

    ``candidates`` has timestamp_seconds, frame_index, level, boundary_seconds, window_start and window_end; frames that look
    as the candidate's own (by level) or lie in invalid or black stretches do not count.
    """
    t, at = F.col("timestamp_seconds"), F.col("_at")
    f = frames.where(F.col("is_valid") & ~F.col("is_black") & F.col("processed_path").isNotNull()).select("job_id", F.col("timestamp_seconds").alias("_at"), F.col("index").alias("_index"), F.coalesce("quality_score", F.lit(0.0)).alias("_q"), F.col("level").alias("_level"))
    # the state of each frame: the earliest segment that holds it
    seg = segments.select("job_id", "segment_id", "state", F.col("start_timestamp_seconds").alias("_lo"), F.col("end_timestamp_seconds").alias("_hi"))
    held = points_in(f.select("job_id", "_at", "_index"), seg, "job_id", "_at", F.col("_lo") - 1e-6, F.col("_hi") + 1e-6, p.window_duration_saturation, (at >= F.col("_lo") - 1e-6) & (at <= F.col("_hi") + 1e-6))
    state = held.groupBy("job_id", "_index").agg(F.min_by("state", "segment_id").alias("_state"))
    f = f.join(state, ["job_id", "_index"], "left").where(F.coalesce(~F.col("_state").isin("INVALID", "BLACK_TRANSITION"), F.lit(True)))
    span = candidates.select("job_id", "candidate_id", "timestamp_seconds", "frame_index", "level", "boundary_seconds", "window_start", "window_end")
    gap = F.abs(t - at)
    fits = (at >= F.greatest(F.lit(0.0), t - p.neighbour_before)) & (at <= t + p.neighbour_after) & (F.col("_index") != F.col("frame_index")) & (at != t) & (gap >= p.neighbour_min_gap - 1e-6) & (F.abs(F.col("_level") - F.col("level")) > p.neighbour_duplicate_difference)
    met = points_in(f, span, "job_id", "_at", F.greatest(F.lit(0.0), t - p.neighbour_before), t + p.neighbour_after, p.neighbour_before + p.neighbour_after, fits)
    role = F.when(at < t, "PREVIOUS").otherwise("NEXT")
    changing = F.when(F.coalesce(F.col("_state") == "CHANGING", F.lit(False)), 0).otherwise(1)
    early = F.when(F.coalesce(at < F.col("boundary_seconds"), F.lit(False)), 0).otherwise(1)
    inside = F.when((at >= F.col("window_start")) & (at <= F.col("window_end")), 0).otherwise(1)
    liked = F.abs(gap - p.neighbour_preferred_gap)
    back = role == "PREVIOUS"
    key = F.struct(F.when(back, changing).otherwise(inside).alias("a"), F.when(back, early).otherwise(changing).alias("b"), liked.alias("c"), (-F.col("_q")).alias("d"), F.when(back, -at).otherwise(at).alias("e"), F.col("_index").alias("f"))
    return met.withColumn("role", role).withColumn("_key", key).groupBy("job_id", "candidate_id", "role").agg(F.min_by("_index", "_key").alias("frame_index"), F.min_by("_at", "_key").alias("frame_seconds"))
