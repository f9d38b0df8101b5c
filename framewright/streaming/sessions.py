"""Change events over a stream of scored pairs, with thresholds carried over from finished jobs.

Thresholds that need a whole job cannot be had in one pass, so a stream takes them as a table.  Sessions are windows that
end when no candidate of their kind has come for the merge gap; late rows are dropped after the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_sessions(pairs: DataFrame, thresholds: DataFrame, merge_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Sessions of black, invalid and major pairs by job; ``pairs`` is streaming (or not) and has an event time ``at``."""
    x = pairs.join(thresholds.select("job_id", "major_threshold"), "job_id").withWatermark("at", late)
    kind = F.when(~F.col("valid"), "invalid").when(F.col("previous_is_black") | F.col("current_is_black"), "black").when(F.col("difference_score") >= F.col("major_threshold"), "major")
    x = x.withColumn("kind", kind).where(F.col("kind").isNotNull())
    s = x.groupBy("job_id", "kind", F.session_window("at", f"{merge_seconds} seconds").alias("w"))
    return s.agg(F.count("*").alias("members"), F.max("difference_score").alias("top_score"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).drop("w")
