"""Which stored results are still good, where to resume, and which rows to make anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_validity(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """VALID, MISSING, STALE or CORRUPT of each (job_id, stage, stage_order).

    ``wanted`` has config_fp and upstream_fp as they should be; ``stored`` has them as recorded, the artifact's recorded and
    actual fingerprints, and whether its checkpoint is there.
    """
    s = stored.select("job_id", "stage", F.col("config_fp").alias("_c"), F.col("upstream_fp").alias("_u"), F.col("artifact_fp").alias("_a"), F.col("actual_fp").alias("_x"), F.col("checkpoint").alias("_k"))
    x = wanted.join(s, ["job_id", "stage"], "left")
    state = F.when(F.col("_k").isNull() | ~F.col("_k"), "MISSING").when(~F.col("_a").eqNullSafe(F.col("_x")), "CORRUPT").when(~F.col("_c").eqNullSafe(F.col("config_fp")) | ~F.col("_u").eqNullSafe(F.col("upstream_fp")), "STALE").otherwise("VALID")
    return x.withColumn("state", state).drop("_c", "_u", "_a", "_x", "_k")


def resume_plan(validity: DataFrame) -> DataFrame:
    """For each job the last stage that can be trusted, the first to run again, and all that are to be cleared."""
    w = Window.partitionBy("job_id").orderBy("stage_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = validity.withColumn("_ok", F.min((F.col("state") == "VALID").cast("int")).over(w) == 1)
    return x.groupBy("job_id").agg(F.max_by("stage", F.when(F.col("_ok"), F.col("stage_order"))).alias("last_valid_stage"), F.min_by("stage", F.when(~F.col("_ok"), F.col("stage_order"))).alias("resume_stage"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.struct("stage_order", "stage")))), lambda s: s["stage"]).alias("stages_to_clear"))


def rows_to_make(inputs: DataFrame, cached: DataFrame, key: list[str], fp: str = "fingerprint") -> DataFrame:
    """Inputs without a cached row of the same key and fingerprint."""
    return inputs.join(cached.select(*key, fp).distinct(), [*key, fp], "left_anti")


def refreshed(cached: DataFrame, made: DataFrame, inputs: DataFrame, key: list[str]) -> DataFrame:
    """Cached rows that still have their input, with the new rows in place of old ones."""
    still = cached.join(inputs.select(*key).distinct(), key, "left_semi").join(made.select(*key).distinct(), key, "left_anti")
    return still.unionByName(made)


def orphans(cached: DataFrame, inputs: DataFrame, key: list[str]) -> DataFrame:
    return cached.join(inputs.select(*key).distinct(), key, "left_anti")


def repeated_ids(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def merge_checkpoints(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Checkpoints repaired: a stage whose artifact is seen valid counts as completed, one without it does not."""
    return stored.drop("completed").join(seen.select("job_id", "stage", F.lit(True).alias("_v")), ["job_id", "stage"], "left").withColumn("completed", F.coalesce("_v", F.lit(False))).drop("_v")


def expired_jobs(jobs: DataFrame, now: str, hours: int = 72) -> DataFrame:
    """Finished jobs whose end (or else last change) is older than the retention."""
    old = F.coalesce("completed_at", "updated_at") < F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours")
    return jobs.where(F.col("status").isin("COMPLETED", "FAILED", "CANCELLED") & old)
