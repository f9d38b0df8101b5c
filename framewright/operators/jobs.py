"""Jobs: their states and how they may change, prompts for the model, and integrity of handoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import clock

#: Which state may follow which (fixed values).
NEXT = {"QUEUED": ("RUNNING", "CANCELLED"), "RUNNING": ("COMPLETED", "FAILED", "CANCELLED", "QUEUED"), "FAILED": ("QUEUED",), "CANCELLED": ("QUEUED",), "COMPLETED": ()}


def may_follow(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for a, bs in NEXT.items():
        out = out | ((old == a) & new.isin(*bs))
    return out


def apply_changes(jobs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs after one change each (job_id, new_status, new_progress), and the changes that were refused; progress never falls."""
    x = jobs.join(changes, "job_id", "left")
    ok = F.col("new_status").isNotNull() & may_follow(F.col("status"), F.col("new_status"))
    x = x.withColumn("_ok", ok)
    done = x.withColumn("progress", F.when(F.col("_ok") & (F.col("new_status") == "QUEUED"), 0.0).when(F.col("_ok"), F.greatest("progress", F.coalesce("new_progress", "progress"))).otherwise(F.col("progress")))
    done = done.withColumn("status", F.when(F.col("_ok"), F.col("new_status")).otherwise(F.col("status")))
    return done.drop("_ok", "new_status", "new_progress"), x.where(F.col("new_status").isNotNull() & ~F.col("_ok")).select("job_id", "status", "new_status")


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart jobs that were running are queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "RUNNING", "QUEUED").otherwise(F.col("status")))


def prompts(inputs: DataFrame, limit: int = 10_000) -> DataFrame:
    """The question put to the model about each candidate, and whether it is within the limit."""
    text = F.format_string(
        "Judge the current frame of a recorded lecture.\nCandidate: %d\nTime: %s\nImages: %s\nTranscript before: %s\nTranscript now: %s\nTranscript after: %s\nAnswer with one JSON object only.",
        F.col("candidate_id"), clock(F.col("timestamp_seconds")), F.array_join("image_roles", ", "), F.coalesce("before_text", F.lit("")), F.coalesce("current_text", F.lit("")), F.coalesce("after_text", F.lit("")),
    )
    return inputs.withColumn("prompt", text).withColumn("is_too_long", F.length("prompt") > limit)


def semantic_inputs(handoff: DataFrame, contexts: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates joined to context and frame, and the candidates that lack one of them."""
    f = frames.select("job_id", F.col("index").alias("frame_index"), F.struct("timestamp_seconds", "quality_score", "processed_path").alias("frame"))
    x = handoff.join(contexts.withColumn("_c", F.lit(True)), ["job_id", "candidate_id"], "left").join(f, ["job_id", "frame_index"], "left")
    good = F.col("_c").isNotNull() & F.col("frame").isNotNull()
    return x.where(good).drop("_c"), x.where(~good).select("job_id", "candidate_id")


def check_schema(rows: DataFrame, wanted: dict[str, str]) -> list[str]:
    """What is missing or of another type."""
    have = {f.name: f.dataType.simpleString() for f in rows.schema}
    return [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in wanted.items() if have.get(c) != t]


def broken_constraints(rows: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """How many rows break each constraint, in one pass; null counts as broken."""
    one = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in constraints.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in constraints]), F.array(*[F.col(n) for n in constraints]))).alias("constraint", "broken"))
