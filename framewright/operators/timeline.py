"""The activity timeline: a two-threshold state for every pair, runs of one state, and their smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import ratio
from framewright.operators.change import MAD_SCALE
from framewright.operators.ranges import points_in
from framewright.params import DEFAULT, Params

EPS = 1e-6


def timeline_thresholds(thresholds: DataFrame, has_scores: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Scores at which a job enters and leaves the stable state.  ``has_scores`` has (job_id, n): the scored pairs."""
    x = thresholds.join(has_scores, "job_id", "left")
    major = F.col("major_threshold")
    robust = F.col("median_score") + p.stable_robust_multiplier * MAD_SCALE * F.col("mad")
    enter = F.least(F.greatest(F.lit(p.stable_min_score), robust), F.lit(p.stable_max_score), major * 0.35)
    none = F.coalesce(F.col("n"), F.lit(0)) == 0
    enter = F.when(none, F.least(major * 0.5, F.lit(p.stable_min_score))).otherwise(enter)
    x = x.withColumn("e", enter)
    leave = F.least(F.greatest(F.col("e"), F.col("e") * p.exit_stable_factor), F.when(none, major * 0.85).otherwise(major * 0.65))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return x.select("job_id", unit(F.col("e")).alias("enter_stable_threshold"), unit(leave).alias("exit_stable_threshold"), "major_threshold")


def pair_states(pairs: DataFrame, events: DataFrame, limits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """State of every pair.

    Invalid pairs, pairs after a long gap and pairs within an event take the state of that; the others are stable or
    changing by hysteresis.  As the entry threshold is not above the exit threshold, hysteresis has a closed form: a score
    at or below the entry sets the latch, one above the exit clears it, others leave it, and the last setting holds.
    """
    spans = events.select("job_id", "event_type", F.col("start_timestamp_seconds").alias("_lo"), F.col("end_timestamp_seconds").alias("_hi"))
    at = F.col("current_timestamp_seconds")
    weight = F.when(F.col("event_type") == "INVALID_GAP", 3).when(F.col("event_type") == "BLACK_TRANSITION", 2).otherwise(1)
    inside = points_in(pairs.select("job_id", "current_frame_index", "current_timestamp_seconds"), spans, "job_id", "current_timestamp_seconds", F.col("_lo"), F.col("_hi") + EPS, max(1.0, p.major_merge_window * 4), (at > F.col("_lo") + EPS) & (at <= F.col("_hi") + EPS))
    special = inside.groupBy("job_id", "current_frame_index").agg(F.max(weight).alias("special"))
    middle = pairs.groupBy("job_id").agg(F.percentile(F.when(F.col("delta_seconds") > 0, F.col("delta_seconds")), F.lit(0.5)).alias("usual_delta"))
    x = pairs.join(special, ["job_id", "current_frame_index"], "left").join(middle, "job_id").join(limits, "job_id")
    own = (
        F.when(~F.col("valid"), "INVALID")
        .when(F.coalesce(F.col("delta_seconds") > F.col("usual_delta") * p.long_gap_factor, F.lit(False)), "INVALID")
        .when(F.col("special") == 3, "INVALID")
        .when(F.col("special") == 2, "BLACK_TRANSITION")
        .when(F.col("special") == 1, "MAJOR_TRANSITION")
    )
    s = F.coalesce("difference_score", F.lit(0.0))
    latch = F.when(F.col("own").isNotNull(), F.lit(None)).when(s <= F.col("enter_stable_threshold"), True).when(s > F.col("exit_stable_threshold"), False)
    w = Window.partitionBy("job_id").orderBy("current_timestamp_seconds", "current_frame_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.coalesce(F.last("latch", ignorenulls=True).over(w), F.lit(False))
    x = x.withColumn("own", own).withColumn("latch", latch)
    return x.withColumn("state", F.coalesce("own", F.when(held, "STABLE").otherwise("CHANGING"))).drop("own", "latch", "special", "usual_delta", "enter_stable_threshold", "exit_stable_threshold")


def _islands(rows: DataFrame, state: str, name: str) -> DataFrame:
    """Numbers runs of pairs that have one state and touch in time."""
    w = Window.partitionBy("job_id").orderBy("start", "end")
    apart = (F.col(state) != F.lag(state).over(w)) | (F.col("start") > F.lag("end").over(w) + EPS)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(so_far))


def timeline_segments(states: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Segments: runs of one state with holes in time as INVALID, short stable runs dissolved, weak short changes bridged.

    Each pass numbers the runs and writes a run's new state on its pairs, so the whole is windows and one aggregation on
    one partitioning by job.
    """
    pair = ["previous_frame_index", "current_frame_index"]
    rows = states.select(
        "job_id", "state", F.col("previous_timestamp_seconds").alias("start"), F.col("current_timestamp_seconds").alias("end"),
        *[F.col(c).cast("bigint").alias(c) for c in pair], F.when(F.col("valid"), F.col("difference_score")).alias("score"), "major_threshold",
    )
    w = Window.partitionBy("job_id").orderBy("start", "end")
    # a hole becomes a row of its own, next to the pair after it
    before = F.lag("end").over(w)
    hole = F.struct(
        F.lit("INVALID").alias("state"), before.alias("start"), F.col("start").alias("end"), *[F.lit(None).cast("bigint").alias(c) for c in pair], F.lit(None).cast("double").alias("score")
    )
    own = F.struct("state", "start", "end", *pair, "score")
    rows = rows.select("job_id", "major_threshold", F.when(F.col("start") > before + EPS, F.array(hole, own)).otherwise(F.array(own)).alias("parts"))
    rows = _islands(rows.select("job_id", "major_threshold", F.inline("parts")), "state", "run0")

    # short stable runs are changing ones
    run = Window.partitionBy("job_id", "run0")
    length = F.max("end").over(run) - F.min("start").over(run)
    rows = rows.withColumn("state1", F.when((F.col("state") == "STABLE") & (length < p.min_stable_duration), "CHANGING").otherwise(F.col("state")))
    rows = _islands(rows, "state1", "run1")

    # a weak and short change between two stable runs is stable
    rows = rows.withColumns({"_lag": F.lag("state1").over(w), "_lead": F.lead("state1").over(w)})
    run = Window.partitionBy("job_id", "run1")
    ordered = run.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    length = F.greatest(F.lit(0.0), F.max("end").over(run) - F.min("start").over(run))
    weak = F.coalesce(F.max("score").over(run), F.lit(0.0)) < F.col("major_threshold") * 0.80
    between = (F.first("_lag").over(ordered) == "STABLE") & (F.last("_lead").over(ordered) == "STABLE")
    bridge = (F.col("state1") == "CHANGING") & between & weak & ((length <= p.max_stable_gap) | (length < p.min_changing_duration))
    rows = rows.withColumn("state2", F.when(F.coalesce(bridge, F.lit(False)), "STABLE").otherwise(F.col("state1")))
    rows = _islands(rows, "state2", "segment_id")

    place = F.when(F.col("current_frame_index").isNotNull(), F.struct("start", "current_frame_index"))
    out = rows.groupBy("job_id", F.col("segment_id").cast("bigint").alias("segment_id")).agg(
        F.first("state2").alias("state"), F.min("start").alias("start_timestamp_seconds"), F.max("end").alias("end_timestamp_seconds"),
        F.min_by("previous_frame_index", place).alias("start_frame_index"), F.max_by("current_frame_index", place).alias("end_frame_index"),
        F.avg("score").alias("mean_difference_score"), F.percentile("score", F.lit(0.5)).alias("median_difference_score"),
        F.min("score").alias("min_difference_score"), F.max("score").alias("max_difference_score"),
        F.count("current_frame_index").alias("comparison_count"), F.first("major_threshold").alias("_major"),
    )
    strength = F.when((F.col("state") == "CHANGING") & F.col("mean_difference_score").isNotNull(), F.least(F.lit(1.0), F.col("mean_difference_score") / F.greatest(F.lit(1e-6), F.col("_major"))))
    return out.withColumn("duration_seconds", F.greatest(F.lit(0.0), F.col("end_timestamp_seconds") - F.col("start_timestamp_seconds"))).withColumn("change_intensity", strength).drop("_major")


def timeline_stats(segments: DataFrame) -> DataFrame:
    """Duration and number of segments by state, and shares of the whole."""
    d = lambda *s: F.coalesce(F.sum(F.when(F.col("state").isin(*s), F.col("duration_seconds"))), F.lit(0.0))
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    over = ("MAJOR_TRANSITION", "BLACK_TRANSITION")
    x = segments.groupBy("job_id").agg(
        F.sum("duration_seconds").alias("total_duration_seconds"), d("STABLE").alias("stable_duration_seconds"), d("CHANGING").alias("changing_duration_seconds"), d(*over).alias("transition_duration_seconds"), d("INVALID").alias("invalid_duration_seconds"),
        n("STABLE").alias("stable_segment_count"), n("CHANGING").alias("changing_segment_count"), n(*over).alias("transition_segment_count"), n("INVALID").alias("invalid_segment_count"),
    )
    return x.withColumns({f"{s}_ratio": F.when(F.col("total_duration_seconds") > 0, ratio(f"{s}_duration_seconds", "total_duration_seconds")).otherwise(0.0) for s in ("stable", "changing", "invalid")})
