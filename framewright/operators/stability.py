"""Stability windows over stable segments, and the boundaries at which they begin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import clamp01, reasons, saturation, weighted, zero_if_null
from framewright.operators.change import scored
from framewright.operators.ranges import first_after, last_before, points_in
from framewright.params import DEFAULT, Params

EPS = 1e-9
#: What a boundary is worth by the state before it (fixed values).
TYPE_PRIOR = {
    "CHANGING_TO_STABLE": 1.0, "MAJOR_TRANSITION_TO_STABLE": 0.95, "BLACK_TRANSITION_TO_STABLE": 0.85, "STABLE_AT_VIDEO_START": 0.45, "INVALID_TO_STABLE": 0.0, "OTHER_TO_STABLE": 0.20,
}


def stability_windows(segments: DataFrame, pairs: DataFrame, frames: DataFrame, events: DataFrame, limits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A window for each stable segment: quiet, quality, neighbours, nearest events and reasons for rejection.

    Pairs and frames are those whose time is within the segment; means leave out nulls.
    """
    w = Window.partitionBy("job_id").orderBy("segment_id")
    about = {}
    for side, f in (("previous", F.lag), ("next", F.lead)):
        for c in ("state", "start_timestamp_seconds", "end_timestamp_seconds", "duration_seconds"):
            about[f"{side}_segment_{c.replace('_timestamp', '')}"] = f(c).over(w)
    about.pop("next_segment_duration_seconds")
    about["previous_end_frame_index"] = F.lag("end_frame_index").over(w)
    seg = segments.withColumns(about).where(F.col("state") == "STABLE")
    seg = seg.withColumn("window_id", F.row_number().over(w).cast("bigint")).select(
        "job_id", "window_id", F.col("segment_id").alias("source_segment_id"), F.col("start_timestamp_seconds").alias("start_seconds"), F.col("end_timestamp_seconds").alias("end_seconds"), "duration_seconds", "start_frame_index", "end_frame_index", *about
    )
    span = seg.select("job_id", "window_id", F.col("start_seconds").alias("_lo"), F.col("end_seconds").alias("_hi"))
    width = p.window_duration_saturation
    lo, hi = F.col("_lo") - EPS, F.col("_hi") + EPS
    inside = lambda rows, at: points_in(rows, span, "job_id", at, lo, hi, width, (F.col(at) >= lo) & (F.col(at) <= hi))
    s = inside(scored(pairs).select("job_id", "current_timestamp_seconds", "difference_score"), "current_timestamp_seconds").groupBy("job_id", "window_id").agg(
        F.count("*").alias("comparison_count"), F.avg("difference_score").alias("mean_difference_score"), F.percentile("difference_score", F.lit(0.5)).alias("median_difference_score"), F.max("difference_score").alias("max_difference_score"), F.stddev_pop("difference_score").alias("difference_stddev"),
    )
    valid = F.col("is_valid")
    share = lambda c: F.avg(c.cast("double"))
    mean = lambda c: F.avg(F.when(valid & ~F.isnan(c), F.col(c)))
    cols = ("timestamp_seconds", "is_valid", "is_black", "is_blurry", "is_low_information", "quality_score", "sharpness_score", "brightness", "contrast", "edge_density")
    f = inside(frames.select("job_id", *cols), "timestamp_seconds").groupBy("job_id", "window_id").agg(
        F.count("*").alias("frame_count"), share(valid).alias("valid_frame_ratio"), share(F.col("is_black")).alias("black_frame_ratio"), share(F.col("is_blurry")).alias("blurry_frame_ratio"), share(F.col("is_low_information")).alias("low_information_ratio"),
        mean("quality_score").alias("average_quality"), mean("sharpness_score").alias("average_sharpness"), mean("brightness").alias("average_brightness"), mean("contrast").alias("average_contrast"), mean("edge_density").alias("average_edge_density"),
    )
    x = seg.join(s, ["job_id", "window_id"], "left").join(f, ["job_id", "window_id"], "left").join(limits, "job_id")
    zeros = ("mean_difference_score", "median_difference_score", "max_difference_score", "difference_stddev", "valid_frame_ratio", "black_frame_ratio", "blurry_frame_ratio", "low_information_ratio")
    x = x.withColumns({c: zero_if_null(c) for c in zeros} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("comparison_count", "frame_count")})
    x = x.withColumn("invalid_frame_ratio", F.when(F.col("frame_count") > 0, 1.0 - F.col("valid_frame_ratio")).otherwise(0.0))
    quality = weighted([(zero_if_null("average_quality"), 0.55), ("valid_frame_ratio", 0.20), (1.0 - F.col("blurry_frame_ratio"), 0.10), (1.0 - F.col("low_information_ratio"), 0.10), (1.0 - F.col("black_frame_ratio"), 0.05)])
    dark = F.col("black_frame_ratio") > p.window_max_black_ratio
    enter = F.greatest(F.lit(1e-6), F.col("enter_stable_threshold"))
    leave = F.greatest(enter, F.col("exit_stable_threshold"))
    x = x.withColumn("_long", saturation("duration_seconds", p.window_duration_saturation)).withColumn("quality_score", F.when(dark, quality * 0.25).otherwise(quality))
    x = x.withColumn("stability_score", weighted([
        (clamp01(1.0 - F.col("mean_difference_score") / leave), p.stability_difference_weight), (clamp01(1.0 - F.col("difference_stddev") / F.greatest(enter * 2.0, F.lit(1e-6))), p.stability_variance_weight),
        (clamp01(1.0 - F.col("max_difference_score") / F.greatest(leave * 2.0, F.lit(1e-6))), p.stability_spike_weight), (F.col("_long"), p.stability_duration_weight),
    ]))
    x = x.withColumn("window_confidence", weighted([("stability_score", 0.50), ("quality_score", 0.25), ("valid_frame_ratio", 0.15), ("_long", 0.10)]))
    why = reasons(
        (F.col("duration_seconds") < p.window_min_duration, "TOO_SHORT"), (F.col("invalid_frame_ratio") > p.window_max_invalid_ratio, "TOO_MANY_INVALID_FRAMES"), (dark, "TOO_MANY_BLACK_FRAMES"), (F.col("comparison_count") == 0, "INSUFFICIENT_VALID_COMPARISONS"),
    )
    x = x.withColumn("rejection_reasons", why).withColumn("is_valid", F.size("rejection_reasons") == 0)
    x = last_before(x, events, "job_id", "start_seconds", "timestamp_seconds", "timestamp_seconds", "_before")
    x = first_after(x, events, "job_id", "end_seconds", "timestamp_seconds", "timestamp_seconds", "_after")
    gone = F.greatest(F.lit(0.0), F.col("start_seconds") - F.col("_before")), F.greatest(F.lit(0.0), F.col("_after") - F.col("end_seconds"))
    x = x.withColumn("seconds_since_previous_major_transition", F.when(F.col("_before").isNotNull(), gone[0])).withColumn("seconds_until_next_major_transition", F.when(F.col("_after").isNotNull(), gone[1]))
    return x.drop("_long", "_before", "_after", "average_quality", "enter_stable_threshold", "exit_stable_threshold", "major_threshold")


def window_stats(windows: DataFrame) -> DataFrame:
    """Windows, valid and rejected by reason, and how long and how stable the valid ones are."""
    ok = F.col("is_valid")
    q = lambda c, x: F.coalesce(F.percentile(F.when(ok, F.col(c)), F.lit(x)), F.lit(0.0))
    why = lambda r: F.count_if(F.array_contains("rejection_reasons", r))
    return windows.groupBy("job_id").agg(
        F.count("*").alias("total_stable_segments"), F.count_if(ok).alias("valid_windows"), F.count_if(~ok).alias("rejected_windows"), F.sum("duration_seconds").alias("total_stable_seconds"), zero_if_null(F.sum(F.when(ok, F.col("duration_seconds")))).alias("valid_stable_seconds"),
        zero_if_null(F.avg(F.when(ok, F.col("duration_seconds")))).alias("mean_window_seconds"), q("duration_seconds", 0.5).alias("median_window_seconds"), q("duration_seconds", 0.9).alias("p90_window_seconds"),
        zero_if_null(F.avg(F.when(ok, F.col("stability_score")))).alias("mean_stability_score"), q("stability_score", 0.5).alias("median_stability_score"), why("TOO_SHORT").alias("rejected_too_short"), why("TOO_MANY_BLACK_FRAMES").alias("rejected_black"), why("TOO_MANY_INVALID_FRAMES").alias("rejected_invalid"),
    )


def boundaries(windows: DataFrame, pairs: DataFrame, limits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A boundary at the start of each valid window: how far activity drops there, its score and reasons for rejection.

    The pairs before and after come from one join of the windows to all pairs within the context on either side.
    """
    x = windows.where("is_valid").withColumn("boundary_id", F.row_number().over(Window.partitionBy("job_id").orderBy("window_id")).cast("bigint"))
    t = F.col("start_seconds")
    state = F.col("previous_segment_state")
    kind = F.when(state.isin("CHANGING", "MAJOR_TRANSITION", "BLACK_TRANSITION", "INVALID"), F.concat(state, F.lit("_TO_STABLE"))).when(state.isNull() & (t <= 1e-6), "STABLE_AT_VIDEO_START").otherwise("OTHER_TO_STABLE")
    span = x.select("job_id", "boundary_id", t.alias("_t"), F.greatest(F.lit(0.0), t - p.boundary_context).alias("_lo"), F.least(F.col("end_seconds"), t + p.boundary_context).alias("_hi"))
    at, s = F.col("current_timestamp_seconds"), F.col("difference_score")
    near = points_in(scored(pairs).select("job_id", "current_timestamp_seconds", "difference_score"), span, "job_id", "current_timestamp_seconds", F.col("_lo") - EPS, F.col("_hi") + EPS, p.boundary_context * 2, (at >= F.col("_lo") - EPS) & (at <= F.greatest(F.col("_hi"), F.col("_t")) + EPS))
    pre, post = at <= F.col("_t") + EPS, (at >= F.col("_t") - EPS) & (at <= F.col("_hi") + EPS)
    m = near.groupBy("job_id", "boundary_id").agg(F.count_if(pre).alias("_n_pre"), F.count_if(post).alias("_n_post"), F.avg(F.when(pre, s)).alias("pre_mean"), F.max(F.when(pre, s)).alias("pre_max"), F.avg(F.when(post, s)).alias("post_mean"), F.max(F.when(post, s)).alias("post_max"))
    x = x.withColumn("boundary_type", kind).join(m, ["job_id", "boundary_id"], "left").join(limits, "job_id").withColumns({c: zero_if_null(c) for c in ("pre_mean", "pre_max", "post_mean", "post_max")})
    scale = F.greatest(F.col("enter_stable_threshold"), F.col("major_threshold"), F.lit(1e-6))
    prior = F.lit(0.0)
    for k, v in TYPE_PRIOR.items():
        prior = F.when(F.col("boundary_type") == k, v).otherwise(prior)
    x = x.withColumns({
        "activity_drop_score": clamp01(F.greatest(F.lit(0.0), F.col("pre_mean") - F.col("post_mean")) / scale),
        "preceding_activity_score": clamp01(F.greatest(F.col("pre_mean"), F.col("pre_max") * 0.65) / scale),
        "preceding_changing_duration_seconds": F.when(state == "CHANGING", F.col("previous_segment_duration_seconds")).otherwise(0.0),
    })
    score = weighted([("activity_drop_score", p.boundary_drop_weight), ("stability_score", p.boundary_stability_weight), ("quality_score", p.boundary_quality_weight), (saturation("duration_seconds", p.boundary_duration_saturation), p.boundary_duration_weight), (prior, p.boundary_type_weight)])
    x = x.withColumn("boundary_score", clamp01(score * (1.0 - 0.30 * F.col("low_information_ratio"))))
    k = F.col("boundary_type")
    free = k.isin("STABLE_AT_VIDEO_START", "INVALID_TO_STABLE")
    why = reasons(
        (k.isin("INVALID_TO_STABLE", "OTHER_TO_STABLE"), "UNTRUSTED_PREVIOUS_STATE"), (~free & (F.coalesce("_n_pre", F.lit(0)) == 0), "INSUFFICIENT_PRE_BOUNDARY_DATA"), (~free & (F.col("activity_drop_score") < p.boundary_min_drop), "NO_MEANINGFUL_ACTIVITY_DROP"),
        (F.coalesce("_n_post", F.lit(0)) == 0, "INSUFFICIENT_POST_BOUNDARY_DATA"), (F.col("quality_score") <= 0.05, "STABLE_WINDOW_LOW_QUALITY"), (F.col("stability_score") <= 0.05, "STABLE_WINDOW_TOO_WEAK"),
        ((F.col("boundary_score") < p.boundary_min_score) & (k != "STABLE_AT_VIDEO_START"), "BOUNDARY_SCORE_TOO_LOW"),
    )
    return x.select(
        "job_id", "boundary_id", "boundary_type", t.alias("timestamp_seconds"), F.col("window_id").alias("stable_window_id"), "pre_mean", "pre_max", "post_mean", "post_max", "activity_drop_score", "preceding_activity_score", "preceding_changing_duration_seconds",
        F.when(state == "CHANGING", F.col("previous_end_frame_index")).alias("last_changing_frame_index"), F.col("start_frame_index").alias("first_stable_frame_index"), "stability_score", "quality_score", "boundary_score", F.col("duration_seconds").alias("opportunity_duration_seconds"), why.alias("rejection_reasons"),
    ).withColumn("is_valid", F.size("rejection_reasons") == 0)


def boundary_stats(bounds: DataFrame) -> DataFrame:
    ok = F.col("is_valid")
    n = lambda t: F.count_if(ok & (F.col("boundary_type") == t))
    return bounds.groupBy("job_id").agg(
        F.count("*").alias("total_boundaries"), F.count_if(ok).alias("valid_boundaries"), n("CHANGING_TO_STABLE").alias("changing_to_stable"), n("MAJOR_TRANSITION_TO_STABLE").alias("major_to_stable"), n("BLACK_TRANSITION_TO_STABLE").alias("black_to_stable"), n("STABLE_AT_VIDEO_START").alias("at_start"),
        zero_if_null(F.avg(F.when(ok, F.col("boundary_score")))).alias("mean_boundary_score"), zero_if_null(F.percentile(F.when(ok, F.col("boundary_score")), F.lit(0.9))).alias("p90_boundary_score"), zero_if_null(F.avg(F.when(ok, F.col("activity_drop_score")))).alias("mean_activity_drop"),
    )
