"""From frames to scored pairs, thresholds and change events.

All tables carry job_id; every window and aggregation is by it, so one shuffle on job_id serves the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import ratio
from framewright.params import DEFAULT, Params

METRICS = ("pixel_difference", "ssim_difference", "phash_difference", "edge_difference")
MAD_SCALE = 1.4826


def quality_flags(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Flags and quality_score from brightness, contrast, sharpness_score, edge_density and black_pixel_ratio."""
    dark = F.col("brightness") < p.dark_frame_threshold
    black = dark & (F.col("black_pixel_ratio") >= p.black_pixel_ratio)
    sharp = F.least(F.lit(1.0), F.col("sharpness_score") / max(1.0, p.blur_variance * 4.0))
    exposure = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("brightness") - 0.5) * 1.5)
    detail = F.least(F.lit(1.0), F.col("edge_density") * 8.0 + F.col("contrast"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 * sharp + 0.25 * exposure + 0.20 * detail))
    return frames.withColumns({
        "is_very_dark": dark,
        "is_black": black,
        "is_blurry": F.col("sharpness_score") < p.blur_variance,
        "is_low_information": (F.col("edge_density") < p.low_information_edge_density) & (F.col("contrast") < p.low_information_contrast),
        "quality_score": F.when(black, F.lit(0.0)).otherwise(score),
    })


def frame_stats(frames: DataFrame) -> DataFrame:
    """Counts of frames by flag for each job."""
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return frames.groupBy("job_id").agg(
        F.count("*").alias("total_frames"), n("is_valid").alias("valid_frames"), F.count_if(~F.col("is_valid")).alias("invalid_frames"), n("is_black").alias("black_frames"),
        n("is_very_dark").alias("very_dark_frames"), n("is_blurry").alias("blurry_frames"), n("is_low_information").alias("low_information_frames"),
    )


def adjacent_frames(frames: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """Each frame joined to the one before it; pairs with an invalid frame are invalid and say which one it was.

    ``keep`` adds columns over both frames: the earlier one's columns are there as ``previous_<name>``.
    """
    w = Window.partitionBy("job_id").orderBy("timestamp_seconds", "index")
    before = {f"previous_{c}": F.lag(c).over(w) for c in frames.columns if c != "job_id"}
    pairs = frames.withColumns(before).where(F.col("previous_index").isNotNull())
    valid = F.col("previous_is_valid") & F.col("is_valid")
    reason = F.when(~F.col("previous_is_valid"), "previous_frame_invalid").when(~F.col("is_valid"), "current_frame_invalid")
    return pairs.select(
        "job_id", F.col("previous_index").alias("previous_frame_index"), F.col("index").alias("current_frame_index"),
        "previous_timestamp_seconds", F.col("timestamp_seconds").alias("current_timestamp_seconds"),
        F.greatest(F.lit(0.0), F.col("timestamp_seconds") - F.col("previous_timestamp_seconds")).alias("delta_seconds"),
        F.coalesce("previous_is_black", F.lit(False)).alias("previous_is_black"), F.coalesce("is_black", F.lit(False)).alias("current_is_black"),
        valid.alias("valid"), reason.alias("reason"), *[c.alias(n) for n, c in (keep or {}).items()],
    )


def score_pairs(pairs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """difference_score: the four metrics by weight, clamped; all are null on invalid pairs."""
    weights = (p.diff_pixel_weight, p.diff_ssim_weight, p.diff_phash_weight, p.diff_edge_weight)
    total = sum(weights)
    if min(weights) < 0 or total <= 0:
        raise ValueError("difference weights must not be negative and must add up to more than 0")
    value = sum((F.col(m) * (w / total) for m, w in zip(METRICS, weights, strict=True)), F.lit(0.0))
    out = pairs.withColumns({m: F.when(F.col("valid"), F.col(m)) for m in METRICS})
    return out.withColumn("difference_score", F.when(F.col("valid"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))


def scored(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("valid") & F.col("difference_score").isNotNull())


def score_distribution(pairs: DataFrame) -> DataFrame:
    """Mean, extremes and exact percentiles of the scores of each job; jobs without a score have zeros."""
    s = F.when(F.col("valid"), F.col("difference_score"))
    q = F.percentile(s, F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9, 0.95, 0.99)]))
    one = pairs.groupBy("job_id").agg(F.count("*").alias("total_comparisons"), F.count(s).alias("valid_comparisons"), F.avg(s).alias("mean"), F.max(s).alias("max"), q.alias("q"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return one.select(
        "job_id", "total_comparisons", "valid_comparisons", (F.col("total_comparisons") - F.col("valid_comparisons")).alias("invalid_comparisons"), z(F.col("mean")).alias("mean_difference_score"),
        z(F.col("max")).alias("max_difference_score"), *[z(F.col("q")[i]).alias(n) for i, n in enumerate(("p50", "p75", "p90", "p95", "p99"))],
    )


def center_and_spread(pairs: DataFrame) -> DataFrame:
    """median, mad, p90, p95 and p99 of the scores of each job (null without scores): two aggregations on one partitioning."""
    s = F.when(F.col("valid"), F.col("difference_score"))
    one = pairs.groupBy("job_id").agg(F.percentile(s, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)])).alias("q"))
    far = scored(pairs).join(one, "job_id").groupBy("job_id").agg(F.percentile(F.abs(F.col("difference_score") - F.col("q")[0]), F.lit(0.5)).alias("mad"))
    return one.join(far, "job_id", "left").select("job_id", *[F.col("q")[i].alias(n) for i, n in enumerate(("median_score", "p90", "p95", "p99"))], "mad")


def change_thresholds(pairs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Thresholds of major and very major change, from the median, the spread and the top of each job's scores."""
    one = center_and_spread(pairs)
    robust = F.col("median_score") + p.major_robust_multiplier * MAD_SCALE * F.col("mad")
    major = F.least(F.lit(1.0), F.greatest(F.lit(p.major_min_score), F.col("p95"), robust))
    major = F.when(F.col("median_score").isNull(), F.lit(p.major_min_score)).otherwise(major)
    one = one.withColumn("major_threshold", major)
    very = F.greatest("major_threshold", F.least(F.lit(1.0), F.greatest(F.lit(p.very_major_min_score), F.col("p99"), F.col("major_threshold") * 1.15)))
    very = F.when(F.col("median_score").isNull(), F.lit(p.very_major_min_score)).otherwise(very)
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("median_score", "mad", "p90", "p95", "p99")}
    return one.withColumn("very_major_threshold", very).withColumns(zero).select("job_id", *zero, "major_threshold", "very_major_threshold")


def metric_agreement(threshold: Column) -> Column:
    """Share of the metrics that are there and support a change."""
    floor = F.greatest(F.lit(0.10), threshold * 0.45)
    there = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    support = sum((F.coalesce((F.col(m) >= floor).cast("int"), F.lit(0)) for m in METRICS), F.lit(0))
    return ratio(support, there)


def change_events(pairs: DataFrame, thresholds: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pairs of one kind (black, invalid, major) chained while each is within the merge window of the one before.

    An event stands where its strongest pair is (the earliest of equals) and reaches from its first to its last pair.
    """
    x = pairs.join(thresholds, "job_id")
    kind = F.when(~F.col("valid"), "invalid").when(F.col("previous_is_black") | F.col("current_is_black"), "black").when(F.col("difference_score") >= F.col("major_threshold"), "major")
    x = x.withColumn("kind", kind).where(F.col("kind").isNotNull())
    x = x.withColumn("strength", F.when(F.col("kind") == "invalid", 0.0).otherwise(F.coalesce("difference_score", F.lit(0.0))))
    w = Window.partitionBy("job_id", "kind").orderBy("current_timestamp_seconds", "current_frame_index")
    gap = F.col("current_timestamp_seconds") - F.lag("current_timestamp_seconds").over(w)
    x = x.withColumn("new", F.coalesce(gap > p.major_merge_window, F.lit(True)).cast("int")).withColumn("cluster", F.sum("new").over(w))
    x = x.withColumn("agreement", metric_agreement(F.col("major_threshold")))
    best = F.max_by(
        F.struct("current_timestamp_seconds", "previous_frame_index", "current_frame_index", "difference_score", "strength", "agreement", "major_threshold", "very_major_threshold", "median_score", "mad"),
        F.struct("strength", -F.col("current_timestamp_seconds"), -F.col("current_frame_index")),
    )
    e = x.groupBy("job_id", "kind", "cluster").agg(
        F.min("previous_timestamp_seconds").alias("start_timestamp_seconds"), F.max("current_timestamp_seconds").alias("end_timestamp_seconds"), F.count("*").alias("members"), best.alias("b")
    )
    major = F.col("kind") == "major"
    only = lambda c: F.when(major, c)
    excess = F.greatest(F.lit(0.0), F.col("b.strength") - F.col("b.major_threshold"))
    sure = F.least(F.lit(1.0), excess / F.greatest(F.lit(1e-6), 1.0 - F.col("b.major_threshold")))
    e = e.withColumns({
        "event_type": F.when(F.col("kind") == "black", "BLACK_TRANSITION").when(F.col("kind") == "invalid", "INVALID_GAP").when(F.col("b.strength") >= F.col("b.very_major_threshold"), "VERY_MAJOR_VISUAL_CHANGE").otherwise("MAJOR_VISUAL_CHANGE"),
        "threshold": only(F.col("b.major_threshold")),
        "robust_score": only((F.col("b.strength") - F.col("b.median_score")) / (MAD_SCALE * F.col("b.mad") + 1e-6)),
        "metric_agreement": only(F.col("b.agreement")),
        "confidence": F.when(F.col("kind") == "black", 1.0).when(F.col("kind") == "invalid", 0.0).otherwise(F.least(F.lit(1.0), 0.35 + 0.45 * sure + 0.20 * F.col("b.agreement"))),
        "rank": F.when(F.col("kind") == "black", 0).when(F.col("kind") == "invalid", 1).otherwise(2),
    })
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("b.current_timestamp_seconds", "rank", "cluster")).cast("bigint")
    return e.select(
        "job_id", number.alias("event_id"), "event_type", F.col("b.current_timestamp_seconds").alias("timestamp_seconds"), "start_timestamp_seconds", "end_timestamp_seconds",
        F.col("b.previous_frame_index").alias("previous_frame_index"), F.col("b.current_frame_index").alias("current_frame_index"), F.col("b.difference_score").alias("difference_score"),
        "threshold", "robust_score", "metric_agreement", "confidence", "members",
    )


def event_stats(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Events by type, the spacing of major ones, and their share of the valid comparisons; a row for every job with pairs."""
    base = pairs.groupBy("job_id").agg(F.count("*").alias("total_comparisons"), F.count_if(F.col("valid") & F.col("difference_score").isNotNull()).alias("valid_comparisons"))
    major = F.col("event_type").isin("MAJOR_VISUAL_CHANGE", "VERY_MAJOR_VISUAL_CHANGE")
    n = lambda t: F.coalesce(F.count_if(F.col("event_type") == t), F.lit(0))
    by = events.groupBy("job_id").agg(n("MAJOR_VISUAL_CHANGE").alias("major_events"), n("VERY_MAJOR_VISUAL_CHANGE").alias("very_major_events"), n("BLACK_TRANSITION").alias("black_transitions"), n("INVALID_GAP").alias("invalid_gaps"))
    w = Window.partitionBy("job_id").orderBy("timestamp_seconds", "event_id")
    gaps = events.where(major).withColumn("gap", F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(w))
    gaps = gaps.groupBy("job_id").agg(F.avg("gap").alias("average_seconds_between_major_changes"), F.percentile("gap", F.lit(0.5)).alias("median_seconds_between_major_changes"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("major_events", "very_major_events", "black_transitions", "invalid_gaps")}
    out = base.join(by, "job_id", "left").join(gaps, "job_id", "left").withColumns(zero)
    share = (F.col("major_events") + F.col("very_major_events")) / F.greatest(F.lit(1), F.col("valid_comparisons"))
    return out.withColumn("event_ratio", share.cast("double")).drop("valid_comparisons")


def quarantine(rows: DataFrame, bad: Column, limit: float) -> DataFrame:
    """Jobs whose share of bad rows is over the limit, with that share; callers leave these out and go on with the rest."""
    one = rows.groupBy("job_id").agg(ratio(F.count_if(bad), F.count("*")).alias("bad_ratio"))
    return one.where(F.col("bad_ratio") > limit)


