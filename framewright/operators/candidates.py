"""Candidate moments within stability windows: where to look, the frame found there, its scores, and its rank."""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import clamp01, reasons, saturation, weighted, zero_if_null
from framewright.operators.change import scored
from framewright.operators.ranges import points_in
from framewright.params import DEFAULT, Params

EPS = 1e-9
#: Which of two requests for one frame stays (fixed values, smaller first).
TYPE_ORDER = {"SETTLED_START": 0, "MID_STABLE": 1, "LATE_STABLE": 2, "PRE_EXIT": 3, "EARLY_STABLE": 4}
#: What a kind of moment adds to its rank (fixed values).
TYPE_PRIOR = {"SETTLED_START": 0.006, "EARLY_STABLE": 0.002, "MID_STABLE": 0.010, "LATE_STABLE": 0.008, "PRE_EXIT": 0.0}
SOURCE_PRIOR = 0.008
#: Where in the usable span the requests stand, by how many are wanted (fixed values; null is its end).
PLACES = {
    1: [("MID_STABLE", 0.5)],
    2: [("SETTLED_START", 0.0), ("MID_STABLE", 0.5)],
    3: [("SETTLED_START", 0.0), ("MID_STABLE", 0.5), ("PRE_EXIT", None)],
    4: [("SETTLED_START", 0.0), ("EARLY_STABLE", 0.33), ("LATE_STABLE", 0.72), ("PRE_EXIT", None)],
    5: [("SETTLED_START", 0.0), ("EARLY_STABLE", 0.25), ("MID_STABLE", 0.5), ("LATE_STABLE", 0.78), ("PRE_EXIT", None)],
}


def by_name(column: Column, values: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def requested_positions(windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Requests of each valid window: more in a longer one, those too near the request before them left out."""
    d = F.col("duration_seconds")
    want = F.least(F.when(d < p.short_window, 1).when(d < p.medium_window, 2).when(d < p.long_window, 3).otherwise(5), F.lit(max(1, p.max_per_window)))
    first, last = F.col("start_seconds") + p.settle_delay, F.col("end_seconds") - p.exit_margin
    span = last - first
    place = lambda kind, share: F.struct(F.lit(kind).alias("type"), (last if share is None else first + span * share).alias("at"))
    lists = F.when(first > last, F.array(F.struct(F.lit("MID_STABLE").alias("type"), ((F.col("start_seconds") + F.col("end_seconds")) / 2.0).alias("at"))))
    for n, places in PLACES.items():
        if n < 5:
            lists = lists.when(want == n, F.array(*[place(*x) for x in places]))
    lists = lists.otherwise(F.array(*[place(*x) for x in PLACES[5]]))
    # a request stays if it is far enough from the last one that stayed: a fold over at most five
    kind = "array<struct<type:string,at:double>>"
    far = lambda acc, x: (F.size(acc) == 0) | (F.abs(x["at"] - F.element_at(acc, -1)["at"]) >= p.min_spacing - EPS)
    kept = F.aggregate("_all", F.array().cast(kind), lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return windows.where("is_valid").withColumn("_all", lists.cast(kind)).withColumn("_kept", kept).select("*", F.posexplode("_kept").alias("request", "_r")).withColumns({"candidate_type": F.col("_r.type"), "requested_timestamp_seconds": F.col("_r.at")}).drop("_all", "_kept", "_r")


def nearest_frames(requests: DataFrame, frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The usable frame nearest to each request, within the radius and the window; of equals the better, then the later."""
    usable = frames.where(F.col("is_valid") & ~F.col("is_black") & F.col("source_path").isNotNull() & F.col("processed_path").isNotNull())
    f = usable.select("job_id", F.struct(*[F.col(c) for c in usable.columns if c != "job_id"]).alias("f"), F.col("timestamp_seconds").alias("_at"))
    t = F.col("requested_timestamp_seconds")
    span = requests.select("job_id", "window_id", "request", "requested_timestamp_seconds", F.greatest(F.col("start_seconds"), t - p.search_radius).alias("_lo"), F.least(F.col("end_seconds"), t + p.search_radius).alias("_hi"))
    lo, hi = F.col("_lo") - EPS, F.col("_hi") + EPS
    met = points_in(f, span, "job_id", "_at", lo, hi, p.search_radius * 2, (F.col("_at") >= lo) & (F.col("_at") <= hi))
    key = F.struct(F.round(F.abs(F.col("_at") - t), 9), -zero_if_null("f.quality_score"), -F.col("_at"), F.col("f.index"))
    return met.groupBy("job_id", "window_id", "request").agg(F.min_by("f", key).alias("f"))


def generate(windows: DataFrame, bounds: DataFrame, frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Candidates with their frame, numbered in time; rejected ones stay, with reasons."""
    req = requested_positions(windows, p)
    b = bounds.where("is_valid").select("job_id", F.col("stable_window_id").alias("window_id"), "boundary_id", "boundary_type", F.col("timestamp_seconds").alias("boundary_at"), "boundary_score", "activity_drop_score", "preceding_activity_score", "preceding_changing_duration_seconds")
    x = req.join(b, ["job_id", "window_id"], "left" if p.allow_window_only else "inner").join(nearest_frames(req, frames, p), ["job_id", "window_id", "request"], "left")
    t, at = F.col("requested_timestamp_seconds"), F.col("f.timestamp_seconds")
    where = F.coalesce(at, t)
    outside = (t < F.col("start_seconds") - EPS) | (t > F.col("end_seconds") + EPS)
    x = x.withColumns({
        "_why": reasons((outside, "OUTSIDE_WINDOW"), (F.col("f").isNull(), "NO_VALID_FRAME_NEAR_TIMESTAMP")),
        "where": where,
        "relative_position": clamp01((where - F.col("start_seconds")) / F.greatest(F.col("duration_seconds"), F.lit(1e-9))),
        "seconds_after_boundary": F.when(F.col("boundary_id").isNotNull(), F.greatest(F.lit(0.0), where - F.col("boundary_at"))),
        "seconds_before_stable_exit": F.greatest(F.lit(0.0), F.col("end_seconds") - where),
        "_order": by_name(F.col("candidate_type"), TYPE_ORDER).cast("int"),
    } | {c: zero_if_null(c) for c in ("boundary_score", "activity_drop_score", "preceding_activity_score", "preceding_changing_duration_seconds")})
    # of several requests for one frame the first kind stays
    same = Window.partitionBy("job_id", "window_id", "f.index", F.size("_why") == 0).orderBy("_order", "request")
    x = x.withColumn("_why", F.when((F.size("_why") == 0) & (F.row_number().over(same) > 1), F.array(F.lit("DUPLICATE_TIMESTAMP"))).otherwise(F.col("_why")))
    best = Window.partitionBy("job_id", F.size("_why") == 0).orderBy(F.desc("boundary_score"), F.desc("stability_score"), F.desc("quality_score"), "where", "window_id", "request")
    x = x.withColumn("_why", F.when((F.size("_why") == 0) & (F.row_number().over(best) > p.max_total_candidates), F.array(F.lit("GLOBAL_CANDIDATE_CAP"))).otherwise(F.col("_why")))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("where", "window_id", "_order", "request")).cast("bigint")
    frame = {c: F.col(f"f.{c}") for c in ("brightness", "contrast", "sharpness_score", "edge_density", "entropy") if c in frames.columns}
    flag = {c: F.coalesce(F.col(f"f.{c}"), F.lit(False)) for c in ("is_blurry", "is_black", "is_low_information")}
    return x.select(
        "job_id", number.alias("candidate_id"), F.col("window_id").alias("stable_window_id"), "boundary_id", "candidate_type", F.when(F.col("boundary_id").isNotNull(), "BOUNDARY").otherwise("WINDOW_ONLY").alias("source_type"), "boundary_type",
        "requested_timestamp_seconds", at.alias("frame_timestamp_seconds"), F.col("f.index").alias("frame_index"), F.col("f.source_path").alias("sampled_frame_path"), F.col("f.processed_path").alias("processed_frame_path"),
        F.col("start_seconds").alias("stable_window_start_seconds"), F.col("end_seconds").alias("stable_window_end_seconds"), F.col("duration_seconds").alias("stable_window_duration_seconds"), "relative_position", "seconds_after_boundary", "seconds_before_stable_exit",
        "boundary_score", "activity_drop_score", "preceding_activity_score", "preceding_changing_duration_seconds", "stability_score", F.col("quality_score").alias("window_quality_score"), F.col("f.quality_score").alias("frame_quality_score"),
        *[c.alias(n) for n, c in (frame | flag).items()], F.col("_why").alias("rejection_reasons"), (F.size("_why") == 0).alias("is_valid"),
    )


def generation_stats(candidates: DataFrame) -> DataFrame:
    ok = F.col("is_valid")
    moved = F.abs(F.col("frame_timestamp_seconds") - F.col("requested_timestamp_seconds")) > 1e-6
    one = candidates.groupBy("job_id").agg(F.count("*").alias("candidates_generated"), F.count_if(ok).alias("valid_candidates"), F.count_if(~ok).alias("rejected_candidates"), F.countDistinct("stable_window_id").alias("windows"), F.count_if(moved).alias("shifted_to_nearby_frame"))
    by = candidates.where(ok).groupBy("job_id", "candidate_type").count().groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("candidate_type", "count")))).alias("candidate_types"))
    return one.join(by, "job_id", "left").withColumn("mean_candidates_per_window", F.col("valid_candidates") / F.col("windows"))


def brightness_quality(c: Column) -> Column:
    """Full between .12 and .88, falling off to the ends, so dark boards and bright slides are both usable."""
    return F.when(c.isNull(), 0.0).when(c.between(0.12, 0.88), 1.0).when(c < 0.12, clamp01(c / 0.12)).otherwise(clamp01((1.0 - c) / 0.12))


def position_score(c: Column) -> Column:
    return clamp01(1.0 - F.abs(c - 0.65) / 0.70)


def score(candidates: DataFrame, pairs: DataFrame, limits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Explained scores of every candidate.  ``entropy`` may be a column of the candidates (image entropy over 8 bits)."""
    good = F.col("is_valid") & F.col("frame_timestamp_seconds").isNotNull() & F.col("processed_frame_path").isNotNull()
    t = F.col("frame_timestamp_seconds")
    span = candidates.where(good).select("job_id", "candidate_id", (t - p.local_context).alias("_lo"), (t + p.local_context).alias("_hi"))
    at, lo, hi = F.col("current_timestamp_seconds"), F.col("_lo") - EPS, F.col("_hi") + EPS
    near = points_in(scored(pairs).select("job_id", "current_timestamp_seconds", "difference_score"), span, "job_id", "current_timestamp_seconds", lo, hi, p.local_context * 2, (at >= lo) & (at <= hi))
    local = near.groupBy("job_id", "candidate_id").agg(F.avg("difference_score").alias("_mean"), F.max("difference_score").alias("_max"))
    x = candidates.join(local, ["job_id", "candidate_id"], "left").join(limits, "job_id")
    stable = F.greatest(F.lit(1e-6), F.col("exit_stable_threshold"))
    major = F.greatest(stable, F.col("major_threshold"), F.lit(1e-6))
    z = zero_if_null
    contrast = clamp01(z("contrast") * 2.0)
    visual = weighted([(clamp01(z("sharpness_score") / p.sharpness_saturation), 0.35), (brightness_quality(F.col("brightness")), 0.15), (contrast, 0.15), (z("frame_quality_score"), 0.35)])
    visual = F.when(F.col("is_black"), 0.0).when(F.col("is_blurry"), visual * 0.75).otherwise(visual)
    entropy = z("entropy") if "entropy" in candidates.columns else F.lit(0.0)
    density = weighted([(clamp01(z("edge_density") * 8.0), 0.55), (contrast, 0.20), (entropy, 0.25)])
    density = F.when(F.col("is_low_information"), density * 0.60).otherwise(density)
    start = F.when(F.col("seconds_after_boundary").isNull(), 0.20).otherwise(clamp01(1.0 - F.col("seconds_after_boundary") / p.safe_margin))
    risk = weighted([(start, 0.35), (clamp01(1.0 - F.col("seconds_before_stable_exit") / p.safe_margin), 0.35), (clamp01(z("_max") / major), 0.30)])
    before = weighted([("preceding_activity_score", 0.75), (saturation("preceding_changing_duration_seconds", p.boundary_duration_saturation), 0.25)])
    none = lambda c, other=0.0: F.when(good, c).otherwise(F.lit(other))
    x = x.withColumns({
        "visual_quality_score": none(clamp01(visual)), "content_density_score": none(clamp01(density)), "local_stability_score": none(clamp01(1.0 - z("_mean") / stable)), "transition_risk_score": none(risk, 1.0),
        "preceding_activity_strength": none(before), "positional_completeness_score": position_score(F.col("relative_position")),
    })
    x = x.withColumn("transition_safety_score", none(clamp01(1.0 - F.col("transition_risk_score"))))
    # gain against the earliest valid candidate of the window
    w = Window.partitionBy("job_id", "stable_window_id", "is_valid").orderBy(F.coalesce("frame_timestamp_seconds", "requested_timestamp_seconds"), "candidate_id")
    d0, e0 = F.first("content_density_score").over(w), F.first(z("edge_density")).over(w)
    x = x.withColumn("_d0", d0).withColumn("_e0", e0)
    gain = clamp01((F.col("content_density_score") - F.col("_d0")) / F.greatest(F.lit(0.10), 1.0 - F.col("_d0")))
    edge = clamp01((z("edge_density") - F.col("_e0")) / F.greatest(F.lit(0.02), 1.0 - F.col("_e0")))
    x = x.withColumn("relative_content_gain", F.when(F.col("is_valid"), gain).otherwise(0.0)).withColumn("content_accumulation_score", F.when(F.col("is_valid"), weighted([("relative_content_gain", 0.65), (edge, 0.35)])).otherwise(0.0))
    terms = (F.when(F.col("source_type") == "BOUNDARY", F.col("boundary_score")).otherwise(0.15), "local_stability_score", "preceding_activity_strength", "content_accumulation_score", "content_density_score", "positional_completeness_score", "visual_quality_score", "transition_safety_score")
    x = x.withColumn("completeness_heuristic_score", weighted(list(zip(terms, p.completeness_weights, strict=True))))
    why = reasons((~good, "INVALID_FRAME"), (good & F.col("is_black"), "BLACK_FRAME"))
    return x.withColumn("heuristic_reasons", why).withColumn("is_scored", F.col("is_valid") & (F.size("heuristic_reasons") == 0)).drop("_mean", "_max", "_d0", "_e0", "enter_stable_threshold", "exit_stable_threshold", "major_threshold")


def ranking_score(p: Params = DEFAULT) -> Column:
    names = ("visual_quality_score", "completeness_heuristic_score", "transition_safety_score", "local_stability_score", "boundary_score", "content_density_score", "content_accumulation_score")
    base = weighted(list(zip(names, p.rank_weights, strict=True)))
    return clamp01(base + by_name(F.col("candidate_type"), TYPE_PRIOR) + F.when(F.col("source_type") == "BOUNDARY", SOURCE_PRIOR).otherwise(0.0))


def _level(c: Column, eps: float) -> Column:
    return F.round(c / F.lit(eps))


def rank(candidates: DataFrame, p: Params = DEFAULT, exact: bool = False) -> DataFrame:
    """Scored candidates ranked in their window, with roles.

    Ties within ``tie_epsilon`` go to safety, quality, completeness, local stability, place, time, id.  By default scores
    are compared in steps of the epsilon, which is an order; ``exact`` compares pairs by distance, as a comparator does,
    in Python within each window (a window has at most ``max_per_window`` candidates).
    """
    x = candidates.where(F.col("is_scored") & F.col("frame_timestamp_seconds").isNotNull()).withColumn("ranking_score", ranking_score(p))
    e = p.tie_epsilon
    desc = ("ranking_score", "transition_safety_score", "visual_quality_score", "completeness_heuristic_score", "local_stability_score")
    if exact:
        cols = ["job_id", "stable_window_id", "candidate_id", *desc, "relative_position", "frame_timestamp_seconds"]

        def order(rows: pd.DataFrame) -> pd.DataFrame:
            def compare(a, b) -> int:
                for c in desc:
                    if abs(a[c] - b[c]) > e:
                        return -1 if a[c] > b[c] else 1
                for u, v in ((abs(a["relative_position"] - 0.65), abs(b["relative_position"] - 0.65)), (a["frame_timestamp_seconds"], b["frame_timestamp_seconds"])):
                    if abs(u - v) > e:
                        return -1 if u < v else 1
                return (a["candidate_id"] > b["candidate_id"]) - (a["candidate_id"] < b["candidate_id"])

            got = sorted(rows.sort_values("candidate_id").to_dict("records"), key=cmp_to_key(compare))
            return pd.DataFrame([(r["job_id"], r["stable_window_id"], r["candidate_id"], i) for i, r in enumerate(got, 1)], columns=["job_id", "stable_window_id", "candidate_id", "rank_within_window"])

        placed = x.select(*cols).groupBy("job_id", "stable_window_id").applyInPandas(order, "job_id string, stable_window_id bigint, candidate_id bigint, rank_within_window bigint")
        x = x.join(placed, ["job_id", "stable_window_id", "candidate_id"])
    else:
        keys = [_level(F.col(c), e).desc() for c in desc] + [_level(F.abs(F.col("relative_position") - 0.65), e), _level(F.col("frame_timestamp_seconds"), e), F.col("candidate_id")]
        x = x.withColumn("rank_within_window", F.row_number().over(Window.partitionBy("job_id", "stable_window_id").orderBy(*keys)).cast("bigint"))
    w = Window.partitionBy("job_id", "stable_window_id")
    best = F.max(F.when(F.col("rank_within_window") == 1, F.col("ranking_score"))).over(w)
    r = F.col("rank_within_window")
    role = F.when(best < p.min_primary_score, "NONE").when(r == 1, "PRIMARY").when((r <= p.top_per_window) & (F.col("ranking_score") >= p.min_alternate_score), "ALTERNATE").otherwise("NONE")
    gap = F.when(best >= p.min_primary_score, clamp01(best - F.col("ranking_score"))).otherwise(0.0)
    return x.withColumn("selection_role", role).withColumn("score_gap_from_best", gap)


def selections(windows: DataFrame, candidates: DataFrame, ranked: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A row for every valid window: its choice, how clear it is, and why there is none if there is none."""
    r = F.col("rank_within_window")
    one = ranked.groupBy("job_id", "stable_window_id").agg(
        F.count("*").alias("valid_candidate_count"), F.max(F.when(r == 1, F.col("boundary_id"))).alias("boundary_id"), F.max(F.when(F.col("selection_role") == "PRIMARY", F.col("candidate_id"))).alias("primary_candidate_id"),
        F.max(F.when(r == 1, F.col("ranking_score"))).alias("_s1"), F.max(F.when(r == 2, F.col("ranking_score"))).alias("_s2"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("selection_role") == "ALTERNATE", F.struct(r.alias("r"), "candidate_id")))), lambda s: s["candidate_id"]).alias("alternate_candidate_ids"),
    )
    all_ = candidates.groupBy("job_id", "stable_window_id").agg(F.count("*").alias("candidate_count"))
    x = windows.where("is_valid").select("job_id", F.col("window_id").alias("stable_window_id")).join(all_, ["job_id", "stable_window_id"], "left").join(one, ["job_id", "stable_window_id"], "left")
    has = F.col("primary_candidate_id").isNotNull()
    s1, s2 = F.when(has, F.col("_s1")).otherwise(0.0), F.when(has, F.col("_s2"))
    gap = F.when(has & s2.isNotNull(), clamp01(s1 - s2)).when(has, s1).otherwise(0.0)
    x = x.withColumns({"primary_score": s1, "second_best_score": s2, "score_gap": gap, "candidate_count": F.coalesce("candidate_count", F.lit(0)), "valid_candidate_count": F.coalesce("valid_candidate_count", F.lit(0)), "alternate_candidate_ids": F.coalesce("alternate_candidate_ids", F.array().cast("array<bigint>"))})
    return x.withColumns({
        "is_ambiguous": has & F.col("second_best_score").isNotNull() & (F.col("score_gap") <= p.ambiguous_gap),
        "clear_winner": has & (F.col("primary_score") >= 0.60) & (F.col("second_best_score").isNull() | (F.col("score_gap") > p.ambiguous_gap * 2.0)),
        "selection_confidence": F.when(has, weighted([("primary_score", 0.70), (clamp01(F.col("score_gap") / max(p.ambiguous_gap * 4.0, 1e-6)), 0.30)])).otherwise(0.0),
        "failure_reason": F.when(~has & (F.col("valid_candidate_count") == 0), "NO_VALID_CANDIDATES").when(~has, "ALL_CANDIDATES_BELOW_MINIMUM"),
    }).drop("_s1", "_s2")


def ranking_stats(selected: DataFrame, ranked: DataFrame) -> DataFrame:
    one = selected.groupBy("job_id").agg(F.count("*").alias("windows_considered"), F.count("primary_candidate_id").alias("windows_with_primary"), F.sum(F.size("alternate_candidate_ids")).alias("alternate_candidates"), F.count_if("is_ambiguous").alias("ambiguous_windows"), F.count_if("clear_winner").alias("clear_winner_windows"), F.avg(F.when(F.col("primary_candidate_id").isNotNull(), F.col("score_gap"))).alias("mean_score_gap"))
    two = ranked.groupBy("job_id").agg(F.avg("ranking_score").alias("mean_ranking_score"), F.percentile("ranking_score", F.lit(0.5)).alias("median_ranking_score"), F.percentile("ranking_score", F.lit(0.9)).alias("p90_ranking_score"))
    z = {c: zero_if_null(c) for c in ("mean_score_gap", "mean_ranking_score", "median_ranking_score", "p90_ranking_score")}
    return one.join(two, "job_id", "left").withColumns(z).withColumn("ambiguity_ratio", F.col("ambiguous_windows") / F.col("windows_considered"))


def handoff(selected: DataFrame, ranked: DataFrame, alternates: bool = True) -> DataFrame:
    """Selected candidates with what they need further on, primaries and (if asked for) alternates."""
    r = ranked.where(F.col("selection_role").isin("PRIMARY", "ALTERNATE") if alternates else F.col("selection_role") == "PRIMARY")
    s = selected.select("job_id", "stable_window_id", "selection_confidence", "is_ambiguous")
    return r.join(s, ["job_id", "stable_window_id"]).withColumn("timestamp_seconds", F.col("frame_timestamp_seconds"))


def missing(ids: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Ids that have no row: what a handoff refuses."""
    return ids.join(rows.select(*key).distinct(), key, "left_anti")
