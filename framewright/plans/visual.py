"""Queries over frames: differences, change, timeline, stability, candidates."""

from __future__ import annotations

import atexit
from functools import cached_property

from pyspark.sql import functions as F

from framewright.functions.scalar import reasons
from framewright.operators import candidates, change, stability, timeline
from framewright.plans.adapters import EVENTS as P
from framewright.plans.adapters import differences, frames
from framewright.plans.oracle import chain, r6, rounded
from framewright.queries import register, show
from framewright.sources.tables import exists, keep, remove, stamp


class Visual:
    """The chain's tables over one folder, each made when it is first asked for.

    Later stages read earlier ones several times, so those are written as tables: else every stage would plan and run all
    stages before it again for each use.  ``over`` gives all queries of an application that read the same events the
    same tables; ``release`` removes them, at the latest when Python ends with the session still open.
    """

    _known: dict[tuple, Visual] = {}

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self.paths = spark, sf_dir, []

    @classmethod
    def over(cls, spark, sf_dir) -> Visual:
        key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, f"{sf_dir}/events.parquet"))
        v = cls._known.get(key)
        if v is None or not all(exists(spark, p) for p in v.paths):
            v = cls._known[key] = cls(spark, sf_dir)
        return v

    @classmethod
    def release(cls) -> None:
        """Remove the stage tables of sessions that are still open, and forget all."""
        for v in cls._known.values():
            if v.spark.sparkContext._jsc is not None:
                for p in v.paths:
                    remove(v.spark, p)
        cls._known.clear()

    def keep(self, df):
        return keep(df, self.paths)

    @cached_property
    def frames(self):
        return self.keep(frames(self.spark, self.sf_dir))

    @cached_property
    def pairs(self):
        return self.keep(differences(self.frames))

    @cached_property
    def thresholds(self):
        return self.keep(change.change_thresholds(self.pairs, P))

    @cached_property
    def events(self):
        return self.keep(change.change_events(self.pairs, self.thresholds, P))

    @cached_property
    def limits(self):
        scored = change.scored(self.pairs).groupBy("job_id").agg(F.count("*").alias("n"))
        return self.keep(timeline.timeline_thresholds(self.thresholds, scored, P))

    @cached_property
    def states(self):
        return timeline.pair_states(self.pairs, self.events, self.limits, P)

    @cached_property
    def segments(self):
        return self.keep(timeline.timeline_segments(self.states, P))

    @cached_property
    def windows(self):
        return self.keep(stability.stability_windows(self.segments, self.pairs, self.frames, self.events, self.limits, P))

    @cached_property
    def bounds(self):
        return self.keep(stability.boundaries(self.windows, self.pairs, self.limits, P))

    @cached_property
    def candidates(self):
        return self.keep(candidates.generate(self.windows, self.bounds, self.frames, P))

    @cached_property
    def scores(self):
        return self.keep(candidates.score(self.candidates, self.pairs, self.limits, P))

    @cached_property
    def ranked(self):
        return self.keep(candidates.rank(self.scores, P))

    @cached_property
    def selected(self):
        return self.keep(candidates.selections(self.windows, self.candidates, self.ranked, P))

    @cached_property
    def handoff(self):
        return candidates.handoff(self.selected, self.ranked)


atexit.register(Visual.release)


def add(name, build, columns, numbers, step):
    register(name, lambda spark, sf: show(build(Visual.over(spark, sf)), columns, numbers), rounded(columns, step, numbers))


add("frame_quality", lambda v: v.frames, "job_id, index, is_valid, is_black, is_very_dark, is_blurry, is_low_information", "timestamp_seconds, brightness, quality_score", "fr")
add("pair_differences", lambda v: v.pairs, "job_id, previous_frame_index, current_frame_index, previous_is_black, current_is_black, valid, reason", "delta_seconds, difference_score", "ds")
add("score_distribution", lambda v: change.score_distribution(v.pairs), "job_id, total_comparisons, valid_comparisons, invalid_comparisons", "mean_difference_score, max_difference_score, p50, p75, p90, p95, p99", "dist")
add("change_thresholds", lambda v: v.thresholds, "job_id", "median_score, mad, p90, p95, p99, major_threshold, very_major_threshold", "th")
EVENT = "timestamp_seconds, start_timestamp_seconds, end_timestamp_seconds, difference_score, threshold, robust_score, metric_agreement, confidence"
add("change_events", lambda v: v.events, "job_id, event_id, event_type, previous_frame_index, current_frame_index, members", EVENT, "evs")
add("event_stats", lambda v: change.event_stats(v.pairs, v.events), "job_id, total_comparisons, major_events, very_major_events, black_transitions, invalid_gaps", "average_seconds_between_major_changes, median_seconds_between_major_changes, event_ratio", "evst")
add("timeline_thresholds", lambda v: v.limits, "job_id", "enter_stable_threshold, exit_stable_threshold, major_threshold", "lim")
add("pair_states", lambda v: v.states, "job_id, current_frame_index, state", "current_timestamp_seconds", "sta")
SEG = "start_timestamp_seconds, end_timestamp_seconds, duration_seconds, mean_difference_score, median_difference_score, min_difference_score, max_difference_score, change_intensity"
add("activity_timeline", lambda v: v.segments, "job_id, segment_id, state, start_frame_index, end_frame_index, comparison_count", SEG, "seg")
add("timeline_stats", lambda v: timeline.timeline_stats(v.segments), "job_id, stable_segment_count, changing_segment_count, transition_segment_count, invalid_segment_count", "total_duration_seconds, stable_duration_seconds, changing_duration_seconds, transition_duration_seconds, invalid_duration_seconds, stable_ratio, changing_ratio, invalid_ratio", "segst")
add("stability_windows", lambda v: v.windows, "job_id, window_id, comparison_count, frame_count, previous_segment_state, next_segment_state, is_valid, rejection_reasons", "duration_seconds, mean_difference_score, difference_stddev, stability_score, quality_score, window_confidence, valid_frame_ratio, black_frame_ratio, average_sharpness, seconds_since_previous_major_transition, seconds_until_next_major_transition", "sw")
add("window_stats", lambda v: stability.window_stats(v.windows), "job_id, total_stable_segments, valid_windows, rejected_windows, rejected_too_short, rejected_black, rejected_invalid", "total_stable_seconds, valid_stable_seconds, mean_window_seconds, median_window_seconds, p90_window_seconds, mean_stability_score, median_stability_score", "swst")
add("boundaries", lambda v: v.bounds, "job_id, boundary_id, boundary_type, stable_window_id, last_changing_frame_index, is_valid, rejection_reasons", "timestamp_seconds, pre_mean, pre_max, post_mean, post_max, activity_drop_score, preceding_activity_score, preceding_changing_duration_seconds, boundary_score", "bo")
add("boundary_stats", lambda v: stability.boundary_stats(v.bounds), "job_id, total_boundaries, valid_boundaries, changing_to_stable, major_to_stable, black_to_stable, at_start", "mean_boundary_score, p90_boundary_score, mean_activity_drop", "bost")
add("candidate_positions", lambda v: candidates.requested_positions(v.windows, P).withColumn("request", F.col("request").cast("bigint")), "job_id, window_id, request, candidate_type", "requested_timestamp_seconds", "rq")
add("generated_candidates", lambda v: v.candidates, "job_id, candidate_id, stable_window_id, boundary_id, candidate_type, source_type, frame_index, is_valid, rejection_reasons", "requested_timestamp_seconds, frame_timestamp_seconds, relative_position, seconds_after_boundary, seconds_before_stable_exit, frame_quality_score", "ge")
add("generation_stats", lambda v: candidates.generation_stats(v.candidates), "job_id, candidates_generated, valid_candidates, rejected_candidates, windows, shifted_to_nearby_frame", "mean_candidates_per_window", "gest")
add("candidate_scores", lambda v: v.scores, "job_id, candidate_id", "visual_quality_score, content_density_score, local_stability_score, transition_risk_score, transition_safety_score, preceding_activity_strength, positional_completeness_score, relative_content_gain, content_accumulation_score, completeness_heuristic_score", "sc")
add("ranked_candidates", lambda v: v.ranked, "job_id, candidate_id, stable_window_id, rank_within_window, selection_role", "ranking_score, score_gap_from_best", "ra")
add("window_selections", lambda v: v.selected, "job_id, stable_window_id, candidate_count, valid_candidate_count, primary_candidate_id, alternate_candidate_ids, is_ambiguous, clear_winner, failure_reason", "primary_score, second_best_score, score_gap, selection_confidence", "se")
add("ranking_stats", lambda v: candidates.ranking_stats(v.selected, v.ranked), "job_id, windows_considered, windows_with_primary, alternate_candidates, ambiguous_windows, clear_winner_windows", "mean_score_gap, mean_ranking_score, median_ranking_score, p90_ranking_score, ambiguity_ratio", "sest")
add("candidate_handoff", lambda v: v.handoff, "job_id, candidate_id, stable_window_id, selection_role, is_ambiguous", "timestamp_seconds, ranking_score, selection_confidence", "ho")


# -- one wide row a job: the statistics of all stages ------------------------------------------------------------------------
SUMMARY = "major_events, very_major_events, black_transitions, invalid_gaps, stable_segment_count, changing_segment_count, valid_windows, rejected_windows, valid_boundaries, candidates_generated, valid_candidates, windows_with_primary, ambiguous_windows"


def job_summary(spark, sf):
    """Left joins of the stage statistics on job_id: jobs without rows of a stage have nulls there."""
    v = Visual.over(spark, sf)
    out = change.event_stats(v.pairs, v.events)
    for one in (timeline.timeline_stats(v.segments), stability.window_stats(v.windows), stability.boundary_stats(v.bounds), candidates.generation_stats(v.candidates), candidates.ranking_stats(v.selected, v.ranked)):
        out = out.join(one, "job_id", "left")
    return show(out, f"job_id, {SUMMARY}", "stable_ratio, mean_stability_score, mean_boundary_score, mean_ranking_score")


register("job_summary", job_summary, chain(f"select evst.job_id, {SUMMARY}, " + ", ".join(f"{r6(c)} as {c}" for c in ("stable_ratio", "mean_stability_score", "mean_boundary_score", "mean_ranking_score")) + " from evst left join segst using (job_id) left join swst using (job_id) left join bost using (job_id) left join gest using (job_id) left join sest using (job_id)"))


def timeline_quality(spark, sf):
    """Densities and warnings of each job's timeline."""
    v = Visual.over(spark, sf)
    x = change.event_stats(v.pairs, v.events).join(timeline.timeline_stats(v.segments), "job_id")
    major = F.col("major_events") + F.col("very_major_events")
    x = x.withColumn("major_per_minute", F.coalesce(F.try_divide(major * 60.0, F.col("total_duration_seconds")), F.lit(0.0)))
    return show(x.withColumn("warnings", reasons((F.col("event_ratio") > 0.30, "MANY_MAJOR_EVENTS"), (F.col("stable_ratio") == 0, "NO_STABLE_SEGMENT"), (F.col("invalid_ratio") > 0.5, "MOSTLY_INVALID"))), "job_id, warnings", "major_per_minute, event_ratio, stable_ratio")


register("timeline_quality", timeline_quality, chain(f"select job_id, list_filter([case when event_ratio > 0.30::double then 'MANY_MAJOR_EVENTS' end, case when stable_ratio = 0 then 'NO_STABLE_SEGMENT' end, case when invalid_ratio > 0.5::double then 'MOSTLY_INVALID' end], lambda x: x is not null) as warnings, {r6('coalesce((major_events + very_major_events) * 60.0::double / nullif(total_duration_seconds, 0), 0)')} as major_per_minute, {r6('event_ratio')} as event_ratio, {r6('stable_ratio')} as stable_ratio from evst join segst using (job_id)"))
