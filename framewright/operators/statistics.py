"""Statistics of the later stages: one row a job, from each stage's own table.

Every function is one aggregation by job_id.  Means, medians, percentiles and extremes of nothing are 0, as a job without
rows of a kind still has a row if it has any row at all; medians and percentiles are exact and interpolate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import ratio, reasons, zero_if_null


def n_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def mean(c: Column | str) -> Column:
    return zero_if_null(F.avg(c))


def quantile(c: Column | str, q: float) -> Column:
    return zero_if_null(F.percentile(c, F.lit(q)))


def largest(c: Column | str) -> Column:
    return F.coalesce(F.max(c), F.lit(0))


def by_value(column: str, values: dict[str, str]) -> list[Column]:
    """How often a column has each value, as columns of the given names."""
    return [n_if(F.col(column) == v).alias(name) for name, v in values.items()]


ROLES = {"primary": "PRIMARY", "alternate": "ALTERNATE"}
ALIGNMENTS = ("OVERLAPPING_SPEECH", "BETWEEN_SPEECH", "BEFORE_FIRST_SPEECH", "AFTER_LAST_SPEECH", "NO_TRANSCRIPT")


def alignment_stats(aligned: DataFrame) -> DataFrame:
    """Of aligned moments (selection_role, alignment_type, nearest_speech_gap_seconds, speech_proximity_score)."""
    gap = F.col("nearest_speech_gap_seconds")
    kinds = {f"{k.lower().removesuffix('_transcript')}_count": k for k in ALIGNMENTS}
    return aligned.groupBy("job_id").agg(
        F.count("*").alias("candidate_count"), *by_value("selection_role", {f"{k}_candidate_count": v for k, v in ROLES.items()}), *by_value("alignment_type", kinds),
        mean(gap).alias("mean_nearest_speech_gap_seconds"), quantile(gap, 0.5).alias("median_nearest_speech_gap_seconds"),
        quantile(gap, 0.9).alias("p90_nearest_speech_gap_seconds"), zero_if_null(F.max(gap)).alias("max_nearest_speech_gap_seconds"),
        mean("speech_proximity_score").alias("mean_speech_proximity_score"),
    )


def context_stats(contexts: DataFrame) -> DataFrame:
    """Of contexts (characters, words, truncated_before, truncated_after, is_sparse_context, current_segment_ids)."""
    spoken, before, after = F.col("words") > 0, F.col("truncated_before"), F.col("truncated_after")
    current = F.size("current_segment_ids") > 0
    return contexts.groupBy("job_id").agg(
        F.count("*").alias("context_count"), n_if(spoken).alias("contexts_with_speech"), n_if(~spoken).alias("contexts_without_speech"),
        n_if(F.col("is_sparse_context")).alias("sparse_context_count"), n_if(current).alias("contexts_with_current_speech"), n_if(~current).alias("contexts_without_current_speech"),
        n_if(before | after).alias("truncated_context_count"), n_if(before).alias("truncated_before_count"), n_if(after).alias("truncated_after_count"),
        mean("characters").alias("mean_context_characters"), quantile("characters", 0.5).alias("median_context_characters"),
        quantile("characters", 0.9).alias("p90_context_characters"), mean("words").alias("mean_context_words"),
    )


def input_stats(inputs: DataFrame) -> DataFrame:
    """Of model inputs (selection_role, has_transcript_context, is_ambiguous, stable_window_id, context_characters), with warnings."""
    spoken, unsure = F.col("has_transcript_context"), F.col("is_ambiguous")
    x = inputs.groupBy("job_id").agg(
        F.count("*").alias("input_count"), *by_value("selection_role", {f"{k}_input_count": v for k, v in ROLES.items()}),
        n_if(spoken).alias("inputs_with_transcript"), n_if(~spoken).alias("inputs_without_transcript"), n_if(unsure).alias("ambiguous_input_count"),
        F.countDistinct("stable_window_id").alias("unique_stable_window_count"),
        mean("context_characters").alias("mean_context_characters"), quantile("context_characters", 0.5).alias("median_context_characters"),
    )
    empty, doubtful = ratio("inputs_without_transcript", "input_count"), ratio("ambiguous_input_count", "input_count")
    return x.withColumn("warnings", reasons((empty >= 0.5, "HIGH_EMPTY_CONTEXT_RATIO"), (doubtful >= 0.8, "HIGH_AMBIGUOUS_CANDIDATE_RATIO")))


def temporal_context_stats(chosen: DataFrame) -> DataFrame:
    """Of candidates (job_id, candidate_id, previous_gap_seconds, next_gap_seconds; null without that neighbour)."""
    before, after = F.col("previous_gap_seconds"), F.col("next_gap_seconds")
    x = chosen.groupBy("job_id").agg(
        F.count("*").alias("context_count"), n_if(before.isNotNull() & after.isNotNull()).alias("triplet_count"),
        n_if(before.isNotNull() & after.isNull()).alias("previous_current_count"), n_if(before.isNull() & after.isNotNull()).alias("current_next_count"),
        n_if(before.isNull() & after.isNull()).alias("current_only_count"),
        mean(before).alias("mean_previous_gap_seconds"), mean(after).alias("mean_next_gap_seconds"),
        quantile(before, 0.5).alias("median_previous_gap_seconds"), quantile(after, 0.5).alias("median_next_gap_seconds"),
    )
    return x.withColumn("warnings", reasons((ratio("current_only_count", "context_count") >= 0.6, "HIGH_CURRENT_ONLY_RATIO")))


COMPLETIONS = ("COMPLETE", "MOSTLY_COMPLETE", "INCOMPLETE", "TRANSITION", "UNCERTAIN")


def analysis_stats(judged: DataFrame) -> DataFrame:
    """Of judgments (completion_state, null if it failed; confidence, inference_seconds, attempt_count, resolved_model, fallback_used)."""
    done, t = F.col("completion_state").isNotNull(), F.col("inference_seconds")
    sure = F.when(done, F.col("confidence"))
    x = judged.groupBy("job_id").agg(
        F.count("*").alias("candidate_count"), n_if(done).alias("successful_analysis_count"), n_if(~done).alias("failed_analysis_count"),
        *by_value("completion_state", {f"{k.lower()}_count": k for k in COMPLETIONS}),
        mean(sure).alias("mean_confidence"), quantile(sure, 0.5).alias("median_confidence"),
        mean(t).alias("mean_inference_seconds"), quantile(t, 0.5).alias("median_inference_seconds"), quantile(t, 0.9).alias("p90_inference_seconds"),
        zero_if_null(F.sum(t)).alias("total_inference_seconds"), F.sum(F.greatest(F.lit(0), F.col("attempt_count") - 1)).cast("bigint").alias("retry_count"),
        n_if((F.col("attempt_count") > 1) & done).alias("retry_success_count"), n_if(F.col("fallback_used")).alias("fallback_candidate_count"),
        F.countDistinct("resolved_model").alias("model_count"),
    )
    share = lambda c: ratio(c, "successful_analysis_count")
    some = F.col("successful_analysis_count") > 0
    return x.withColumn("warnings", reasons(
        (F.col("model_count") > 1, "MIXED_VLM_MODELS"), (some & (share("transition_count") >= 0.8), "POSSIBLE_TRANSITION_BIAS"),
        (some & (share("complete_count") >= 0.95), "POSSIBLE_COMPLETION_BIAS"),
    ))


REJECTIONS = ("INCOMPLETE", "TRANSITION", "LOW_VALUE", "LOW_CONFIDENCE")


def decision_stats(windows: DataFrame, decided: DataFrame) -> DataFrame:
    """Of window decisions, and of the candidates' own; a row for every job with windows."""
    w = windows.groupBy("job_id").agg(
        F.count("*").alias("window_count"), F.count("selected_candidate_id").alias("selected_window_count"), n_if(F.col("decision") == "REJECT_WINDOW").alias("rejected_window_count"),
        n_if(F.col("decision") == "SELECT_PRIMARY").alias("primary_selected_count"), n_if(F.col("decision") == "SELECT_ALTERNATE").alias("alternate_selected_count"),
        n_if(F.col("is_semantically_ambiguous")).alias("semantic_ambiguous_window_count"), F.count("alternate_candidate_id").alias("_with_alternates"),
    )
    kept = n_if(F.col("decision") == "KEEP")
    c = decided.groupBy("job_id").agg(kept.alias("candidate_keep_count"), (F.count("*") - kept).alias("candidate_reject_count"), *by_value("decision", {f"rejected_{k.lower()}_count": f"REJECT_{k}" for k in REJECTIONS}))
    score = windows.join(decided.select("job_id", F.col("candidate_id").alias("selected_candidate_id"), F.col("semantic_decision_score").alias("_s")), ["job_id", "selected_candidate_id"])
    score = score.groupBy("job_id").agg(F.avg("_s").alias("mean_selected_semantic_score"), F.percentile("_s", F.lit(0.5)).alias("median_selected_semantic_score"))
    x = w.join(c, "job_id", "left").join(score, "job_id", "left").na.fill(0.0, ["mean_selected_semantic_score", "median_selected_semantic_score"])
    lost, unsure = ratio("rejected_window_count", "window_count"), ratio("semantic_ambiguous_window_count", "window_count")
    return x.withColumn("alternate_switch_rate", ratio("alternate_selected_count", "_with_alternates")).drop("_with_alternates").withColumn("warnings", reasons(
        (lost >= 0.8, "HIGH_SEMANTIC_REJECTION_RATE"), (lost <= 0.02, "LOW_SEMANTIC_SELECTIVITY"), (unsure >= 0.5, "HIGH_SEMANTIC_AMBIGUITY_RATE"),
    ))


def extraction_stats(wanted: DataFrame, shots: DataFrame) -> DataFrame:
    """Of screenshots (candidate_id, width, height, file_size_bytes, requested_timestamp_seconds) against those wanted."""
    size = F.concat_ws("x", "width", "height")
    s = shots.groupBy("job_id").agg(
        F.count("*").alias("successful_extraction_count"), F.sum("file_size_bytes").alias("total_output_bytes"),
        *[f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))], F.array_sort(F.collect_set(size)).alias("unique_resolutions"),
        F.min("requested_timestamp_seconds").alias("first_selected_timestamp"), F.max("requested_timestamp_seconds").alias("last_selected_timestamp"),
    )
    x = wanted.groupBy("job_id").agg(F.count("*").alias("selected_candidate_count")).join(s, "job_id", "left").na.fill(0, ["successful_extraction_count", "total_output_bytes"])
    x = x.withColumn("failed_extraction_count", F.greatest(F.lit(0), F.col("selected_candidate_count") - F.col("successful_extraction_count")))
    return x.withColumn("warnings", reasons((F.coalesce(F.size("unique_resolutions"), F.lit(0)) > 1, "SOURCE_VIDEO_RESOLUTION_VARIATION")))


def quality_stats(chosen: DataFrame, high_fallback_ratio: float = 0.5) -> DataFrame:
    """Of quality searches (attempts, exact_quality_score, selected_quality_score, timestamp_shift_seconds, quality_state)."""
    shift, gain = F.abs("timestamp_shift_seconds"), F.col("selected_quality_score") - F.col("exact_quality_score")
    moved = shift > 1e-9
    x = chosen.groupBy("job_id").agg(
        F.count("*").alias("candidate_count"), n_if(F.col("attempts") == 1).alias("exact_accepted_count"), n_if(F.col("attempts") > 1).alias("fallback_search_count"),
        n_if(moved).alias("fallback_selected_count"), *by_value("quality_state", {"poor_remaining_count": "POOR", "invalid_count": "INVALID"}),
        mean(shift).alias("mean_absolute_timestamp_shift"), quantile(shift, 0.5).alias("median_absolute_timestamp_shift"), largest(shift).alias("max_absolute_timestamp_shift"),
        mean("exact_quality_score").alias("mean_exact_quality_score"), mean("selected_quality_score").alias("mean_selected_quality_score"),
        quantile("selected_quality_score", 0.5).alias("median_selected_quality_score"), mean(gain).alias("mean_quality_improvement"), largest(gain).alias("max_quality_improvement"),
    )
    return x.withColumn("warnings", reasons(
        (ratio("fallback_selected_count", "candidate_count") > high_fallback_ratio, "HIGH_SCREENSHOT_FALLBACK_RATE"), (F.col("poor_remaining_count") > 0, "POOR_FINAL_SCREENSHOT_QUALITY"),
    ))


def repeats(c: str) -> Column:
    """How many rows repeat a value that another row has: rows less different values."""
    return F.count(c) - F.countDistinct(c)


def fingerprint_stats(prints: DataFrame) -> DataFrame:
    """Of fingerprints (phash, dhash): how many repeat another."""
    x = prints.groupBy("job_id").agg(F.count("*").alias("fingerprint_count"), repeats("phash").alias("identical_phash_count"), repeats("dhash").alias("identical_dhash_count"))
    return x.withColumn("warnings", reasons((ratio("identical_phash_count", "fingerprint_count") > 0.5, "HIGH_IDENTICAL_PERCEPTUAL_HASH_RATE")))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Of compared pairs, by decision."""
    kinds = {"duplicate_pair_count": "DUPLICATE", "possible_duplicate_pair_count": "POSSIBLE_DUPLICATE", "distinct_pair_count": "DISTINCT"}
    return pairs.groupBy("job_id").agg(F.count("*").alias("comparison_pair_count"), *by_value("decision", kinds))


def group_stats(members: DataFrame, window: float, high_ratio: float = 0.7) -> DataFrame:
    """Of duplicate groups (job_id, group_id, timestamp_seconds), a row a member."""
    t = F.col("timestamp_seconds")
    g = members.groupBy("job_id", "group_id").agg(F.count("*").alias("size"), (F.max(t) - F.min(t)).alias("span"))
    span = F.when(F.col("size") > 1, F.col("span"))
    x = g.groupBy("job_id").agg(
        F.sum("size").alias("candidate_count"), F.count("*").alias("duplicate_group_count"), n_if(F.col("size") == 1).alias("singleton_group_count"),
        n_if(F.col("size") > 1).alias("multi_member_group_count"), mean("size").alias("mean_group_size"), F.max("size").alias("max_group_size"),
        mean(span).alias("mean_duplicate_group_time_span"), zero_if_null(F.max(span)).alias("max_duplicate_group_time_span"),
    )
    x = x.withColumn("potential_duplicate_removals", F.col("candidate_count") - F.col("duplicate_group_count"))
    x = x.withColumn("duplicate_ratio", ratio("potential_duplicate_removals", "candidate_count"))
    return x.withColumn("warnings", reasons(
        (F.col("duplicate_ratio") > high_ratio, "HIGH_DUPLICATE_RATIO"), (F.col("max_group_size") >= 6, "LARGE_DUPLICATE_GROUP"),
        (F.col("max_duplicate_group_time_span") > window * 2, "LONG_RANGE_DUPLICATE_GROUP"),
    ))


def final_stats(selected: DataFrame) -> DataFrame:
    """Of final decisions (group_id, decision, semantic_decision_score, quality_score, final_selection_score)."""
    won = F.col("decision") == "WINNER"
    only = lambda c: F.when(won, F.col(c))
    score = {"winner_semantic": "semantic_decision_score", "winner_quality": "quality_score", "final_selection": "final_selection_score"}
    x = selected.groupBy("job_id").agg(
        F.countDistinct("group_id").alias("duplicate_group_count"), F.count("*").alias("_all"), n_if(won).alias("final_screenshot_count"),
        n_if(F.col("decision") == "INELIGIBLE").alias("invalid_member_count"),
        *[f(only(c)).alias(f"{n}_{k}_score") for k, c in score.items() for n, f in (("mean", mean), ("median", lambda v: quantile(v, 0.5)))],
        quantile(only("final_selection_score"), 0.1).alias("p10_final_selection_score"),
    )
    x = x.withColumn("suppressed_duplicate_count", F.col("_all") - F.col("final_screenshot_count"))
    return x.withColumn("final_dedup_ratio", ratio("suppressed_duplicate_count", "_all")).drop("_all")


def raw_transcript_stats(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Of chunks (chunk_id, language, language_probability, empty_segment_count, audio_duration_seconds, wall_clock_seconds) and raw segments.

    The language is the one of most chunks (the smaller name of equals), its probability the mean over its chunks.
    """
    lang = chunks.where(F.col("language").isNotNull()).groupBy("job_id", "language").agg(F.count("*").alias("k"), F.avg("language_probability").alias("p"))
    first = F.max_by(F.struct("language", "p"), F.struct("k", F.translate("language", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")))
    lang = lang.groupBy("job_id").agg(first.alias("l")).select("job_id", "l.language", F.col("l.p").alias("language_probability"))
    spoken = F.greatest(F.lit(0.0), F.col("absolute_end_seconds") - F.col("absolute_start_seconds"))
    s = segments.groupBy("job_id").agg(F.count("*").alias("raw_segment_count"), F.sum("word_count").alias("word_count"), F.sum(spoken).alias("transcribed_speech_duration_seconds"))
    c = chunks.groupBy("job_id").agg(
        F.count("*").alias("chunk_count"), F.sum("empty_segment_count").alias("empty_segment_count"),
        F.max("audio_duration_seconds").alias("audio_duration_seconds"), F.sum(F.greatest(F.lit(0.0), F.col("wall_clock_seconds"))).alias("wall_clock_transcription_seconds"),
    )
    x = c.join(s, "job_id", "left").join(lang, "job_id", "left").na.fill(0, ["raw_segment_count", "word_count", "transcribed_speech_duration_seconds"])
    x = x.withColumn("real_time_factor", ratio("wall_clock_transcription_seconds", "audio_duration_seconds"))
    silent = F.col("raw_segment_count") == 0
    low = ~silent & (F.col("audio_duration_seconds") > 300) & (ratio("transcribed_speech_duration_seconds", "audio_duration_seconds") < 0.01)
    return x.withColumn("warnings", reasons((silent, "NO_SPEECH_DETECTED"), (low, "LOW_TRANSCRIPT_COVERAGE")))


def repetition_stats(runs: DataFrame, key: str, value: str, digits: int | None = 6) -> DataFrame:
    """Mean, median, least and most of repeated measurements, to ``digits`` decimals (None: as they are)."""
    to = (lambda c: c) if digits is None else (lambda c: F.bround(c, digits))
    return runs.groupBy(key).agg(
        F.count("*").alias("repetitions"), to(F.avg(value)).alias("mean"), to(F.percentile(value, F.lit(0.5))).alias("median"), to(F.min(value)).alias("least"), to(F.max(value)).alias("most")
    )


def example_times(events: DataFrame, n: int = 8) -> DataFrame:
    """The times of the first events of each job, which are numbered from 1 in time order: so many rows of a job at most."""
    first = events.where(F.col("event_id") <= n).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "timestamp_seconds"))).alias("e"))
    return first.select("job_id", F.col("e.timestamp_seconds").alias("example_event_timestamps"))


def report(parts: list[DataFrame]) -> DataFrame:
    """One wide row a job: the first table's jobs, with the statistics of the others joined to them; ``warnings`` are put together, each once."""
    names: list[str] = []
    out = None
    for k, p in enumerate(parts):
        if "warnings" in p.columns:
            names.append(f"_w{k}")
            p = p.withColumnRenamed("warnings", f"_w{k}")
        out = p if out is None else out.join(p, "job_id", "left")
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(*[F.coalesce(F.col(n), none) for n in names])) if names else none
    return out.withColumn("warnings", every).drop(*names)


def with_warnings(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """The rows with further warnings after those they have, each once."""
    return rows.withColumn("warnings", F.array_distinct(F.concat("warnings", reasons(*rules))))
