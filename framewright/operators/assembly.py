"""Assembly of stage tables with integrity checks: raw speech to the lecture's clock, model inputs, handoffs, page plans.

A row that breaks a rule does not stop other jobs: every function gives the good rows and, in a second table, the bad ones
with the code of the first rule that they break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import json_fingerprint


def first_fault(*rules: tuple[Column, str]) -> Column:
    """The code of the first condition that holds, or null."""
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def parted(rows: DataFrame, fault: Column, key: list[str]) -> tuple[DataFrame, DataFrame]:
    x = rows.withColumn("_fault", fault)
    return x.where(F.col("_fault").isNull()).drop("_fault"), x.where(F.col("_fault").isNotNull()).select(*key, F.col("_fault").alias("code"))


def absolute_segments(raw: DataFrame, chunks: DataFrame, durations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of chunks on the lecture's clock, in one table for all chunks; and those with impossible times.

    ``raw``: job_id, chunk_id, source_ordinal, start_seconds, end_seconds, text, words (array of word, start, end,
    probability); ``chunks``: the plan; ``durations``: job_id, duration_seconds.  Texts that are empty after trimming go.
    """
    x = raw.withColumn("text", F.trim("text")).where(F.length("text") > 0).join(chunks, ["job_id", "chunk_id"]).join(durations, "job_id")
    base, total, room = F.col("decode_start_seconds"), F.col("duration_seconds"), F.col("decode_end_seconds") - F.col("decode_start_seconds")
    x = x.withColumn("_s", F.greatest(F.lit(0.0), F.coalesce("start_seconds", F.lit(0.0))))
    x = x.withColumn("_e", F.greatest("_s", F.coalesce("end_seconds", "_s")))
    late = base + F.least(F.col("_e"), room)
    fault = first_fault((F.col("_e") > room + 0.25, "CHUNK_TIMESTAMP_INVALID"), (late > total + 0.25, "TIMESTAMP_OUTSIDE_LECTURE"))
    end = F.when(late > total + 0.1, F.least(late, total)).otherwise(late)
    x = x.withColumns({"local_start_seconds": F.col("_s"), "local_end_seconds": F.least(F.col("_e"), room), "absolute_start_seconds": F.least(base + F.col("_s"), total), "absolute_end_seconds": end})
    lo, hi = F.col("absolute_start_seconds"), F.col("absolute_end_seconds")
    inside = lambda t: F.greatest(lo, F.least(hi, base + F.greatest(F.lit(0.0), F.coalesce(t, F.lit(0.0)))))

    def word(w: Column) -> Column:
        return F.struct(w["word"].alias("word"), inside(w["start"]).alias("start_seconds"), F.greatest(inside(w["start"]), inside(w["end"])).alias("end_seconds"), w["probability"].alias("probability"))

    middle = (lo + hi) / 2.0
    good, bad = parted(x, fault, ["job_id", "chunk_id", "source_ordinal"])
    return good.select(
        "job_id", F.concat_ws(":", "chunk_id", "source_ordinal").alias("segment_id"), "chunk_id", "source_ordinal", "local_start_seconds", "local_end_seconds", "absolute_start_seconds", "absolute_end_seconds",
        "text", F.transform("words", word).alias("words"), ((F.col("logical_start_seconds") <= middle) & (middle <= F.col("logical_end_seconds"))).alias("is_within_logical_range"),
    ), bad


def model_inputs(handoff: DataFrame, contexts: DataFrame, ranked: DataFrame, windows: DataFrame, boundaries: DataFrame, frames: DataFrame, max_characters: int = 6000) -> tuple[DataFrame, DataFrame]:
    """Candidates joined to their context, rank, window, boundary and frame, with a fingerprint; and those whose references break.

    All joins are equal on job_id and an id, so one shuffle on job_id can serve them.
    """
    key = ["job_id", "candidate_id"]
    c = contexts.select(*key, F.col("selection_role").alias("c_role"), F.col("timestamp_seconds").alias("c_time"), "context_characters")
    r = ranked.select(*key, "ranking_score")
    w = windows.select("job_id", F.col("window_id").alias("stable_window_id"), F.col("start_seconds").alias("w_start"), F.col("duration_seconds").alias("w_duration"))
    b = boundaries.select("job_id", "boundary_id", F.col("timestamp_seconds").alias("b_time"), "boundary_score", "boundary_type")
    f = frames.select("job_id", F.col("index").alias("frame_index"), "quality_score", "is_valid", "is_black", "processed_path")
    h = handoff.select(*key, "stable_window_id", "boundary_id", "frame_index", "timestamp_seconds", "selection_role", "is_ambiguous")
    x = h.join(h.groupBy(*key).agg(F.count("*").alias("_n")), key)
    x = x.join(c, key, "left").join(r, key, "left").join(w, ["job_id", "stable_window_id"], "left").join(b, ["job_id", "boundary_id"], "left").join(f, ["job_id", "frame_index"], "left")
    mismatch = F.col("c_role").isNull() | F.col("ranking_score").isNull() | F.col("w_start").isNull() | (F.col("c_role") != F.col("selection_role")) | (F.col("c_time") != F.col("timestamp_seconds"))
    fault = first_fault(
        (F.col("_n") > 1, "DUPLICATE_CANDIDATE"), (mismatch, "REFERENCE_MISMATCH"), (F.col("context_characters") > max_characters, "CONTEXT_TOO_LONG"),
        (F.col("is_valid").isNull() | ~F.col("is_valid") | F.col("is_black"), "INVALID_FRAME"),
    )
    good, bad = parted(x, fault, key)
    place = F.when(F.col("w_duration") > 0, (F.col("timestamp_seconds") - F.col("w_start")) / F.col("w_duration")).otherwise(0.0)
    good = good.select(
        *key, "stable_window_id", "boundary_id", "frame_index", "timestamp_seconds", "selection_role", "is_ambiguous", "ranking_score", "quality_score", "processed_path", "context_characters", "boundary_type", "boundary_score",
        (F.col("timestamp_seconds") - F.col("b_time")).alias("seconds_after_boundary"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)).alias("window_relative_position"), (F.col("context_characters") > 0).alias("has_transcript_context"),
    )
    return good.withColumn("semantic_input_fingerprint", json_fingerprint(F.to_json(F.struct(*good.columns)))), bad.distinct()


def selected_handoff(selected: DataFrame, inputs: DataFrame, results: DataFrame, decisions: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected candidates (job_id, candidate_id) with input, judgment, decision and window; and those that do not agree."""
    key = ["job_id", "candidate_id"]
    i = inputs.select(*key, "stable_window_id", "timestamp_seconds", "selection_role")
    j = results.select(*key, "completion_state", "educational_usefulness")
    d = decisions.select(*key, "semantic_decision_score")
    w = windows.select("job_id", "stable_window_id", "selected_candidate_id", F.col("decision").alias("window_decision"))
    x = selected.select(*key).join(i, key, "left").join(j, key, "left").join(d, key, "left").join(w, ["job_id", "stable_window_id"], "left")
    lost = F.col("stable_window_id").isNull() | F.col("completion_state").isNull() | F.col("semantic_decision_score").isNull()
    fault = first_fault((lost, "HANDOFF_REFERENCES_INCONSISTENT"), (F.col("selected_candidate_id").isNull() | (F.col("selected_candidate_id") != F.col("candidate_id")), "SELECTED_WINDOW_INCONSISTENT"))
    good, bad = parted(x, fault, key)
    return good.drop("selected_candidate_id"), bad


def plan_mismatches(layout: DataFrame, rendered: DataFrame, box: tuple[str, ...] = ("image_x", "image_y", "image_width", "image_height")) -> DataFrame:
    """Pages (job_id, page_number, code) that one side lacks, or that differ in candidate or place: a full outer join on the page."""
    key = ["job_id", "page_number"]
    side = lambda d, p: d.select(*key, F.struct("candidate_id", *box).alias(p))
    x = side(layout, "planned").join(side(rendered, "drawn"), key, "full")
    moved = reduce(lambda a, c: a | ~F.col(f"planned.{c}").eqNullSafe(F.col(f"drawn.{c}")), box, F.lit(False))
    code = first_fault(
        (F.col("planned").isNull() | F.col("drawn").isNull(), "PAGE_COUNT_DIFFERS"), (~F.col("planned.candidate_id").eqNullSafe(F.col("drawn.candidate_id")), "PAGE_IDENTITY_DIFFERS"), (moved, "GEOMETRY_RECALCULATED"),
    )
    return x.select(*key, code.alias("code")).where(F.col("code").isNotNull())


def extraction_plan(candidates: DataFrame, media: DataFrame, tolerance: float = 0.1, min_width: int = 320, min_height: int = 180) -> tuple[DataFrame, DataFrame]:
    """Where to take each candidate's frame: its time, not past the last moment; and those outside the video or too small."""
    x = candidates.join(media.select("job_id", "duration_seconds", "width", "height"), "job_id", "left")
    t, d = F.col("timestamp_seconds"), F.col("duration_seconds")
    fault = first_fault((d.isNull(), "MEDIA_MISSING"), ((t < 0) | (t > d + tolerance), "TIMESTAMP_OUTSIDE_VIDEO"), ((F.col("width") < min_width) | (F.col("height") < min_height), "RESOLUTION_TOO_SMALL"))
    good, bad = parted(x, fault, ["job_id", "candidate_id"])
    return good.withColumn("extract_at_seconds", F.bround(F.greatest(F.lit(0.0), F.least(t, d - 1e-6)), 6)), bad
