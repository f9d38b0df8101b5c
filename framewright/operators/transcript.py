"""Transcripts: chunks, de-duplication and merging, speech coverage, alignment to moments, and context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import reasons, round_even
from framewright.functions.text import similarity
from framewright.operators.ranges import points_in
from framewright.params import DEFAULT, Params


def chunk_plan(jobs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Chunks of each job's ``duration_seconds``: logical ranges side by side, decoded with some overlap."""
    size, d = p.chunk_seconds, F.col("duration_seconds")
    x = jobs.where(d > 1e-9).withColumn("chunk_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), F.ceil((d - 1e-9) / size)).cast("bigint"))))
    lo = (F.col("chunk_id") - 1) * F.lit(size)
    hi = F.least(d, lo + size)
    r = lambda c: round_even(c, 6)
    return x.select(
        "job_id", "chunk_id", r(lo).alias("logical_start_seconds"), r(hi).alias("logical_end_seconds"), r(F.greatest(F.lit(0.0), lo - p.chunk_overlap)).alias("decode_start_seconds"), r(F.least(d, hi + p.chunk_overlap)).alias("decode_end_seconds"), r(hi - lo).alias("chunk_seconds"), (hi == d).alias("is_last"),
    )


def chunk_counts(chunks: DataFrame, moments: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Moments in each chunk: half open, the last one closed."""
    t = F.col("timestamp_seconds")
    inside = (t >= F.col("logical_start_seconds")) & ((t < F.col("logical_end_seconds")) | (F.col("is_last") & (t <= F.col("logical_end_seconds"))))
    met = points_in(moments.select("job_id", "timestamp_seconds"), chunks, "job_id", "timestamp_seconds", F.col("logical_start_seconds"), F.col("logical_end_seconds"), p.chunk_seconds, inside)
    n = met.groupBy("job_id", "chunk_id").agg(F.count("*").alias("candidate_count"))
    return chunks.join(n, ["job_id", "chunk_id"], "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))


def audio_diagnostics(windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Loudness, silence, clipping and offset of each job from its windows (n, sum, sum_sq, peak, clipped)."""
    rms = F.sqrt(F.try_divide(F.col("sum_sq"), F.col("n")))
    x = windows.withColumn("rms", F.coalesce(rms, F.lit(0.0))).groupBy("job_id").agg(F.sum("n").alias("n"), F.sum("sum").alias("s"), F.sum("sum_sq").alias("q"), F.percentile("rms", F.lit(0.5)).alias("median_rms"), F.max("peak").alias("peak_amplitude"), F.sum("clipped").alias("c"), F.avg((F.col("rms") <= p.silence_rms).cast("double")).alias("silent_window_ratio"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    x = x.select("job_id", F.least(F.lit(1.0), z(F.sqrt(F.try_divide("q", "n")))).alias("mean_rms"), F.least(F.lit(1.0), "median_rms").alias("median_rms"), F.least(F.lit(1.0), "peak_amplitude").alias("peak_amplitude"), "silent_window_ratio", z(F.try_divide("c", "n")).alias("clipping_ratio"), z(F.try_divide("s", "n")).alias("dc_offset"))
    silent = F.col("silent_window_ratio") >= p.silent_ratio
    return x.withColumn("effectively_silent", silent).withColumn("warnings", reasons((silent, "EFFECTIVELY_SILENT"), (F.col("clipping_ratio") > p.high_clipping_ratio, "HIGH_CLIPPING")))


def normalize(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """De-duplicated, split and merged segments of each job.

    Each step depends on what the steps before made of the segments so far, so a job is one Python group; a job is one
    recording and has bounded length.  ``words`` (word, start_seconds, end_seconds) may be a column; without it overlong
    segments are kept whole.
    """
    cols = ["job_id", "segment_id", "chunk_id", "source_ordinal", "absolute_start_seconds", "absolute_end_seconds", "text", "avg_logprob", "no_speech_prob", "is_within_logical_range"]
    schema = "job_id string, segment_id bigint, start_seconds double, end_seconds double, text string, source_segment_ids array<string>, source_chunk_ids array<bigint>, word_count bigint, avg_logprob double, no_speech_prob double, normalization_flags array<string>"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        order = ["absolute_start_seconds", "absolute_end_seconds", "chunk_id", "source_ordinal"]
        got = merge_segments(drop_repeats(rows.sort_values(order).to_dict("records"), p), p)
        return pd.DataFrame(
            [(rows["job_id"].iloc[0], i, max(0.0, s["start"]), max(s["start"], s["end"]), s["text"], s["ids"], s["chunks"], len(s["text"].split()), s["logprob"], s["silence"], sorted(s["flags"])) for i, s in enumerate(got, 1)],
            columns=[c.split()[0] for c in schema.split(", ")],
        )

    return raw.select(*cols, *[c for c in ("words",) if c in raw.columns]).groupBy("job_id").applyInPandas(one, schema)


def _number(x):
    return None if x is None or x != x else float(x)


def drop_repeats(rows: list[dict], p: Params = DEFAULT) -> list[dict]:
    """Segments in time order; one that repeats an earlier, overlapping one is folded into the better of the two."""

    def better(r) -> tuple:
        silence, log = _number(r["no_speech_prob"]), _number(r["avg_logprob"])
        return (bool(r["is_within_logical_range"]), -(1.0 if silence is None else silence), -999.0 if log is None else log, len(" ".join(r["text"].split())))

    def repeats(a, b) -> bool:
        a0, a1, b0, b1 = a["absolute_start_seconds"], a["absolute_end_seconds"], b["absolute_start_seconds"], b["absolute_end_seconds"]
        if a1 < b0 - p.transcript_tolerance or b1 < a0 - p.transcript_tolerance:
            return False
        shorter = min(max(0.001, a1 - a0), max(0.001, b1 - b0))
        return max(0.0, min(a1, b1) - max(a0, b0)) / shorter >= 0.25 and similarity(a["text"], b["text"]) >= p.duplicate_similarity

    kept: list[dict] = []
    for r in rows:
        text = " ".join((r["text"] or "").split())
        if not text:
            continue
        item = {"raw": r, "start": r["absolute_start_seconds"], "end": r["absolute_end_seconds"], "text": text, "ids": [r["segment_id"]], "chunks": [int(r["chunk_id"])], "logprob": _number(r["avg_logprob"]), "silence": _number(r["no_speech_prob"]), "words": [dict(w) for w in (r["words"] if r.get("words") is not None else [])], "flags": {"TRIMMED_WHITESPACE"} if text != r["text"] else set()}
        twin = None
        for k in range(len(kept) - 1, -1, -1):
            if r["absolute_start_seconds"] - kept[k]["raw"]["absolute_end_seconds"] > p.transcript_tolerance:
                break
            if repeats(kept[k]["raw"], r):
                twin = k
                break
        if twin is None:
            kept.append(item)
            continue
        win, lose = (item, kept[twin]) if better(r) > better(kept[twin]["raw"]) else (kept[twin], item)
        win["ids"] = list(dict.fromkeys(win["ids"] + lose["ids"]))
        win["chunks"] = list(dict.fromkeys(win["chunks"] + lose["chunks"]))
        win["flags"].add("DEDUPLICATED_OVERLAP")
        kept[twin] = win
    return kept


def split_long(s: dict, p: Params = DEFAULT) -> list[dict]:
    """An overlong segment cut between words, as late as its bounds allow; one without words, or of one piece, is flagged."""
    if s["end"] - s["start"] <= p.max_segment_duration:
        return [s]
    parts: list[list[dict]] = []
    chars = 0
    for w in s.get("words") or []:
        if parts and w["end_seconds"] - parts[-1][0]["start_seconds"] <= p.max_segment_duration and chars + len(w["word"]) <= p.max_segment_characters:
            parts[-1].append(w)
        else:
            parts.append([w])
            chars = 0
        chars += len(w["word"])
    texts = [" ".join("".join(w["word"] for w in g).split()) for g in parts]
    if len(parts) < 2 or not any(texts):
        s["flags"].add("LONG_SEGMENT_PRESERVED")
        return [s]
    return [{**s, "start": g[0]["start_seconds"], "end": g[-1]["end_seconds"], "text": t, "words": g, "flags": set(s["flags"])} for g, t in zip(parts, texts, strict=True) if t]


def merge_segments(items: list[dict], p: Params = DEFAULT) -> list[dict]:
    """Overlong segments split, then neighbours joined while the gap, the joint duration and the joint text stay within bounds."""
    out: list[dict] = []
    for s in sorted((part for s in items for part in split_long(s, p)), key=lambda s: (s["start"], s["end"], s["ids"])):
        if out:
            last = out[-1]
            text = f"{last['text']} {s['text']}"
            if -0.05 <= s["start"] - last["end"] <= p.merge_max_gap and max(last["end"], s["end"]) - last["start"] <= p.max_segment_duration and len(text) <= p.max_segment_characters:
                last["end"], last["text"] = max(last["end"], s["end"]), text
                last["ids"], last["chunks"] = list(dict.fromkeys(last["ids"] + s["ids"])), list(dict.fromkeys(last["chunks"] + s["chunks"]))
                for k in ("logprob", "silence"):
                    both = [x for x in (last[k], s[k]) if x is not None]
                    last[k] = sum(both) / len(both) if both else None
                last["flags"] |= s["flags"] | {"MERGED_ADJACENT"}
                continue
        out.append(s)
    return out


def speech_stats(segments: DataFrame) -> DataFrame:
    """First and last speech, length of the union of all segments, and the gaps between them."""
    w = Window.partitionBy("job_id").orderBy("start_seconds", "end_seconds")
    reach = F.max("end_seconds").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = segments.withColumn("_reach", reach).withColumn("_fresh", F.greatest(F.lit(0.0), F.col("end_seconds") - F.greatest(F.col("start_seconds"), F.coalesce("_reach", F.col("start_seconds")))))
    x = x.withColumn("_gap", F.when(F.lag("end_seconds").over(w).isNotNull(), F.greatest(F.lit(0.0), F.col("start_seconds") - F.lag("end_seconds").over(w))))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return x.groupBy("job_id").agg(F.count("*").alias("segments"), F.min("start_seconds").alias("speech_start_seconds"), F.max("end_seconds").alias("speech_end_seconds"), F.sum("_fresh").alias("speech_union_seconds"), z(F.avg("_gap")).alias("mean_gap_seconds"), z(F.percentile("_gap", F.lit(0.5))).alias("median_gap_seconds"), z(F.max("_gap")).alias("max_gap_seconds"))


def overlapping(moments: DataFrame, segments: DataFrame, p: Params = DEFAULT, width: float = 20.0) -> DataFrame:
    """Segments that each moment falls into (within epsilon): of the last eight that had begun, as an index scan would see."""
    t, e = F.col("timestamp_seconds"), p.alignment_epsilon
    s = segments.select("job_id", "segment_id", "start_seconds", "end_seconds", "avg_logprob", "no_speech_prob")
    begun = Window.partitionBy("job_id").orderBy("start_seconds", "segment_id")
    s = s.withColumn("_n", F.row_number().over(begun))
    met = points_in(moments, s, "job_id", "timestamp_seconds", F.col("start_seconds") - e, F.col("end_seconds") + e, width, (F.col("start_seconds") <= t + e) & (F.col("end_seconds") + e >= t))
    # how many had begun at each moment: one pass over both in time order
    m = moments.select("job_id", "candidate_id", "timestamp_seconds", (t + e).alias("_at"), F.lit(0).alias("_s"))
    both = m.unionByName(segments.select("job_id", F.col("start_seconds").alias("_at"), F.lit(1).alias("_s")), allowMissingColumns=True)
    seen = F.sum("_s").over(Window.partitionBy("job_id").orderBy("_at", F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begun_n = both.withColumn("_begun", seen).where("_s = 0").select("job_id", "candidate_id", "_begun")
    return met.join(begun_n, ["job_id", "candidate_id"]).where(F.col("_n") > F.col("_begun") - 8).drop("_n", "_begun")


def align(moments: DataFrame, segments: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """What is spoken at each moment: the segment there, those before and after, gaps, direction and nearness."""
    t, e = F.col("timestamp_seconds"), p.alignment_epsilon
    o = overlapping(moments, segments, p)
    middle = (F.col("start_seconds") + F.col("end_seconds")) / 2.0
    key = F.struct(F.abs(t - middle), F.coalesce("no_speech_prob", F.lit(1.0)), -F.coalesce("avg_logprob", F.lit(-999.0)), F.col("end_seconds") - F.col("start_seconds"), F.col("segment_id"))
    o = o.groupBy("job_id", "candidate_id").agg(F.array_sort(F.collect_set("segment_id")).alias("overlapping_segment_ids"), F.min_by(F.struct("segment_id", "start_seconds", "end_seconds"), key).alias("primary"))
    # last segment that ended before, first that starts after: as-of in one pass each over moments and segments
    seg = F.struct("end_seconds", "segment_id", "start_seconds")
    b = segments.select("job_id", F.col("end_seconds").alias("_at"), seg.alias("_v"), F.lit(0).alias("_m"))
    f = segments.select("job_id", F.col("start_seconds").alias("_at"), F.struct("start_seconds", "segment_id", "end_seconds").alias("_v"), F.lit(0).alias("_m"))
    m = lambda at: moments.select("job_id", "candidate_id", at.alias("_at"), F.lit(1).alias("_m"))
    run = Window.partitionBy("job_id")
    back = m(t - e).unionByName(b, allowMissingColumns=True).withColumn("before", F.last("_v", ignorenulls=True).over(run.orderBy(F.col("_at"), F.col("_m"), F.col("_v.segment_id")))).where("_m = 1").select("job_id", "candidate_id", "before")
    ahead = m(t + e).unionByName(f, allowMissingColumns=True).withColumn("after", F.last("_v", ignorenulls=True).over(run.orderBy(F.desc("_at"), F.col("_m"), F.desc("_v.segment_id")))).where("_m = 1").select("job_id", "candidate_id", "after")
    any_ = segments.groupBy("job_id").agg(F.lit(True).alias("_spoken"))
    x = moments.join(o, ["job_id", "candidate_id"], "left").join(back, ["job_id", "candidate_id"]).join(ahead, ["job_id", "candidate_id"]).join(any_, "job_id", "left")
    gap_b = F.when(F.col("before").isNotNull(), F.greatest(F.lit(0.0), t - F.col("before.end_seconds")))
    gap_a = F.when(F.col("after").isNotNull(), F.greatest(F.lit(0.0), F.col("after.start_seconds") - t))
    has = F.col("primary").isNotNull()
    x = x.withColumns({"previous_gap_seconds": gap_b, "next_gap_seconds": gap_a})
    a, b_ = F.col("next_gap_seconds"), F.col("previous_gap_seconds")
    kind = F.when(has, "OVERLAPPING_SPEECH").when(F.col("_spoken").isNull(), "NO_TRANSCRIPT").when(b_.isNull(), "BEFORE_FIRST_SPEECH").when(a.isNull(), "AFTER_LAST_SPEECH").otherwise("BETWEEN_SPEECH")
    near = F.when(has, 0.0).when(b_.isNull(), a).when(a.isNull(), b_).otherwise(F.least(a, b_))
    way = F.when(has, "OVERLAPPING").when(b_.isNull() & a.isNull(), "NONE").when(b_.isNull(), "AFTER").when(a.isNull(), "BEFORE").when(F.abs(a - b_) <= e, "EQUAL_DISTANCE").when(b_ < a, "BEFORE").otherwise("AFTER")
    d = F.col("primary.end_seconds") - F.col("primary.start_seconds")
    place = F.when(has, F.when(d <= 1e-9, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(t - F.col("primary.start_seconds"), d)))))
    return x.select(
        "job_id", "candidate_id", "timestamp_seconds", kind.alias("alignment_type"), F.coalesce("overlapping_segment_ids", F.array().cast("array<bigint>")).alias("overlapping_segment_ids"), F.col("primary.segment_id").alias("primary_segment_id"), F.col("before.segment_id").alias("previous_segment_id"), F.col("after.segment_id").alias("next_segment_id"),
        "previous_gap_seconds", "next_gap_seconds", near.alias("nearest_speech_gap_seconds"), way.alias("nearest_speech_direction"), F.coalesce(F.greatest(F.lit(0.0), 1.0 - near / p.proximity_saturation), F.lit(0.0)).alias("speech_proximity_score"), place.alias("segment_relative_position"),
    )


def context(moments: DataFrame, segments: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """What is said around each moment, within a budget of characters and words.

    What is said at the moment is always kept; then come the nearest before and after in turn, and one that would not fit
    is skipped, so a shorter one further off may still enter: a fold over the few segments around one moment.
    """
    t, s, e = F.col("timestamp_seconds"), F.col("start_seconds"), F.col("end_seconds")
    lo, hi = F.greatest(F.lit(0.0), t - p.context_before), t + p.context_after
    m = moments.withColumns({"_lo": lo, "_hi": hi})
    width = p.context_before + p.context_after
    seg = segments.select("job_id", "segment_id", "start_seconds", "end_seconds", "text")
    # intervals against intervals: both in buckets, and a pair counts in its first common bucket only
    bucket = lambda c: F.floor(c / width)
    ms = m.withColumn("_b0", bucket(F.col("_lo"))).withColumn("_b", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))))
    ss = seg.withColumn("_s0", bucket(s)).withColumn("_b", F.explode(F.sequence(bucket(s), F.greatest(bucket(s), bucket(e)))))
    met = ms.join(ss, ["job_id", "_b"]).where((F.col("_b") == F.greatest("_b0", "_s0")) & (e >= F.col("_lo")) & (s <= F.col("_hi")))
    part = F.when(e <= t, "before").when(s >= t, "after").otherwise("current")
    cut = F.when(part == "before", s < F.col("_lo") - p.context_extension).when(part == "after", e > F.col("_hi") + p.context_extension).otherwise(False)
    met = met.withColumn("part", part).withColumn("cut", cut)
    text = F.trim("text")
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    item = F.struct(F.row_number().over(Window.partitionBy("job_id", "candidate_id", "part", "cut").orderBy(F.when(F.col("part") == "before", -s).otherwise(s), F.when(F.col("part") == "before", -F.col("segment_id")).otherwise(F.col("segment_id")))).alias("k"), F.when(F.col("part") == "before", 0).otherwise(1).alias("side"), "segment_id", F.length(text).alias("c"), n_words.alias("w"))
    met = met.withColumn("item", item)
    g = met.groupBy("job_id", "candidate_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("part") == "current", F.col("item")))).alias("cur"), F.array_sort(F.collect_list(F.when((F.col("part") != "current") & ~F.col("cut"), F.col("item")))).alias("rest"),
        F.bool_or(F.col("cut") & (F.col("part") == "before")).alias("_tb"), F.bool_or(F.col("cut") & (F.col("part") == "after")).alias("_ta"),
    )
    start = F.struct(F.aggregate("cur", F.lit(0), lambda a, x: a + x["c"] + F.when(a > 0, 1).otherwise(0)).alias("c"), F.aggregate("cur", F.lit(0), lambda a, x: a + x["w"]).alias("w"), F.array().cast("array<bigint>").alias("ids"))
    over = (F.col("_start.c") > p.context_max_characters) | (F.col("_start.w") > p.context_max_words)
    fits = lambda a, x: (a["c"] + x["c"] + F.when(a["c"] > 0, 1).otherwise(0) <= p.context_max_characters) & (a["w"] + x["w"] <= p.context_max_words)
    take = lambda a, x: F.when(fits(a, x), F.struct((a["c"] + x["c"] + F.when(a["c"] > 0, 1).otherwise(0)).alias("c"), (a["w"] + x["w"]).alias("w"), F.concat(a["ids"], F.array(x["segment_id"])).alias("ids"))).otherwise(a)
    g = g.withColumn("_start", start).withColumn("_end", F.when(over, F.col("_start")).otherwise(F.aggregate("rest", F.col("_start"), take)))
    ids = lambda side: F.transform(F.filter("rest", lambda x: (x["side"] == side) & F.array_contains("_end.ids", x["segment_id"])), lambda x: x["segment_id"])
    every = lambda side: F.size(F.filter("rest", lambda x: x["side"] == side))
    g = g.withColumns({"current_segment_ids": F.transform("cur", lambda x: x["segment_id"]), "before_segment_ids": F.array_sort(ids(0)), "after_segment_ids": F.array_sort(ids(1)), "context_over_budget_due_to_current": over})
    g = g.withColumns({"truncated_before": F.col("_tb") | (F.size("before_segment_ids") < every(0)), "truncated_after": F.col("_ta") | (F.size("after_segment_ids") < every(1)), "characters": F.col("_end.c"), "words": F.col("_end.w")})
    none = F.array().cast("array<bigint>")
    out = moments.select("job_id", "candidate_id").join(g, ["job_id", "candidate_id"], "left")
    fill = {c: F.coalesce(F.col(c), none) for c in ("current_segment_ids", "before_segment_ids", "after_segment_ids")} | {c: F.coalesce(F.col(c), F.lit(False)) for c in ("truncated_before", "truncated_after", "context_over_budget_due_to_current")} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("characters", "words")}
    return out.withColumns(fill).withColumn("is_sparse_context", F.col("words") < p.context_sparse_words).drop("cur", "rest", "_tb", "_ta", "_start", "_end")


def nearest_words(aligned: DataFrame, words: DataFrame) -> DataFrame:
    """The word at or nearest to each moment, among those of the segment there and the ones before and after.

    ``words`` has job_id, segment_id, word, start_seconds and end_seconds; of equals the earliest, then the first by text.
    """
    near = F.array_distinct(F.array_compact(F.array("primary_segment_id", "previous_segment_id", "next_segment_id")))
    m = aligned.select("job_id", "candidate_id", "timestamp_seconds", F.explode(near).alias("segment_id"))
    t, s, e = F.col("timestamp_seconds"), F.col("start_seconds"), F.col("end_seconds")
    x = m.join(words, ["job_id", "segment_id"]).withColumn("gap", F.when((s <= t) & (t <= e), 0.0).otherwise(F.least(F.abs(t - s), F.abs(t - e))))
    best = F.min(F.struct("gap", "start_seconds", "end_seconds", "word"))
    return x.groupBy("job_id", "candidate_id").agg(best.alias("b")).select("job_id", "candidate_id", F.col("b.word").alias("nearest_word"), F.col("b.gap").alias("nearest_word_gap_seconds"), F.col("b.start_seconds").alias("nearest_word_start_seconds"), (F.col("b.gap") == 0).alias("candidate_overlaps_word"))


def windows_with_speech(windows: DataFrame, segments: DataFrame, width: float = 60.0) -> DataFrame:
    """Windows (job_id, window_id, start_seconds, end_seconds) with ``has_speech``: whether a segment touches them."""
    b = lambda c: F.floor(c / F.lit(width))
    w = windows.select("job_id", "window_id", F.col("start_seconds").alias("_w0"), F.col("end_seconds").alias("_w1"))
    w = w.withColumn("_b", F.explode(F.sequence(b(F.col("_w0")), F.greatest(b(F.col("_w0")), b(F.col("_w1"))))))
    s = segments.select("job_id", F.col("start_seconds").alias("_s0"), F.col("end_seconds").alias("_s1"))
    s = s.withColumn("_b", F.explode(F.sequence(b(F.col("_s0")), F.greatest(b(F.col("_s0")), b(F.col("_s1"))))))
    hit = w.join(s, ["job_id", "_b"]).where((F.col("_s1") >= F.col("_w0")) & (F.col("_s0") <= F.col("_w1"))).select("job_id", "window_id", F.lit(True).alias("_hit")).distinct()
    return windows.join(hit, ["job_id", "window_id"], "left").withColumn("has_speech", F.coalesce("_hit", F.lit(False))).drop("_hit")
