"""Queries over transcripts, and over judgments of the visual chain's candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions.text import word_count, words
from framewright.operators import neighbours, semantic, transcript
from framewright.params import DEFAULT
from framewright.plans.adapters import EVENTS, table
from framewright.plans.oracle import rounded, step
from framewright.plans.visual import Visual
from framewright.queries import register, show
from framewright.sources.tables import keep

P = DEFAULT
#: A minute a chunk: conversations are short.
CHUNKS = DEFAULT.__class__(chunk_seconds=60.0)


def segments(spark, sf_dir):
    """Conversations spoken at a steady pace: .4 s a word, .3 s between turns."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("job_id"), (F.col("turn") + 1).cast("bigint").alias("segment_id"), "text")
    w = Window.partitionBy("job_id").orderBy("segment_id")
    d = word_count(F.regexp_replace("text", "[ \t\n\r\f\x0b]+", " ")).cast("bigint")
    c = c.withColumn("word_count", d).withColumn("k", F.row_number().over(w))
    end = F.sum("word_count").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("end_seconds", end * F.lit(0.4) + (F.col("k") - 1) * F.lit(0.3))
    return c.select("job_id", "segment_id", (F.col("end_seconds") - F.col("word_count") * 0.4).alias("start_seconds"), "end_seconds", "text", "word_count", (F.col("segment_id") * -0.1).alias("avg_logprob"), F.lit(0.02).alias("no_speech_prob"))


def moments(segs):
    """A moment every seven seconds from second one."""
    d = segs.groupBy("job_id").agg(F.max("end_seconds").alias("duration_seconds"))
    n = F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_seconds") / 7).cast("int") + 1))
    return d.select("job_id", n.alias("n")).select("job_id", (F.col("n") + 1).cast("bigint").alias("candidate_id"), (F.col("n") * 7.0 + 1.0).alias("timestamp_seconds"))


def jobs(segs):
    return segs.groupBy("job_id").agg(F.max("end_seconds").alias("duration_seconds"))


def add(name, build, columns, numbers, source):
    register(name, lambda spark, sf: show(build(keep(segments(spark, sf))), columns, numbers), rounded(columns, source, numbers))


step("tw", """select cast(conv_id as varchar) as job_id, turn + 1 as segment_id, text, len(list_filter(string_split(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), lambda x: x <> '')) as word_count from conversations""")
step("ts", """select job_id, segment_id, text, word_count, e - word_count * 0.4::double as start_seconds, e as end_seconds, segment_id * -0.1::double as avg_logprob, 0.02::double as no_speech_prob from (
select *, sum(word_count) over (partition by job_id order by segment_id rows between unbounded preceding and current row) * 0.4::double + (row_number() over (partition by job_id order by segment_id) - 1) * 0.3::double as e from tw)""")
step("tj", "select job_id, max(end_seconds) as duration_seconds from ts group by job_id")
step("tm", "select job_id, n + 1 as candidate_id, n * 7.0::double + 1.0::double as timestamp_seconds from (select job_id, unnest(range(0, floor(duration_seconds / 7)::bigint + 2)) as n from tj)")
add("transcript_segments", lambda s: s, "job_id, segment_id, word_count", "start_seconds, end_seconds", "ts")
step("tg", """select job_id, count(*) as segments, min(start_seconds) as speech_start_seconds, max(end_seconds) as speech_end_seconds, sum(greatest(0.0::double, end_seconds - greatest(start_seconds, coalesce(r, start_seconds)))) as speech_union_seconds, coalesce(avg(g), 0) as mean_gap_seconds, coalesce(quantile_cont(g, 0.5), 0) as median_gap_seconds, coalesce(max(g), 0) as max_gap_seconds from (
select *, max(end_seconds) over (partition by job_id order by start_seconds, end_seconds rows between unbounded preceding and 1 preceding) as r, case when lag(end_seconds) over w is not null then greatest(0.0::double, start_seconds - lag(end_seconds) over w) end as g from ts window w as (partition by job_id order by start_seconds, end_seconds)) group by job_id""")
add("speech_stats", transcript.speech_stats, "job_id, segments", "speech_start_seconds, speech_end_seconds, speech_union_seconds, mean_gap_seconds, median_gap_seconds, max_gap_seconds", "tg")
_c = CHUNKS
step("ck", f"""select job_id, k as chunk_id, round((k - 1) * {_c.chunk_seconds}::double, 6) as logical_start_seconds, round(least(d, k * {_c.chunk_seconds}::double), 6) as logical_end_seconds, round(greatest(0.0::double, (k - 1) * {_c.chunk_seconds}::double - {_c.chunk_overlap}::double), 6) as decode_start_seconds,
  round(least(d, least(d, k * {_c.chunk_seconds}::double) + {_c.chunk_overlap}::double), 6) as decode_end_seconds, least(d, k * {_c.chunk_seconds}::double) = d as is_last from (select job_id, duration_seconds as d, unnest(range(1, greatest(1, ceil((duration_seconds - 1e-9::double) / {_c.chunk_seconds}::double)::bigint) + 1)) as k from tj where duration_seconds > 1e-9::double)""")
add("chunk_plan", lambda s: transcript.chunk_plan(jobs(s), CHUNKS), "job_id, chunk_id, is_last", "logical_start_seconds, logical_end_seconds, decode_start_seconds, decode_end_seconds", "ck")
step("cc", "select ck.job_id, chunk_id, count(timestamp_seconds) as candidate_count from ck left join tm on ck.job_id = tm.job_id and timestamp_seconds >= logical_start_seconds and (timestamp_seconds < logical_end_seconds or (is_last and timestamp_seconds <= logical_end_seconds)) group by 1, 2")
add("chunk_counts", lambda s: transcript.chunk_counts(transcript.chunk_plan(jobs(s), CHUNKS), moments(s), CHUNKS), "job_id, chunk_id, candidate_count", "", "cc")
_e = f"{P.alignment_epsilon}::double"
step("ov", f"""select * from (select tm.job_id, tm.candidate_id, tm.timestamp_seconds as t, s.*  exclude (job_id), row_number() over (partition by tm.job_id, tm.candidate_id order by start_seconds desc, segment_id desc) as back from tm join ts s on tm.job_id = s.job_id and start_seconds <= timestamp_seconds + {_e}) where back <= 8 and end_seconds + {_e} >= t""")
step("pr", "select * from (select *, row_number() over (partition by job_id, candidate_id order by abs(t - (start_seconds + end_seconds) / 2.0::double), no_speech_prob, -avg_logprob, end_seconds - start_seconds, segment_id) as k from ov) where k = 1")
step("al0", f"""
select tm.*, p.segment_id as ps, p.start_seconds as p0, p.end_seconds as p1, coalesce(l.ids, []::bigint[]) as overlapping_segment_ids,
  (select arg_max(segment_id, (end_seconds, segment_id)) from ts where ts.job_id = tm.job_id and end_seconds <= timestamp_seconds - {_e}) as previous_segment_id, (select max(end_seconds) from ts where ts.job_id = tm.job_id and end_seconds <= timestamp_seconds - {_e}) as pe,
  (select arg_min(segment_id, (start_seconds, segment_id)) from ts where ts.job_id = tm.job_id and start_seconds >= timestamp_seconds + {_e}) as next_segment_id, (select min(start_seconds) from ts where ts.job_id = tm.job_id and start_seconds >= timestamp_seconds + {_e}) as ns
from tm left join pr p on tm.job_id = p.job_id and tm.candidate_id = p.candidate_id left join (select job_id, candidate_id, list(segment_id order by segment_id) as ids from ov group by 1, 2) l on tm.job_id = l.job_id and tm.candidate_id = l.candidate_id""")
step("al1", "select *, case when pe is not null then greatest(0.0::double, timestamp_seconds - pe) end as previous_gap_seconds, case when ns is not null then greatest(0.0::double, ns - timestamp_seconds) end as next_gap_seconds from al0")
step("al", f"""
select *, ps as primary_segment_id, coalesce(greatest(0.0::double, 1.0::double - case when near is null then null else near end / {P.proximity_saturation}::double), 0) * case when near is null then 0 else 1 end as speech_proximity_score, near as nearest_speech_gap_seconds,
  case when ps is not null then case when p1 - p0 <= 1e-9::double then 0.5::double else greatest(0.0::double, least(1.0::double, (timestamp_seconds - p0) / (p1 - p0))) end end as segment_relative_position from (
select *, case when ps is not null then 'OVERLAPPING_SPEECH' when pe is null then 'BEFORE_FIRST_SPEECH' when ns is null then 'AFTER_LAST_SPEECH' else 'BETWEEN_SPEECH' end as alignment_type, case when ps is not null then 0.0::double when pe is null then next_gap_seconds when ns is null then previous_gap_seconds else least(previous_gap_seconds, next_gap_seconds) end as near,
  case when ps is not null then 'OVERLAPPING' when pe is null and ns is null then 'NONE' when pe is null then 'AFTER' when ns is null then 'BEFORE' when abs(next_gap_seconds - previous_gap_seconds) <= {_e} then 'EQUAL_DISTANCE' when previous_gap_seconds < next_gap_seconds then 'BEFORE' else 'AFTER' end as nearest_speech_direction from al1)""")
add("transcript_alignment", lambda s: transcript.align(moments(s), s, P), "job_id, candidate_id, alignment_type, overlapping_segment_ids, primary_segment_id, previous_segment_id, next_segment_id, nearest_speech_direction", "previous_gap_seconds, next_gap_seconds, nearest_speech_gap_seconds, speech_proximity_score, segment_relative_position", "al")


def spoken_words(s):
    """Each word of the steady pace."""
    w = s.select("job_id", "segment_id", "start_seconds", F.posexplode(words(F.regexp_replace("text", "[ \t\n\r\f\x0b]+", " "))).alias("k", "word"))
    return w.select("job_id", "segment_id", "word", (F.col("start_seconds") + F.col("k") * 0.4).alias("start_seconds"), (F.col("start_seconds") + (F.col("k") + 1) * 0.4).alias("end_seconds"))


step("sp", "select job_id, segment_id, word, start_seconds + k * 0.4::double as ws, start_seconds + (k + 1) * 0.4::double as we from (select job_id, segment_id, start_seconds, unnest(l) as word, generate_subscripts(l, 1) - 1 as k from (select *, list_filter(string_split(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), lambda x: x <> '') as l from ts))")
step("nw", "select job_id, candidate_id, word as nearest_word, g as nearest_word_gap_seconds, g = 0 as candidate_overlaps_word from (select a.job_id, a.candidate_id, word, case when ws <= timestamp_seconds and timestamp_seconds <= we then 0.0::double else least(abs(timestamp_seconds - ws), abs(timestamp_seconds - we)) end as g, row_number() over (partition by a.job_id, a.candidate_id order by case when ws <= timestamp_seconds and timestamp_seconds <= we then 0.0::double else least(abs(timestamp_seconds - ws), abs(timestamp_seconds - we)) end, ws, we, word) as k from al a join sp on sp.job_id = a.job_id and sp.segment_id in (primary_segment_id, previous_segment_id, next_segment_id)) where k = 1")
add("nearest_word", lambda s: transcript.nearest_words(transcript.align(moments(s), s, P), spoken_words(s)), "job_id, candidate_id, nearest_word, candidate_overlaps_word", "nearest_word_gap_seconds", "nw")
step("hw", "select job_id, window_id, exists(select 1 from ts where ts.job_id = w.job_id and ts.end_seconds >= w.a and ts.start_seconds <= w.b) as has_speech from (select job_id, candidate_id as window_id, timestamp_seconds as a, timestamp_seconds + 0.2::double as b from tm) w")
add("window_has_speech", lambda s: transcript.windows_with_speech(moments(s).select("job_id", F.col("candidate_id").alias("window_id"), F.col("timestamp_seconds").alias("start_seconds"), (F.col("timestamp_seconds") + 0.2).alias("end_seconds")), s), "job_id, window_id, has_speech", "", "hw")
register("context_budget", lambda spark, sf: (lambda s: transcript.context(moments(s), s, P))(keep(segments(spark, sf))))  # its SQL is a fold, in sequential.py


def _raw(s):
    """Every segment heard twice by overlapping chunks, the second time a little later and with other ends."""
    base = s.select("job_id", F.concat(F.lit("1:"), "segment_id").alias("segment_id"), F.lit(1).cast("bigint").alias("chunk_id"), F.col("segment_id").alias("source_ordinal"), F.col("start_seconds").alias("absolute_start_seconds"), F.col("end_seconds").alias("absolute_end_seconds"), "text", "avg_logprob", "no_speech_prob", F.lit(True).alias("is_within_logical_range"))
    twice = base.where(F.col("source_ordinal") % 2 == 0).withColumns({"segment_id": F.concat(F.lit("2:"), F.col("source_ordinal").cast("string")), "chunk_id": F.lit(2).cast("bigint"), "absolute_start_seconds": F.col("absolute_start_seconds") + 0.1, "is_within_logical_range": F.lit(False), "text": F.concat(F.col("text"), F.lit(" "))})
    return base.unionByName(twice)


register("transcript_normalized", lambda spark, sf: transcript.normalize(_raw(keep(segments(spark, sf))), P))


# -- judgments: made up from the ids of the visual chain's selected candidates --------------------------------------------
def judged(v: Visual):
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("candidate_id") * k % len(names) + 1).cast("int"))
    return v.handoff.select(
        "job_id", "candidate_id", "stable_window_id", "selection_role", "rank_within_window", "ranking_score", pick(list(semantic.COMPLETION), 1).alias("completion_state"), pick(list(semantic.USEFULNESS), 3).alias("educational_usefulness"), pick(list(semantic.SETTLED), 7).alias("visual_change_state"),
        pick(list(semantic.TRANSCRIPT), 2).alias("transcript_visual_consistency"), ((F.col("candidate_id") * 37 % 100) / 100.0).alias("confidence"), ((F.col("candidate_id") * 13 % 80) / 100.0).alias("transition_probability"), (F.col("candidate_id") % 11 != 0).alias("has_meaningful_visual_content"),
    )


_pick = lambda names, k: "[" + ", ".join(f"'{n}'" for n in names) + f"][(candidate_id * {k} % {len(names)} + 1)::int]"
_map = lambda c, m: f"case {c} " + " ".join(f"when '{k}' then {v}::double" for k, v in m.items()) + " end"
step("ju", f"""select job_id, candidate_id, stable_window_id, selection_role, rank_within_window, ranking_score, {_pick(semantic.COMPLETION, 1)} as cs, {_pick(semantic.USEFULNESS, 3)} as eu, {_pick(semantic.SETTLED, 7)} as vs, {_pick(semantic.TRANSCRIPT, 2)} as tc,
  (candidate_id * 37 % 100) / 100.0::double as confidence, (candidate_id * 13 % 80) / 100.0::double as tp, candidate_id % 11 <> 0 as meaningful from ho""")
_w = [x / sum(P.decision_weights) for x in P.decision_weights]
step("de0", f"""select *, least(1.0::double, greatest(0.0::double, 0.0::double + ({_map('cs', semantic.COMPLETION)}) * {_w[0]!r}::double + ({_map('eu', semantic.USEFULNESS)}) * {_w[1]!r}::double + ({_map('vs', semantic.SETTLED)}) * {_w[2]!r}::double + confidence * {_w[3]!r}::double + ({_map('tc', semantic.TRANSCRIPT)}) * {_w[4]!r}::double + ranking_score * {_w[5]!r}::double)) as semantic_decision_score from ju""")
step("de", f"""select *, decision = 'KEEP' as eligible from (select *, case when cs = 'TRANSITION' or tp >= {P.transition_reject}::double then 'REJECT_TRANSITION' when not meaningful or eu = 'NONE' then 'REJECT_LOW_VALUE' when cs = 'INCOMPLETE' then 'REJECT_INCOMPLETE' when confidence < {P.min_confidence}::double then 'REJECT_LOW_CONFIDENCE' when semantic_decision_score < {P.min_decision_score}::double then 'REJECT_LOW_VALUE' else 'KEEP' end as decision,
  case when cs = 'TRANSITION' or tp >= {P.transition_reject}::double then ['SEMANTIC_TRANSITION'] when not meaningful or eu = 'NONE' then ['SEMANTIC_LOW_USEFULNESS'] when cs = 'INCOMPLETE' then ['SEMANTIC_INCOMPLETE'] when confidence < {P.min_confidence}::double then ['SEMANTIC_LOW_CONFIDENCE'] when semantic_decision_score < {P.min_decision_score}::double then ['SEMANTIC_SCORE_BELOW_THRESHOLD']
  else list_filter([case when cs = 'COMPLETE' then 'SEMANTIC_COMPLETE' when cs = 'MOSTLY_COMPLETE' then 'SEMANTIC_MOSTLY_COMPLETE' end, case when eu = 'HIGH' then 'SEMANTIC_HIGH_USEFULNESS' end], lambda x: x is not null) end as reason_codes from de0)""")
step("wd0", """select job_id, stable_window_id, count(*) as n, count(*) filter (where eligible) as n_ok, max(candidate_id) filter (where selection_role = 'PRIMARY') as p, max(semantic_decision_score) filter (where selection_role = 'PRIMARY' and eligible) as s1,
  arg_max(candidate_id, (semantic_decision_score, -candidate_id)) filter (where selection_role <> 'PRIMARY' and eligible) as ba, max(semantic_decision_score) filter (where selection_role <> 'PRIMARY' and eligible) as s2, arg_min(candidate_id, rank_within_window) filter (where selection_role <> 'PRIMARY') as fa, max(candidate_id) filter (where eligible) as o,
  list(semantic_decision_score order by semantic_decision_score desc) filter (where eligible) as sc from de group by 1, 2""")
step("wd1", f"""select *, s1 is not null and s2 is not null and abs(s1 - s2) <= {P.decision_ambiguity_gap}::double as tie, coalesce(s1 is not null and (s2 is null or s2 < case when abs(s1 - s2) <= {P.decision_ambiguity_gap}::double then least(1.0::double, s1 + {P.primary_tie_bonus}::double) else s1 end + {P.alternate_switch_margin}::double), false) as stays, case when n_ok > 1 then sc[1] - sc[2] else 0.0::double end as score_gap from wd0""")
step("wd", f"""select job_id, stable_window_id, p as primary_candidate_id, case when n_ok > 1 then ba else fa end as alternate_candidate_id, w as selected_candidate_id, score_gap, n_ok > 1 and score_gap <= {P.decision_ambiguity_gap}::double as is_semantically_ambiguous,
  case when n_ok = 0 then 'REJECT_WINDOW' when n_ok = 1 and n = 1 then 'SELECT_SINGLE' when w = p then 'SELECT_PRIMARY' else 'SELECT_ALTERNATE' end as decision,
  case when n_ok = 0 then [case when n > 1 then 'BOTH_CANDIDATES_REJECTED' else 'CANDIDATE_REJECTED' end] when n_ok = 1 then ['ONLY_ELIGIBLE_CANDIDATE'] else list_filter([case when stays then 'PRIMARY_REMAINS_STRONGER' else 'ALTERNATE_OUTSCORES_PRIMARY' end, case when tie and stays then 'PRIMARY_TIE_BONUS' end, case when score_gap <= {P.decision_ambiguity_gap}::double then 'SEMANTIC_TIE' end], lambda x: x is not null) end as reason_codes
from (select *, case when n_ok = 0 then null when n_ok = 1 then o when stays then p else ba end as w from wd1)""")
register("decision_scores", lambda spark, sf: show(semantic.decide(judged(Visual.over(spark, sf)), P), "job_id, candidate_id, decision, eligible, reason_codes", "semantic_decision_score"), rounded("job_id, candidate_id, decision, eligible, reason_codes", "de", "semantic_decision_score"))
register("window_decisions", lambda spark, sf: show(semantic.window_decisions(semantic.decide(judged(Visual.over(spark, sf)), P), P), "job_id, stable_window_id, primary_candidate_id, alternate_candidate_id, selected_candidate_id, decision, is_semantically_ambiguous, reason_codes", "score_gap"), rounded("job_id, stable_window_id, primary_candidate_id, alternate_candidate_id, selected_candidate_id, decision, is_semantically_ambiguous, reason_codes", "wd", "score_gap"))


def neighbour_candidates(v: Visual):
    level = v.frames.select("job_id", F.col("index").alias("frame_index"), "level")
    b = v.bounds.select("job_id", "boundary_id", F.col("timestamp_seconds").alias("boundary_seconds"))
    h = v.handoff.select("job_id", "candidate_id", "timestamp_seconds", "frame_index", "boundary_id", F.col("stable_window_start_seconds").alias("window_start"), F.col("stable_window_end_seconds").alias("window_end"))
    return h.join(level, ["job_id", "frame_index"]).join(b, ["job_id", "boundary_id"], "left")


def temporal_neighbours(spark, sf):
    v = Visual.over(spark, sf)
    return show(neighbours.choose(neighbour_candidates(v), v.frames, v.segments, EVENTS), "job_id, candidate_id, role, frame_index", "frame_seconds")


_E = EVENTS
step("fst", "select f.job_id, f.index, arg_min(s.state, s.segment_id) as st from fr f join seg s on f.job_id = s.job_id and f.timestamp_seconds >= s.start_timestamp_seconds - 1e-6::double and f.timestamp_seconds <= s.end_timestamp_seconds + 1e-6::double group by 1, 2")
step("nc", "select h.job_id, h.candidate_id, h.timestamp_seconds as t, h.frame_index, f.level, b.timestamp_seconds as bs, h.start_seconds as w0, h.end_seconds as w1 from ho h join fr f on f.job_id = h.job_id and f.index = h.frame_index left join bo b on b.job_id = h.job_id and b.boundary_id = h.boundary_id")
step("nb", f"""select * from (select c.job_id, c.candidate_id, case when f.timestamp_seconds < t then 'PREVIOUS' else 'NEXT' end as role, f.index as frame_index, f.timestamp_seconds as frame_seconds, row_number() over (partition by c.job_id, c.candidate_id, f.timestamp_seconds < t order by
  case when f.timestamp_seconds < t then case when coalesce(st = 'CHANGING', false) then 0 else 1 end else case when f.timestamp_seconds >= w0 and f.timestamp_seconds <= w1 then 0 else 1 end end, case when f.timestamp_seconds < t then case when coalesce(f.timestamp_seconds < bs, false) then 0 else 1 end else case when coalesce(st = 'CHANGING', false) then 0 else 1 end end,
  abs(abs(t - f.timestamp_seconds) - {_E.neighbour_preferred_gap!r}::double), -f.quality_score, case when f.timestamp_seconds < t then -f.timestamp_seconds else f.timestamp_seconds end, f.index) as k
from nc c join fr f on f.job_id = c.job_id and f.is_valid and not f.is_black and f.index <> c.frame_index and f.timestamp_seconds <> t and f.timestamp_seconds >= greatest(0.0::double, t - {_E.neighbour_before!r}::double) and f.timestamp_seconds <= t + {_E.neighbour_after!r}::double and abs(t - f.timestamp_seconds) >= {_E.neighbour_min_gap!r}::double - 1e-6::double
  and abs(f.level - c.level) > {_E.neighbour_duplicate_difference}::double left join fst on fst.job_id = f.job_id and fst.index = f.index where coalesce(st not in ('INVALID', 'BLACK_TRANSITION'), true)) where k = 1""")
register("temporal_neighbours", temporal_neighbours, rounded("job_id, candidate_id, role, frame_index", "nb", "frame_seconds"))
