"""The engine's derived tables in DuckDB SQL, as a chain of named steps over the driver's tables."""

from __future__ import annotations

import re

from framewright.plans.adapters import EVENTS as P

STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def chain(final: str) -> str:
    """The final select with every step that it needs before it."""
    need: set[str] = set()

    def visit(sql: str) -> None:
        for n in STEPS:
            if n not in need and re.search(rf"\b{n}\b", sql):
                need.add(n)
                visit(STEPS[n])

    visit(final)
    parts = ",\n".join(f"{n} as materialized ({s})" for n, s in STEPS.items() if n in need)
    return f"with {parts}\n{final}" if parts else final


def c01(x: str) -> str:
    return f"(case when ({x}) is null or isnan(({x})::double) or isinf(({x})::double) then 0.0::double else greatest(0.0::double, least(1.0::double, ({x})::double)) end)"


def wsum(*values: tuple[str, float]) -> str:
    used = [(v, w) for v, w in values if w > 0]
    total = sum(w for _, w in used)
    return c01("(" + " + ".join(f"{c01(v)} * {w!r}::double" for v, w in used) + f") / {float(total)!r}::double")


def r6(x: str) -> str:
    return f"floor(({x})::double * 1e6::double + 0.50001371::double) / 1e6::double"


def ratio(n: str, total: str) -> str:
    return f"coalesce(({n})::double / nullif(({total})::double, 0), 0.0::double)"


def rounded(columns: str, source: str, numbers: str, tail: str = "") -> str:
    """Select plain columns and six-decimal numbers from a step."""
    cols = [c.strip() for c in columns.split(",") if c.strip()] + [f"{r6(c.strip())} as {c.strip()}" for c in numbers.split(",") if c.strip()]
    return chain(f"select {', '.join(cols)} from {source} {tail}")


step("ev", "select cast(user_id as varchar) as job_id, event_id, epoch_us(ts) as us, event_type, value from events")
step("fr0", """
select job_id, row_number() over (partition by job_id order by us, event_id) as index, (us - min(us) over (partition by job_id)) / 1e6::double as timestamp_seconds,
  'frames/' || event_id as source_path, 'small/' || event_id as processed_path, not (event_type = 'error' and event_id % 10 = 0) as is_valid, value / 500.0::double as level,
  case when event_type = 'signup' and event_id % 5 = 0 then 0.01::double else value / 500.0::double * 0.9::double + 0.06::double end as brightness, (event_id % 89) / 178.0::double as contrast,
  (event_id % 307)::double as sharpness_score, (event_id % 53) / 530.0::double as edge_density, case when event_type = 'signup' and event_id % 5 = 0 then 1.0::double else 0.0::double end as black_pixel_ratio,
  (event_id % 65) / 64.0::double as entropy
from ev""")
step("fr", f"""
select *, brightness < {P.dark_frame_threshold}::double as is_very_dark, brightness < {P.dark_frame_threshold}::double and black_pixel_ratio >= {P.black_pixel_ratio}::double as is_black, sharpness_score < {P.blur_variance}::double as is_blurry,
  edge_density < {P.low_information_edge_density}::double and contrast < {P.low_information_contrast}::double as is_low_information,
  case when brightness < {P.dark_frame_threshold}::double and black_pixel_ratio >= {P.black_pixel_ratio}::double then 0.0::double else greatest(0.0::double, least(1.0::double,
    0.55::double * least(1.0::double, sharpness_score / {max(1.0, P.blur_variance * 4)}::double) + 0.25::double * greatest(0.0::double, 1.0::double - abs(brightness - 0.5::double) * 1.5::double)
    + 0.20::double * least(1.0::double, edge_density * 8.0::double + contrast))) end as quality_score
from fr0""")
W = "over (partition by job_id order by timestamp_seconds, index)"
step("adj", f"""
select * from (select *, lag(index) {W} as pi, lag(timestamp_seconds) {W} as pt, lag(is_valid) {W} as pv, lag(is_black) {W} as pb, lag(level) {W} as pl from fr) where pi is not null""")
_T = P.diff_pixel_weight + P.diff_ssim_weight + P.diff_phash_weight + P.diff_edge_weight
step("dif", f"""
select job_id, pi as previous_frame_index, index as current_frame_index, pt as previous_timestamp_seconds, timestamp_seconds as current_timestamp_seconds, greatest(0.0::double, timestamp_seconds - pt) as delta_seconds,
  pb as previous_is_black, is_black as current_is_black, (pv and is_valid) as valid, case when not pv then 'previous_frame_invalid' when not is_valid then 'current_frame_invalid' end as reason,
  case when pv and is_valid then least(1.0::double, abs(level - pl)) end as pixel_difference, case when pv and is_valid then least(1.0::double, abs(level - pl) * 0.9::double) end as ssim_difference,
  case when pv and is_valid then least(1.0::double, abs(level - pl) * 1.1::double) end as phash_difference, case when pv and is_valid then least(1.0::double, abs(level - pl) * 0.8::double) end as edge_difference
from adj""")
step("ds", f"""
select *, case when valid then greatest(0.0::double, least(1.0::double, 0.0::double + pixel_difference * {P.diff_pixel_weight / _T!r}::double + ssim_difference * {P.diff_ssim_weight / _T!r}::double
  + phash_difference * {P.diff_phash_weight / _T!r}::double + edge_difference * {P.diff_edge_weight / _T!r}::double)) end as difference_score from dif""")
step("dist", """
select job_id, count(*) as total_comparisons, count(difference_score) as valid_comparisons, count(*) - count(difference_score) as invalid_comparisons, coalesce(avg(difference_score), 0) as mean_difference_score,
  coalesce(max(difference_score), 0) as max_difference_score, coalesce(quantile_cont(difference_score, 0.5), 0) as p50, coalesce(quantile_cont(difference_score, 0.75), 0) as p75, coalesce(quantile_cont(difference_score, 0.9), 0) as p90,
  coalesce(quantile_cont(difference_score, 0.95), 0) as p95, coalesce(quantile_cont(difference_score, 0.99), 0) as p99
from ds group by job_id""")
step("med", "select job_id, quantile_cont(difference_score, 0.5) as m, quantile_cont(difference_score, 0.9) as q90, quantile_cont(difference_score, 0.95) as q95, quantile_cont(difference_score, 0.99) as q99, count(difference_score) as n from ds group by job_id")
step("cen", "select med.*, (select quantile_cont(abs(difference_score - med.m), 0.5) from ds where ds.job_id = med.job_id) as mad0 from med")
step("th0", f"""select *, case when m is null then {P.major_min_score}::double else least(1.0::double, greatest({P.major_min_score}::double, q95, m + {P.major_robust_multiplier}::double * 1.4826::double * mad0)) end as major_threshold from cen""")
step("th", f"""
select job_id, coalesce(m, 0) as median_score, coalesce(mad0, 0) as mad, coalesce(q90, 0) as p90, coalesce(q95, 0) as p95, coalesce(q99, 0) as p99, n, major_threshold,
  case when m is null then {P.very_major_min_score}::double else greatest(major_threshold, least(1.0::double, greatest({P.very_major_min_score}::double, q99, major_threshold * 1.15::double))) end as very_major_threshold
from th0""")
_floor = "greatest(0.10::double, major_threshold * 0.45::double)"
step("cand", f"""
select ds.*, major_threshold, very_major_threshold, median_score, mad, case when not valid then 'invalid' when previous_is_black or current_is_black then 'black' when difference_score >= major_threshold then 'major' end as kind,
  case when not valid then 0.0::double else coalesce(difference_score, 0) end as strength,
  {ratio(f"(pixel_difference >= {_floor})::int + (ssim_difference >= {_floor})::int + (phash_difference >= {_floor})::int + (edge_difference >= {_floor})::int", "case when pixel_difference is null then 0 else 4 end")} as agreement
from ds join th using (job_id)""")
step("clu", f"""
select *, sum(new) over (partition by job_id, kind order by current_timestamp_seconds, current_frame_index) as cluster from (
  select *, coalesce((current_timestamp_seconds - lag(current_timestamp_seconds) over (partition by job_id, kind order by current_timestamp_seconds, current_frame_index) > {P.major_merge_window}::double)::int, 1) as new from cand where kind is not null)""")
step("top", """
select * from (select *, row_number() over (partition by job_id, kind, cluster order by strength desc, current_timestamp_seconds, current_frame_index) as k, min(previous_timestamp_seconds) over (partition by job_id, kind, cluster) as s0,
  max(current_timestamp_seconds) over (partition by job_id, kind, cluster) as s1, count(*) over (partition by job_id, kind, cluster) as members from clu) where k = 1""")
step("evs", """
select job_id, row_number() over (partition by job_id order by current_timestamp_seconds, case kind when 'black' then 0 when 'invalid' then 1 else 2 end, cluster) as event_id,
  case when kind = 'black' then 'BLACK_TRANSITION' when kind = 'invalid' then 'INVALID_GAP' when strength >= very_major_threshold then 'VERY_MAJOR_VISUAL_CHANGE' else 'MAJOR_VISUAL_CHANGE' end as event_type,
  current_timestamp_seconds as timestamp_seconds, s0 as start_timestamp_seconds, s1 as end_timestamp_seconds, previous_frame_index, current_frame_index, difference_score, case when kind = 'major' then major_threshold end as threshold,
  case when kind = 'major' then (strength - median_score) / (1.4826::double * mad + 1e-6::double) end as robust_score, case when kind = 'major' then agreement end as metric_agreement,
  case when kind = 'black' then 1.0::double when kind = 'invalid' then 0.0::double else least(1.0::double, 0.35::double + 0.45::double * least(1.0::double, greatest(0.0::double, strength - major_threshold) / greatest(1e-6::double, 1.0::double - major_threshold)) + 0.20::double * agreement) end as confidence, members
from top""")
step("evst", """
with base as (select job_id, count(*) as total_comparisons, count(difference_score) as v from ds group by job_id),
n as (select job_id, count(*) filter (where event_type = 'MAJOR_VISUAL_CHANGE') as a, count(*) filter (where event_type = 'VERY_MAJOR_VISUAL_CHANGE') as b, count(*) filter (where event_type = 'BLACK_TRANSITION') as c, count(*) filter (where event_type = 'INVALID_GAP') as d from evs group by job_id),
g as (select job_id, timestamp_seconds - lag(timestamp_seconds) over (partition by job_id order by timestamp_seconds, event_id) as gap from evs where event_type like '%MAJOR_VISUAL%'),
s as (select job_id, avg(gap) as ga, quantile_cont(gap, 0.5) as gm from g group by job_id)
select base.job_id, total_comparisons, coalesce(a, 0) as major_events, coalesce(b, 0) as very_major_events, coalesce(c, 0) as black_transitions, coalesce(d, 0) as invalid_gaps, ga as average_seconds_between_major_changes, gm as median_seconds_between_major_changes,
  (coalesce(a, 0) + coalesce(b, 0)) / greatest(1, v)::double as event_ratio
from base left join n using (job_id) left join s using (job_id)""")
step("lim", f"""
select job_id, greatest(0.0::double, least(1.0::double, e)) as enter_stable_threshold, greatest(0.0::double, least(1.0::double, least(greatest(e, e * {P.exit_stable_factor}::double), major_threshold * case when n = 0 then 0.85::double else 0.65::double end))) as exit_stable_threshold, major_threshold
from (select *, case when n = 0 then least(major_threshold * 0.5::double, {P.stable_min_score}::double) else least(greatest({P.stable_min_score}::double, median_score + {P.stable_robust_multiplier}::double * 1.4826::double * mad), {P.stable_max_score}::double, major_threshold * 0.35::double) end as e from th)""")
step("spe", """
select d.job_id, d.current_frame_index, max(case when event_type = 'INVALID_GAP' then 3 when event_type = 'BLACK_TRANSITION' then 2 else 1 end) as special
from ds d join evs e on d.job_id = e.job_id and d.current_timestamp_seconds > e.start_timestamp_seconds + 1e-6::double and d.current_timestamp_seconds <= e.end_timestamp_seconds + 1e-6::double group by 1, 2""")
step("own", f"""
select ds.*, enter_stable_threshold, exit_stable_threshold, major_threshold,
  case when not valid then 'INVALID' when coalesce(delta_seconds > u * {P.long_gap_factor}::double, false) then 'INVALID' when special = 3 then 'INVALID' when special = 2 then 'BLACK_TRANSITION' when special = 1 then 'MAJOR_TRANSITION' end as own
from ds left join spe using (job_id, current_frame_index) join (select job_id, quantile_cont(delta_seconds, 0.5) filter (where delta_seconds > 0) as u from ds group by job_id) using (job_id) join lim using (job_id)""")
step("sta", """
select *, coalesce(own, case when coalesce(last_value(latch ignore nulls) over (partition by job_id order by current_timestamp_seconds, current_frame_index rows between unbounded preceding and current row), false) then 'STABLE' else 'CHANGING' end) as state
from (select *, case when own is not null then null when coalesce(difference_score, 0) <= enter_stable_threshold then true when coalesce(difference_score, 0) > exit_stable_threshold then false end as latch from own)""")
step("rows", """
with r as (select job_id, state, previous_timestamp_seconds as s, current_timestamp_seconds as e, previous_frame_index as a, current_frame_index as z, case when valid then difference_score end as score, major_threshold as mt from sta)
select * from r union all
select job_id, 'INVALID', pe, s, null, null, null, mt from (select *, lag(e) over (partition by job_id order by s, e) as pe from r) where s > pe + 1e-6::double""")


def _number(source: str, order: str, name: str) -> str:
    flag = f"select *, case when coalesce(state <> lag(state) over (partition by job_id order by {order}) or s > lag(e) over (partition by job_id order by {order}) + 1e-6::double, true) then 1 else 0 end as f from {source}"
    return f"select * exclude (f), sum(f) over (partition by job_id order by {order} rows between unbounded preceding and current row) as {name} from ({flag})"


step("raw0", _number("rows", "s, e", "s0"))
step("seg1", _number(f"""(select job_id, s0, min(s) as s, max(e) as e, max(score) as top, any_value(mt) as mt, case when any_value(state) = 'STABLE' and max(e) - min(s) < {P.min_stable_duration}::double then 'CHANGING' else any_value(state) end as state from raw0 group by 1, 2)""", "s0", "s1"))
step("seg2a", "select job_id, s1, min(s) as s, max(e) as e, max(top) as top, any_value(mt) as mt, any_value(state) as st from seg1 group by 1, 2")
step("seg2", _number(f"""(select *, case when st = 'CHANGING' and lag(st) over (partition by job_id order by s1) = 'STABLE' and lead(st) over (partition by job_id order by s1) = 'STABLE' and coalesce(top, 0) < mt * 0.80::double
  and (greatest(0.0::double, e - s) <= {P.max_stable_gap}::double or greatest(0.0::double, e - s) < {P.min_changing_duration}::double) then 'STABLE' else st end as state from seg2a)""", "s1", "segment_id"))
step("seg", """
select *, greatest(0.0::double, end_timestamp_seconds - start_timestamp_seconds) as duration_seconds, case when state = 'CHANGING' and mean_difference_score is not null then least(1.0::double, mean_difference_score / greatest(1e-6::double, mt)) end as change_intensity from (
select job_id, segment_id::bigint as segment_id, any_value(y.state) as state, min(raw0.s) as start_timestamp_seconds, max(raw0.e) as end_timestamp_seconds, arg_min(a, (raw0.s, z)) filter (where z is not null) as start_frame_index, arg_max(z, (raw0.s, z)) filter (where z is not null) as end_frame_index,
  avg(score) as mean_difference_score, quantile_cont(score, 0.5) as median_difference_score, min(score) as min_difference_score, max(score) as max_difference_score, count(z) as comparison_count, any_value(raw0.mt) as mt
from raw0 join (select job_id, s0, s1 from seg1) using (job_id, s0) join (select job_id, s1, segment_id, state from seg2) y using (job_id, s1) group by 1, 2)""")
step("segst", """
select *, case when total_duration_seconds > 0 then stable_duration_seconds / total_duration_seconds else 0.0::double end as stable_ratio, case when total_duration_seconds > 0 then changing_duration_seconds / total_duration_seconds else 0.0::double end as changing_ratio,
  case when total_duration_seconds > 0 then invalid_duration_seconds / total_duration_seconds else 0.0::double end as invalid_ratio from (
select job_id, sum(duration_seconds) as total_duration_seconds, coalesce(sum(duration_seconds) filter (where state = 'STABLE'), 0) as stable_duration_seconds, coalesce(sum(duration_seconds) filter (where state = 'CHANGING'), 0) as changing_duration_seconds,
  coalesce(sum(duration_seconds) filter (where state in ('MAJOR_TRANSITION', 'BLACK_TRANSITION')), 0) as transition_duration_seconds, coalesce(sum(duration_seconds) filter (where state = 'INVALID'), 0) as invalid_duration_seconds,
  count(*) filter (where state = 'STABLE') as stable_segment_count, count(*) filter (where state = 'CHANGING') as changing_segment_count, count(*) filter (where state in ('MAJOR_TRANSITION', 'BLACK_TRANSITION')) as transition_segment_count, count(*) filter (where state = 'INVALID') as invalid_segment_count
from seg group by job_id)""")

# -- stability windows, boundaries, candidates -------------------------------------------------------------------
step("sw0", """
select *, row_number() over (partition by job_id order by segment_id) as window_id from (
  select job_id, segment_id, state, start_timestamp_seconds as start_seconds, end_timestamp_seconds as end_seconds, duration_seconds, start_frame_index, end_frame_index, lag(state) over w as previous_segment_state, lag(duration_seconds) over w as pd, lag(end_frame_index) over w as previous_end_frame_index,
    lead(state) over w as next_segment_state
  from seg window w as (partition by job_id order by segment_id)) where state = 'STABLE'""")
step("swc", """
select w.job_id, window_id, count(*) as comparison_count, avg(difference_score) as mean_difference_score, quantile_cont(difference_score, 0.5) as median_difference_score, max(difference_score) as max_difference_score, stddev_pop(difference_score) as difference_stddev
from sw0 w join ds on w.job_id = ds.job_id and difference_score is not null and current_timestamp_seconds >= start_seconds - 1e-9::double and current_timestamp_seconds <= end_seconds + 1e-9::double group by 1, 2""")
step("swf", """
select w.job_id, window_id, count(*) as frame_count, avg(is_valid::int::double) as valid_frame_ratio, avg(is_black::int::double) as black_frame_ratio, avg(is_blurry::int::double) as blurry_frame_ratio, avg(is_low_information::int::double) as low_information_ratio,
  avg(quality_score) filter (where is_valid) as aq, avg(sharpness_score) filter (where is_valid) as average_sharpness
from sw0 w join fr on w.job_id = fr.job_id and timestamp_seconds >= start_seconds - 1e-9::double and timestamp_seconds <= end_seconds + 1e-9::double group by 1, 2""")
step("sw1", """
select w.*, coalesce(comparison_count, 0) as comparison_count, coalesce(frame_count, 0) as frame_count, coalesce(mean_difference_score, 0) as mean_difference_score, coalesce(median_difference_score, 0) as median_difference_score, coalesce(max_difference_score, 0) as max_difference_score,
  coalesce(difference_stddev, 0) as difference_stddev, coalesce(valid_frame_ratio, 0) as valid_frame_ratio, coalesce(black_frame_ratio, 0) as black_frame_ratio, coalesce(blurry_frame_ratio, 0) as blurry_frame_ratio, coalesce(low_information_ratio, 0) as low_information_ratio, coalesce(aq, 0) as aq, average_sharpness,
  case when frame_count > 0 then 1.0::double - valid_frame_ratio else 0.0::double end as invalid_frame_ratio, greatest(1e-6::double, enter_stable_threshold) as en, greatest(1e-6::double, enter_stable_threshold, exit_stable_threshold) as ex, major_threshold as mt
from sw0 w left join swc using (job_id, window_id) left join swf using (job_id, window_id) join lim using (job_id)""")
_long = c01(f"duration_seconds / {P.window_duration_saturation!r}::double")
step("sw2", f"""
select *, {wsum(("aq", .55), ("valid_frame_ratio", .20), ("1.0::double - blurry_frame_ratio", .10), ("1.0::double - low_information_ratio", .10), ("1.0::double - black_frame_ratio", .05))} * case when black_frame_ratio > {P.window_max_black_ratio}::double then 0.25::double else 1.0::double end as quality_score,
  {wsum(("1.0::double - mean_difference_score / ex", P.stability_difference_weight), ("1.0::double - difference_stddev / greatest(en * 2.0::double, 1e-6::double)", P.stability_variance_weight), ("1.0::double - max_difference_score / greatest(ex * 2.0::double, 1e-6::double)", P.stability_spike_weight), (_long, P.stability_duration_weight))} as stability_score
from sw1""")
step("sw", f"""
select *, len(rejection_reasons) = 0 as is_valid from (
select *, {wsum(("stability_score", .5), ("quality_score", .25), ("valid_frame_ratio", .15), (_long, .1))} as window_confidence,
  list_filter([case when duration_seconds < {P.window_min_duration}::double then 'TOO_SHORT' end, case when invalid_frame_ratio > {P.window_max_invalid_ratio}::double then 'TOO_MANY_INVALID_FRAMES' end, case when black_frame_ratio > {P.window_max_black_ratio}::double then 'TOO_MANY_BLACK_FRAMES' end, case when comparison_count = 0 then 'INSUFFICIENT_VALID_COMPARISONS' end], lambda x: x is not null) as rejection_reasons,
  start_seconds - (select max(timestamp_seconds) from evs where evs.job_id = sw2.job_id and timestamp_seconds <= start_seconds) as seconds_since_previous_major_transition,
  (select min(timestamp_seconds) from evs where evs.job_id = sw2.job_id and timestamp_seconds >= end_seconds) - end_seconds as seconds_until_next_major_transition
from sw2)""")
_q = lambda c, x: f"coalesce(quantile_cont({c}, {x}) filter (where is_valid), 0)"
step("swst", f"""
select job_id, count(*) as total_stable_segments, count(*) filter (where is_valid) as valid_windows, count(*) filter (where not is_valid) as rejected_windows, sum(duration_seconds) as total_stable_seconds, coalesce(sum(duration_seconds) filter (where is_valid), 0) as valid_stable_seconds,
  coalesce(avg(duration_seconds) filter (where is_valid), 0) as mean_window_seconds, {_q("duration_seconds", .5)} as median_window_seconds, {_q("duration_seconds", .9)} as p90_window_seconds, coalesce(avg(stability_score) filter (where is_valid), 0) as mean_stability_score, {_q("stability_score", .5)} as median_stability_score,
  count(*) filter (where list_contains(rejection_reasons, 'TOO_SHORT')) as rejected_too_short, count(*) filter (where list_contains(rejection_reasons, 'TOO_MANY_BLACK_FRAMES')) as rejected_black, count(*) filter (where list_contains(rejection_reasons, 'TOO_MANY_INVALID_FRAMES')) as rejected_invalid
from sw group by job_id""")
step("bo0", f"""
select *, row_number() over (partition by job_id order by window_id) as boundary_id, case when previous_segment_state in ('CHANGING', 'MAJOR_TRANSITION', 'BLACK_TRANSITION', 'INVALID') then previous_segment_state || '_TO_STABLE' when previous_segment_state is null and start_seconds <= 1e-6::double then 'STABLE_AT_VIDEO_START' else 'OTHER_TO_STABLE' end as boundary_type,
  greatest(0.0::double, start_seconds - {P.boundary_context!r}::double) as lo, least(end_seconds, start_seconds + {P.boundary_context!r}::double) as hi
from sw where is_valid""")
step("bom", """
select b.job_id, boundary_id, count(*) filter (where c <= t + 1e-9::double) as n_pre, count(*) filter (where c >= t - 1e-9::double and c <= hi + 1e-9::double) as n_post, avg(sc) filter (where c <= t + 1e-9::double) as pre_mean, max(sc) filter (where c <= t + 1e-9::double) as pre_max,
  avg(sc) filter (where c >= t - 1e-9::double and c <= hi + 1e-9::double) as post_mean, max(sc) filter (where c >= t - 1e-9::double and c <= hi + 1e-9::double) as post_max
from (select *, start_seconds as t from bo0) b join (select job_id, current_timestamp_seconds as c, difference_score as sc from ds where difference_score is not null) d on b.job_id = d.job_id and c >= lo - 1e-9::double and c <= greatest(hi, t) + 1e-9::double group by 1, 2""")
step("bo1", f"""
select *, case boundary_type when 'CHANGING_TO_STABLE' then 1.0::double when 'MAJOR_TRANSITION_TO_STABLE' then 0.95::double when 'BLACK_TRANSITION_TO_STABLE' then 0.85::double when 'STABLE_AT_VIDEO_START' then 0.45::double when 'INVALID_TO_STABLE' then 0.0::double else 0.20::double end as prior,
  {c01("greatest(0.0::double, pre_mean - post_mean) / scale")} as activity_drop_score, {c01("greatest(pre_mean, pre_max * 0.65::double) / scale")} as preceding_activity_score, case when previous_segment_state = 'CHANGING' then pd else 0.0::double end as preceding_changing_duration_seconds
from (select b.* , coalesce(n_pre, 0) as n_pre, coalesce(n_post, 0) as n_post, coalesce(pre_mean, 0) as pre_mean, coalesce(pre_max, 0) as pre_max, coalesce(post_mean, 0) as post_mean, coalesce(post_max, 0) as post_max, greatest(en, mt, 1e-6::double) as scale from bo0 b left join bom using (job_id, boundary_id))""")
step("bo", f"""
select *, len(rejection_reasons) = 0 as is_valid from (select *, list_filter([case when boundary_type in ('INVALID_TO_STABLE', 'OTHER_TO_STABLE') then 'UNTRUSTED_PREVIOUS_STATE' end,
  case when boundary_type not in ('STABLE_AT_VIDEO_START', 'INVALID_TO_STABLE') and n_pre = 0 then 'INSUFFICIENT_PRE_BOUNDARY_DATA' end, case when boundary_type not in ('STABLE_AT_VIDEO_START', 'INVALID_TO_STABLE') and activity_drop_score < {P.boundary_min_drop}::double then 'NO_MEANINGFUL_ACTIVITY_DROP' end,
  case when n_post = 0 then 'INSUFFICIENT_POST_BOUNDARY_DATA' end, case when quality_score <= 0.05::double then 'STABLE_WINDOW_LOW_QUALITY' end, case when stability_score <= 0.05::double then 'STABLE_WINDOW_TOO_WEAK' end,
  case when boundary_score < {P.boundary_min_score}::double and boundary_type <> 'STABLE_AT_VIDEO_START' then 'BOUNDARY_SCORE_TOO_LOW' end], lambda x: x is not null) as rejection_reasons from (
select * exclude (is_valid, rejection_reasons), window_id as stable_window_id, start_seconds as timestamp_seconds, case when previous_segment_state = 'CHANGING' then previous_end_frame_index end as last_changing_frame_index, {c01(wsum(("activity_drop_score", P.boundary_drop_weight), ("stability_score", P.boundary_stability_weight), ("quality_score", P.boundary_quality_weight), (f"duration_seconds / {P.boundary_duration_saturation!r}::double", P.boundary_duration_weight), ("prior", P.boundary_type_weight)) + " * (1.0::double - 0.30::double * low_information_ratio)")} as boundary_score from bo1))""")
step("bost", """
select job_id, count(*) as total_boundaries, count(*) filter (where is_valid) as valid_boundaries, count(*) filter (where is_valid and boundary_type = 'CHANGING_TO_STABLE') as changing_to_stable, count(*) filter (where is_valid and boundary_type = 'MAJOR_TRANSITION_TO_STABLE') as major_to_stable,
  count(*) filter (where is_valid and boundary_type = 'BLACK_TRANSITION_TO_STABLE') as black_to_stable, count(*) filter (where is_valid and boundary_type = 'STABLE_AT_VIDEO_START') as at_start, coalesce(avg(boundary_score) filter (where is_valid), 0) as mean_boundary_score, coalesce(quantile_cont(boundary_score, 0.9) filter (where is_valid), 0) as p90_boundary_score,
  coalesce(avg(activity_drop_score) filter (where is_valid), 0) as mean_activity_drop
from bo group by job_id""")
step("rq0", f"""
select *, start_seconds + {P.settle_delay!r}::double as u0, end_seconds - {P.exit_margin!r}::double as u1, least(case when duration_seconds < {P.short_window!r}::double then 1 when duration_seconds < {P.medium_window!r}::double then 2 when duration_seconds < {P.long_window!r}::double then 3 else 5 end, {P.max_per_window}) as want from sw where is_valid""")
step("rq1", """
select *, case when u0 > u1 then [{'k': 'MID_STABLE', 'a': (start_seconds + end_seconds) / 2.0::double}] when want = 1 then [{'k': 'MID_STABLE', 'a': u0 + (u1 - u0) * 0.5::double}] when want = 2 then [{'k': 'SETTLED_START', 'a': u0 + (u1 - u0) * 0.0::double}, {'k': 'MID_STABLE', 'a': u0 + (u1 - u0) * 0.5::double}]
  when want = 3 then [{'k': 'SETTLED_START', 'a': u0 + (u1 - u0) * 0.0::double}, {'k': 'MID_STABLE', 'a': u0 + (u1 - u0) * 0.5::double}, {'k': 'PRE_EXIT', 'a': u1}]
  else [{'k': 'SETTLED_START', 'a': u0 + (u1 - u0) * 0.0::double}, {'k': 'EARLY_STABLE', 'a': u0 + (u1 - u0) * 0.25::double}, {'k': 'MID_STABLE', 'a': u0 + (u1 - u0) * 0.5::double}, {'k': 'LATE_STABLE', 'a': u0 + (u1 - u0) * 0.78::double}, {'k': 'PRE_EXIT', 'a': u1}] end as places from rq0""")
# requests stand in rising order, and the spacing is far below their distance but for three in a short window: there the last goes if it is too near the one before
step("rq2", "select job_id, window_id, generate_subscripts(places, 1) as request, unnest(places) as r, * exclude (job_id, window_id, places) from rq1")
step("rqk", f"""
with recursive keep as (
  select job_id, window_id, request, r.a as a, r.k as k, request as last, r.a as la from rq2 where request = 1
  union all
  select q.job_id, q.window_id, q.request, q.r.a, q.r.k, case when abs(q.r.a - keep.la) >= {P.min_spacing!r}::double - 1e-9::double then q.request else keep.last end, case when abs(q.r.a - keep.la) >= {P.min_spacing!r}::double - 1e-9::double then q.r.a else keep.la end
  from keep join rq2 q on q.job_id = keep.job_id and q.window_id = keep.window_id and q.request = keep.request + 1)
select job_id, window_id, row_number() over (partition by job_id, window_id order by request) - 1 as request, a as requested_timestamp_seconds, k as candidate_type from keep where last = request""")
step("rq", "select rqk.*, sw.* exclude (job_id, window_id) from rqk join sw using (job_id, window_id)")
step("nf", f"""
select * from (select rq.job_id, rq.window_id, rq.request, fr.index as frame_index, fr.timestamp_seconds as ft, fr.source_path, fr.processed_path, fr.brightness, fr.contrast, fr.sharpness_score, fr.edge_density, fr.entropy, fr.quality_score as frame_quality_score, fr.is_blurry, fr.is_low_information,
  row_number() over (partition by rq.job_id, rq.window_id, rq.request order by round(abs(fr.timestamp_seconds - requested_timestamp_seconds), 9), -fr.quality_score, -fr.timestamp_seconds, fr.index) as k
  from rq join fr on rq.job_id = fr.job_id and fr.is_valid and not fr.is_black and fr.timestamp_seconds >= greatest(start_seconds, requested_timestamp_seconds - {P.search_radius!r}::double) - 1e-9::double and fr.timestamp_seconds <= least(end_seconds, requested_timestamp_seconds + {P.search_radius!r}::double) + 1e-9::double) where k = 1""")
step("ge0", """
select rq.job_id, rq.window_id, rq.request, candidate_type, requested_timestamp_seconds, rq.start_seconds, rq.end_seconds, rq.duration_seconds, rq.stability_score, rq.quality_score as window_quality_score, b.boundary_id, b.boundary_type, coalesce(b.boundary_score, 0) as boundary_score, coalesce(b.activity_drop_score, 0) as activity_drop_score,
  coalesce(b.preceding_activity_score, 0) as preceding_activity_score, coalesce(b.preceding_changing_duration_seconds, 0) as preceding_changing_duration_seconds, b.timestamp_seconds as bat, nf.* exclude (job_id, window_id, request, k), coalesce(ft, requested_timestamp_seconds) as pos,
  case candidate_type when 'SETTLED_START' then 0 when 'MID_STABLE' then 1 when 'LATE_STABLE' then 2 when 'PRE_EXIT' then 3 else 4 end as ord,
  list_filter([case when requested_timestamp_seconds < start_seconds - 1e-9::double or requested_timestamp_seconds > end_seconds + 1e-9::double then 'OUTSIDE_WINDOW' end, case when frame_index is null then 'NO_VALID_FRAME_NEAR_TIMESTAMP' end], lambda x: x is not null) as y0
from rq left join (select job_id, window_id, boundary_id, boundary_type, boundary_score, activity_drop_score, preceding_activity_score, preceding_changing_duration_seconds, timestamp_seconds from bo where is_valid) b on rq.job_id = b.job_id and rq.window_id = b.window_id left join nf on rq.job_id = nf.job_id and rq.window_id = nf.window_id and rq.request = nf.request""")
step("ge1", "select *, case when len(y0) = 0 and row_number() over (partition by job_id, window_id, frame_index, len(y0) = 0 order by ord, request) > 1 then ['DUPLICATE_TIMESTAMP'] else y0 end as y1 from ge0")
step("ge2", f"select *, case when len(y1) = 0 and row_number() over (partition by job_id, len(y1) = 0 order by boundary_score desc, stability_score desc, window_quality_score desc, pos, window_id, request) > {P.max_total_candidates} then ['GLOBAL_CANDIDATE_CAP'] else y1 end as rejection_reasons from ge1")
step("ge", f"""
select *, row_number() over (partition by job_id order by pos, window_id, ord, request) as candidate_id, window_id as stable_window_id, len(rejection_reasons) = 0 as is_valid, case when boundary_id is not null then 'BOUNDARY' else 'WINDOW_ONLY' end as source_type, ft as frame_timestamp_seconds,
  {c01("(pos - start_seconds) / greatest(duration_seconds, 1e-9::double)")} as relative_position, case when boundary_id is not null then greatest(0.0::double, pos - bat) end as seconds_after_boundary, greatest(0.0::double, end_seconds - pos) as seconds_before_stable_exit from ge2""")
step("gest", "select job_id, count(*) as candidates_generated, count(*) filter (where is_valid) as valid_candidates, count(*) filter (where not is_valid) as rejected_candidates, count(distinct stable_window_id) as windows, count(*) filter (where abs(frame_timestamp_seconds - requested_timestamp_seconds) > 1e-6::double) as shifted_to_nearby_frame, count(*) filter (where is_valid) / count(distinct stable_window_id) as mean_candidates_per_window from ge group by job_id")
step("loc", f"""select ge.job_id, candidate_id, avg(difference_score) as lm, max(difference_score) as lx from ge join ds on ge.job_id = ds.job_id and ge.is_valid and difference_score is not null and current_timestamp_seconds >= ft - {P.local_context!r}::double - 1e-9::double and current_timestamp_seconds <= ft + {P.local_context!r}::double + 1e-9::double group by 1, 2""")
_bq = f"(case when brightness is null then 0.0::double when brightness between 0.12::double and 0.88::double then 1.0::double when brightness < 0.12::double then {c01('brightness / 0.12::double')} else {c01('(1.0::double - brightness) / 0.12::double')} end)"
_con = c01("coalesce(contrast, 0) * 2.0::double")
_sm = repr(P.safe_margin) + "::double"
step("sc0", f"""
select *, case when is_valid then {c01(wsum((f"coalesce(sharpness_score, 0) / {P.sharpness_saturation}::double", .35), (_bq, .15), (_con, .15), ("coalesce(frame_quality_score, 0)", .35)) + " * case when is_blurry then 0.75::double else 1.0::double end")} else 0.0::double end as visual_quality_score,
  case when is_valid then {c01(wsum(("coalesce(edge_density, 0) * 8.0::double", .55), (_con, .20), ("coalesce(entropy, 0)", .25)) + " * case when is_low_information then 0.60::double else 1.0::double end")} else 0.0::double end as content_density_score,
  case when is_valid then {c01("1.0::double - coalesce(lm, 0) / greatest(1e-6::double, exit_stable_threshold)")} else 0.0::double end as local_stability_score,
  case when is_valid then {wsum((f"case when seconds_after_boundary is null then 0.20::double else 1.0::double - seconds_after_boundary / {_sm} end", .35), (f"1.0::double - seconds_before_stable_exit / {_sm}", .35), ("coalesce(lx, 0) / greatest(exit_stable_threshold, major_threshold, 1e-6::double)", .30))} else 1.0::double end as transition_risk_score,
  case when is_valid then {wsum(("preceding_activity_score", .75), (f"preceding_changing_duration_seconds / {P.boundary_duration_saturation!r}::double", .25))} else 0.0::double end as preceding_activity_strength, {c01("1.0::double - abs(relative_position - 0.65::double) / 0.70::double")} as positional_completeness_score
from ge left join loc using (job_id, candidate_id) join lim using (job_id)""")
step("sc1", """
select *, case when is_valid then 1.0::double - transition_risk_score else 0.0::double end as transition_safety_score, first_value(content_density_score) over w as d0, first_value(coalesce(edge_density, 0)) over w as e0 from sc0 window w as (partition by job_id, stable_window_id, is_valid order by pos, candidate_id rows between unbounded preceding and current row)""")
step("sc2", f"""
select *, case when is_valid then {c01("(content_density_score - d0) / greatest(0.10::double, 1.0::double - d0)")} else 0.0::double end as relative_content_gain, case when is_valid then {c01("(coalesce(edge_density, 0) - e0) / greatest(0.02::double, 1.0::double - e0)")} else 0.0::double end as eg from sc1""")
step("sc3", f"select *, case when is_valid then {wsum(('relative_content_gain', .65), ('eg', .35))} else 0.0::double end as content_accumulation_score from sc2")
_cn = ("case when source_type = 'BOUNDARY' then boundary_score else 0.15::double end", "local_stability_score", "preceding_activity_strength", "content_accumulation_score", "content_density_score", "positional_completeness_score", "visual_quality_score", "transition_safety_score")
step("sc", f"select *, {wsum(*zip(_cn, P.completeness_weights))} as completeness_heuristic_score from sc3")
_rn = ("visual_quality_score", "completeness_heuristic_score", "transition_safety_score", "local_stability_score", "boundary_score", "content_density_score", "content_accumulation_score")
step("ra0", f"""select *, {c01(wsum(*zip(_rn, P.rank_weights)) + " + case candidate_type when 'SETTLED_START' then 0.006::double when 'EARLY_STABLE' then 0.002::double when 'MID_STABLE' then 0.010::double when 'LATE_STABLE' then 0.008::double else 0.0::double end + case when source_type = 'BOUNDARY' then 0.008::double else 0.0::double end")} as ranking_score from sc where is_valid""")
_lv = lambda c: f"round(({c}) / {P.tie_epsilon!r}::double)"
step("ra1", f"""select *, row_number() over (partition by job_id, stable_window_id order by {", ".join(_lv(c) + " desc" for c in ("ranking_score", "transition_safety_score", "visual_quality_score", "completeness_heuristic_score", "local_stability_score"))}, {_lv("abs(relative_position - 0.65::double)")}, {_lv("frame_timestamp_seconds")}, candidate_id) as rank_within_window from ra0""")
step("ra", f"""
select *, case when best < {P.min_primary_score}::double then 'NONE' when rank_within_window = 1 then 'PRIMARY' when rank_within_window <= {P.top_per_window} and ranking_score >= {P.min_alternate_score}::double then 'ALTERNATE' else 'NONE' end as selection_role, {c01("best - ranking_score")} as score_gap_from_best
from (select *, max(case when rank_within_window = 1 then ranking_score end) over (partition by job_id, stable_window_id) as best from ra1)""")
step("se", f"""
select *, primary_candidate_id is not null and second_best_score is not null and score_gap <= {P.ambiguous_gap}::double as is_ambiguous, primary_candidate_id is not null and primary_score >= 0.60::double and (second_best_score is null or score_gap > {P.ambiguous_gap * 2!r}::double) as clear_winner,
  case when primary_candidate_id is not null then {wsum(("primary_score", .7), (f"score_gap / {max(P.ambiguous_gap * 4, 1e-6)!r}::double", .3))} else 0.0::double end as selection_confidence, case when primary_candidate_id is null and valid_candidate_count = 0 then 'NO_VALID_CANDIDATES' when primary_candidate_id is null then 'ALL_CANDIDATES_BELOW_MINIMUM' end as failure_reason
from (select *, case when primary_candidate_id is not null and s2 is not null then {c01("s1 - s2")} when primary_candidate_id is not null then s1 else 0.0::double end as score_gap, case when primary_candidate_id is not null then s1 else 0.0::double end as primary_score, case when primary_candidate_id is not null then s2 end as second_best_score from (
select w.job_id, w.window_id as stable_window_id, coalesce(n, 0) as candidate_count, coalesce(m, 0) as valid_candidate_count, primary_candidate_id, s1, s2, coalesce(alt, []::bigint[]) as alternate_candidate_ids
from sw w left join (select job_id, stable_window_id as window_id, count(*) as n from ge group by 1, 2) g on w.job_id = g.job_id and w.window_id = g.window_id
left join (select job_id, stable_window_id as window_id, count(*) as m, max(case when selection_role = 'PRIMARY' then candidate_id end) as primary_candidate_id, max(case when rank_within_window = 1 then ranking_score end) as s1, max(case when rank_within_window = 2 then ranking_score end) as s2,
  list(candidate_id order by rank_within_window) filter (where selection_role = 'ALTERNATE') as alt from ra group by 1, 2) r on w.job_id = r.job_id and w.window_id = r.window_id where w.is_valid))""")
step("sest", """
select s.*, coalesce(a, 0) as mean_ranking_score, coalesce(b, 0) as median_ranking_score, coalesce(c, 0) as p90_ranking_score, ambiguous_windows / windows_considered as ambiguity_ratio from (
select job_id, count(*) as windows_considered, count(primary_candidate_id) as windows_with_primary, sum(len(alternate_candidate_ids))::bigint as alternate_candidates, count(*) filter (where is_ambiguous) as ambiguous_windows, count(*) filter (where clear_winner) as clear_winner_windows, coalesce(avg(score_gap) filter (where primary_candidate_id is not null), 0) as mean_score_gap from se group by job_id) s
left join (select job_id, avg(ranking_score) as a, quantile_cont(ranking_score, 0.5) as b, quantile_cont(ranking_score, 0.9) as c from ra group by job_id) using (job_id)""")
step("ho", "select ra.*, se.selection_confidence, se.is_ambiguous, ra.frame_timestamp_seconds as timestamp_seconds from ra join se on ra.job_id = se.job_id and ra.stable_window_id = se.stable_window_id where selection_role in ('PRIMARY', 'ALTERNATE')")
