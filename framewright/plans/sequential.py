"""SQL of the greedy rules: a recursive query or a fold takes one step after the other, with what is used so far in a list."""

from __future__ import annotations

from framewright.operators.evaluation import STAGES
from framewright.params import DEFAULT as P
from framewright.plans.oracle import STEPS, chain, step
from framewright.queries import ORACLE_SQL


def recursive(final: str, name: str) -> str:
    """A chain in which the named step is recursive; steps that read it are defined after it."""
    out = chain(final)
    return out.replace("with ", "with recursive ", 1).replace(f"{name} as materialized (", f"{name} as (", 1)


# -- predictions matched to states in time ---------------------------------------------------------------------------------
step("gev", "select cast(user_id as varchar) as sample_id, event_id, event_type, epoch_us(ts) / 1e6::double as t from events")
step("gst", "select sample_id, cast(event_id as varchar) as state_id, t, t - 3600.0::double as lo, t + 3600.0::double as hi, event_id % 2 = 1 as needed, row_number() over (partition by sample_id order by t, cast(event_id as varchar)) as k from gev where event_type = 'purchase'")
_rules = (("CANDIDATE", "true"), ("SEMANTIC", "event_id % 3 <> 0"), ("FINAL_SCREENSHOT", "event_id % 5 < 3"))
step("gpr", " union all ".join(f"select sample_id, '{level}' as level, cast(event_id as varchar) as prediction_id, t from gev where event_type = 'click' and {rule}" for level, rule in _rules))
step("gpl", "select sample_id, level, list({'t': t, 'id': prediction_id}) as free from gpr group by 1, 2")
STEP = """select sample_id, level, 0::bigint as k, []::varchar[] as used, null::varchar as state_id, null::varchar as prediction_id, null::double as error from gpl
union all select sample_id, level, k, case when best.id is not null then list_append(used, best.id) else used end, state_id, best.id, best.e from (
  select m.sample_id, m.level, m.k + 1 as k, m.used, s.state_id, list_sort(list_transform(list_filter(p.free, lambda x: x.t >= s.lo and x.t <= s.hi and not list_contains(m.used, x.id)), lambda x: {'e': abs(x.t - s.t), 't': x.t, 'id': x.id}))[1] as best
  from gmt m join gst s on s.sample_id = m.sample_id and s.k = m.k + 1 join gpl p on p.sample_id = m.sample_id and p.level = m.level)"""
step("gmt", STEP)
MATCHES = """select sample_id, level, 'MATCH' as kind, state_id, prediction_id, error from gmt where prediction_id is not null
union all select p.sample_id, p.level, 'FALSE_POSITIVE', null, p.prediction_id, null from gpr p anti join gmt m on m.sample_id = p.sample_id and m.level = p.level and m.prediction_id = p.prediction_id
union all select l.sample_id, l.level, 'FALSE_NEGATIVE', s.state_id, null, null from gpl l join gst s on s.sample_id = l.sample_id anti join (select * from gmt where prediction_id is not null) m on m.sample_id = l.sample_id and m.level = l.level and m.state_id = s.state_id where s.needed"""
step("gall", MATCHES)
ORACLE_SQL["temporal_match"] = recursive("select * from gall", "gmt")

_div = lambda a, b: f"coalesce(({a}) / nullif(({b})::double, 0), 0.0::double)"
_six = lambda x, n: f"round_even({x}, 6) as {n}"
step("gsum0", """select sample_id, level, count(*) filter (where kind = 'MATCH') as tp, count(*) filter (where kind = 'FALSE_POSITIVE') as fp, count(*) filter (where kind = 'FALSE_NEGATIVE') as fn, avg(error) as e1, quantile_cont(error, 0.5) as e2, quantile_cont(error, 0.9) as e3, max(error) as e4,
  count(distinct state_id) filter (where kind = 'MATCH' and state_id in (select state_id from gst where needed)) as met from gall group by 1, 2""")
step("gneg", "select sample_id, t - 600.0::double as lo, t + 600.0::double as hi from gev where event_type = 'error'")
step("ghit", "select p.sample_id, p.level, count(*) as n, count(*) filter (where exists (select 1 from gneg where gneg.sample_id = p.sample_id and p.t between gneg.lo and gneg.hi)) as hits from gpr p group by 1, 2")
step("gsum1", f"select s.*, h.n, h.hits, coalesce(r.required, 0) as required, {_div('tp', 'tp + fp')} as p, {_div('tp', 'tp + fn')} as r from gsum0 s join ghit h on h.sample_id = s.sample_id and h.level = s.level left join (select sample_id, count(distinct state_id) as required from gst where needed group by 1) r on r.sample_id = s.sample_id")
step("gsum", f"""select sample_id, level, tp, fp, fn, {_six('p', 'precision')}, {_six('r', 'recall')}, {_six(_div('2.0::double * p * r', 'p + r'), 'f1')}, {_six(_div('met', 'required'), 'required_state_recall')}, {_six(_div('hits', 'n'), 'negative_state_violation_rate')},
  {_six('e1', 'timestamp_error_mean')}, {_six('e2', 'timestamp_error_median')}, {_six('e3', 'timestamp_error_p90')}, {_six('e4', 'timestamp_error_max')} from gsum1""")
ORACLE_SQL["metric_summary"] = recursive("select * from gsum", "gmt")
step("gmic", f"select level, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, {_six('avg(required_state_recall)', 'required_state_recall')}, {_six('avg(negative_state_violation_rate)', 'negative_state_violation_rate')} from gsum group by 1")
step("gmic1", f"select *, {_div('tp', 'tp + fp')} as p, {_div('tp', 'tp + fn')} as r from gmic")
ORACLE_SQL["metrics_micro_macro"] = recursive(f"select * exclude (p, r), {_six('p', 'precision')}, {_six('r', 'recall')}, {_six(_div('2.0::double * p * r', 'p + r'), 'f1')} from gmic1", "gmt")
_found = ", ".join(f"bool_or(coalesce(m.level = '{s}', false)) as \"{s}\"" for s in STAGES)
_lost = " ".join(f"when not \"{s}\" then '{n}'" for s, n in zip(STAGES, ("CANDIDATE_MISS", "SEMANTIC_FALSE_REJECTION", "PHASE7_LOSS", "DOCUMENT_LOSS"), strict=True))
ORACLE_SQL["loss_funnel"] = recursive(f"select *, case {_lost} end as earliest_loss_stage from (select s.sample_id, s.state_id, {_found} from gst s left join (select * from gmt where prediction_id is not null) m on m.sample_id = s.sample_id and m.state_id = s.state_id where s.needed group by 1, 2)", "gmt")

# -- groups by complete linkage --------------------------------------------------------------------------------------------
step("gme", "select job_id, candidate_id, row_number() over (partition by job_id order by selected_timestamp_seconds, candidate_id) as k from fp")
step("gdu", "select job_id, c as candidate_id, list(o) as dups from (select job_id, a as c, b as o from ps where decision = 'DUPLICATE' union all select job_id, b, a from ps where decision = 'DUPLICATE') group by 1, 2")
LINK = """select job_id, 0::bigint as k, []::bigint[][] as groups from (select distinct job_id from fp)
union all select job_id, k, case when spot is null then list_append(groups, [candidate_id]) else list_transform(groups, lambda g, i: case when i = spot then list_append(g, candidate_id) else g end) end from (
  select g.job_id, g.k + 1 as k, g.groups, m.candidate_id, list_filter(range(1, len(g.groups) + 1), lambda i: list_has_all(coalesce(d.dups, []::bigint[]), g.groups[i]))[1] as spot
  from glk g join gme m on m.job_id = g.job_id and m.k = g.k + 1 left join gdu d on d.job_id = m.job_id and d.candidate_id = m.candidate_id)"""
step("glk", LINK)
ORACLE_SQL["duplicate_groups"] = recursive("""select job_id, unnest(g) as candidate_id, 'dup_' || substr(sha256('[' || array_to_string(g, ',') || ']'), 1, 12) as group_id, g[1] as representative_candidate_id, len(g)::int as group_size
from (select job_id, unnest(groups) as g from (select job_id, arg_max(groups, k) as groups from glk group by 1))""", "glk")

# -- what is said around a moment, within a budget -------------------------------------------------------------------------
step("xmet", f"""select *, case when end_seconds <= t then 'before' when start_seconds >= t then 'after' else 'current' end as part from (select tm.job_id, tm.candidate_id, timestamp_seconds as t, greatest(0.0::double, timestamp_seconds - {P.context_before}::double) as lo, timestamp_seconds + {P.context_after}::double as hi, segment_id, start_seconds, end_seconds, trim(text) as said
  from tm join ts on ts.job_id = tm.job_id and end_seconds >= greatest(0.0::double, timestamp_seconds - {P.context_before}::double) and start_seconds <= timestamp_seconds + {P.context_after}::double)""")
step("xcut", f"select *, case part when 'before' then start_seconds < lo - {P.context_extension}::double when 'after' then end_seconds > hi + {P.context_extension}::double else false end as far, length(said) as c, len(list_filter(string_split_regex(said, '\\s+'), lambda x: x <> '')) as w from xmet")
step("xitm", """select *, case when part = 'before' then 0 else 1 end as side, row_number() over (partition by job_id, candidate_id, part, far order by case when part = 'before' then -start_seconds else start_seconds end, case when part = 'before' then -segment_id else segment_id end) as k from xcut""")
step("xgrp", """select job_id, candidate_id, list({'c': c::bigint, 'w': w::bigint, 'ids': [segment_id]} order by k) filter (where part = 'current') as cur, list({'c': c::bigint, 'w': w::bigint, 'ids': [segment_id]} order by k, side, segment_id) filter (where part <> 'current' and not far) as rest,
  coalesce(list(segment_id) filter (where part = 'before' and not far), []::bigint[]) as b, coalesce(list(segment_id) filter (where part = 'after' and not far), []::bigint[]) as f, bool_or(far and part = 'before') as tb, bool_or(far and part = 'after') as ta from xitm group by 1, 2""")
_empty = "{'c': 0::bigint, 'w': 0::bigint, 'ids': []::bigint[]}"
_more = "{'c': a.c + x.c + case when a.c > 0 then 1 else 0 end, 'w': a.w + x.w, 'ids': list_concat(a.ids, x.ids)}"
step("xone", f"select *, list_reduce(coalesce(cur, []), lambda a, x: {_more}, {_empty}) as head from xgrp")
_fits = f"a.c + x.c + case when a.c > 0 then 1 else 0 end <= {P.context_max_characters} and a.w + x.w <= {P.context_max_words}"
step("xend", f"select *, head.c > {P.context_max_characters} or head.w > {P.context_max_words} as crowded, case when head.c > {P.context_max_characters} or head.w > {P.context_max_words} then head else list_reduce(coalesce(rest, []), lambda a, x: case when {_fits} then {_more} else a end, head) end as held from xone")
_ids = lambda c: f"list_sort(list_filter({c}, lambda x: list_contains(held.ids, x)))"
_none = "[]::bigint[]"
step("xctx", f"""select tm.job_id, tm.candidate_id, coalesce(head.ids, {_none}) as current_segment_ids, coalesce({_ids('b')}, {_none}) as before_segment_ids, coalesce({_ids('f')}, {_none}) as after_segment_ids, coalesce(crowded, false) as context_over_budget_due_to_current,
  coalesce(tb or len({_ids('b')}) < len(b), false) as truncated_before, coalesce(ta or len({_ids('f')}) < len(f), false) as truncated_after, coalesce(held.c, 0) as characters, coalesce(held.w, 0) as words, coalesce(held.w, 0) < {P.context_sparse_words} as is_sparse_context
  from tm left join xend x on x.job_id = tm.job_id and x.candidate_id = tm.candidate_id""")
ORACLE_SQL["context_budget"] = chain("select * from xctx")

__all__ = ["ORACLE_SQL", "STEPS"]
