"""Model judgments: replies parsed, candidates scored and gated, one candidate chosen for each window."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from framewright.operators.candidates import by_name
from framewright.params import DEFAULT, Params

# What the judged states are worth.
COMPLETION = {"COMPLETE": 1.0, "MOSTLY_COMPLETE": 0.8, "UNCERTAIN": 0.5, "INCOMPLETE": 0.2, "TRANSITION": 0.0}
USEFULNESS = {"HIGH": 1.0, "MEDIUM": 0.65, "LOW": 0.3, "NONE": 0.0}
SETTLED = {"SETTLED": 1.0, "MOSTLY_SETTLED": 0.75, "UNCERTAIN": 0.45, "STILL_CHANGING": 0.0}
TRANSCRIPT = {"CONSISTENT": 1.0, "PARTIALLY_CONSISTENT": 0.7, "NO_TRANSCRIPT": 0.5, "UNCERTAIN": 0.5, "UNRELATED": 0.2}

REQUIRED = ("candidate_id", "content_type", "completion_state", "completion_score", "visual_change_state", "educational_usefulness", "usefulness_score", "transition_probability", "has_meaningful_visual_content", "teacher_still_writing_likely", "transcript_visual_consistency", "confidence", "reason_codes")
ALLOWED = frozenset((*REQUIRED, "short_rationale"))


def parse_reply(text: str | None, candidate_id: int) -> tuple[str, dict | None]:
    """Status and fields of a reply: the whole text, a fenced block, or what stands between the outermost braces."""
    t = (text or "").strip()
    if not t:
        return "EMPTY_RESPONSE", None
    tries = [t]
    if m := re.fullmatch(r"```(?:json)?\s*(\{.*\})\s*```", t, re.I | re.S):
        tries.append(m[1])
    if "{" in t and t.rfind("}") > t.find("{"):
        tries.append(t[t.find("{") : t.rfind("}") + 1])
    seen_json = False
    for part in dict.fromkeys(tries):
        try:
            got = json.loads(part)
        except ValueError:
            continue
        seen_json = True
        if not isinstance(got, dict) or set(got) - ALLOWED or not set(REQUIRED) <= set(got) | {"reason_codes"}:
            continue
        unit = all(isinstance(got[k], int | float) and not isinstance(got[k], bool) and 0 <= got[k] <= 1 for k in ("completion_score", "usefulness_score", "transition_probability", "confidence"))
        known = got["completion_state"] in COMPLETION and got["educational_usefulness"] in USEFULNESS and got["visual_change_state"] in SETTLED and got["transcript_visual_consistency"] in TRANSCRIPT
        if not unit or not known or len(got.get("reason_codes") or []) > 12 or len(got.get("short_rationale") or "") > 240:
            continue
        return ("SUCCESS", got) if got["candidate_id"] == candidate_id else ("SCHEMA_ERROR", None)
    return ("SCHEMA_ERROR" if seen_json else "INVALID_JSON"), None


@F.pandas_udf(StructType().add("status", StringType()).add("reply", StringType()))
def parse_replies(text: pd.Series, candidate_id: pd.Series) -> pd.DataFrame:
    got = [parse_reply(t, int(c)) for t, c in zip(text, candidate_id, strict=True)]
    return pd.DataFrame({"status": [s for s, _ in got], "reply": [None if r is None else json.dumps(r, sort_keys=True) for _, r in got]})


def decision_score(p: Params = DEFAULT) -> Column:
    total = sum(p.decision_weights)
    terms = (by_name(F.col("completion_state"), COMPLETION), by_name(F.col("educational_usefulness"), USEFULNESS), by_name(F.col("visual_change_state"), SETTLED), F.col("confidence"), by_name(F.col("transcript_visual_consistency"), TRANSCRIPT), F.col("ranking_score"))
    s = F.lit(0.0)
    for c, w in zip(terms, p.decision_weights, strict=True):
        s = s + c * F.lit(w / total)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def decide(judged: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Score of every judged candidate and what the gates, in their order, say of it."""
    x = judged.withColumn("semantic_decision_score", decision_score(p))
    c, u = F.col("completion_state"), F.col("educational_usefulness")
    gates = [
        ((c == "TRANSITION") | (F.col("transition_probability") >= p.transition_reject), "REJECT_TRANSITION", "SEMANTIC_TRANSITION"),
        (~F.col("has_meaningful_visual_content") | (u == "NONE"), "REJECT_LOW_VALUE", "SEMANTIC_LOW_USEFULNESS"),
        (c == "INCOMPLETE", "REJECT_INCOMPLETE", "SEMANTIC_INCOMPLETE"),
        (F.col("confidence") < p.min_confidence, "REJECT_LOW_CONFIDENCE", "SEMANTIC_LOW_CONFIDENCE"),
        (F.col("semantic_decision_score") < p.min_decision_score, "REJECT_LOW_VALUE", "SEMANTIC_SCORE_BELOW_THRESHOLD"),
    ]
    what, why = F.lit("KEEP"), F.array_compact(F.array(F.when(c == "COMPLETE", "SEMANTIC_COMPLETE").when(c == "MOSTLY_COMPLETE", "SEMANTIC_MOSTLY_COMPLETE"), F.when(u == "HIGH", "SEMANTIC_HIGH_USEFULNESS")))
    for cond, decision, reason in reversed(gates):
        what, why = F.when(cond, decision).otherwise(what), F.when(cond, F.array(F.lit(reason))).otherwise(why)
    return x.withColumn("decision", what).withColumn("reason_codes", why).withColumn("eligible", F.col("decision") == "KEEP")


def window_decisions(decided: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One decision for each window: its primary against its best alternate, as columns of one row."""
    s, cid, ok = F.col("semantic_decision_score"), F.col("candidate_id"), F.col("eligible")
    primary = F.col("selection_role") == "PRIMARY"
    alt = ~primary & ok
    x = decided.groupBy("job_id", "stable_window_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.max(F.when(primary, cid)).alias("primary_candidate_id"), F.max(F.when(primary & ok, s)).alias("s1"), F.max_by(cid, F.when(alt, F.struct(s, -cid))).alias("best_alternate"), F.max(F.when(alt, s)).alias("s2"),
        F.min_by(cid, F.when(~primary, F.col("rank_within_window"))).alias("first_alternate"), F.max(F.when(ok, cid)).alias("only"), F.array_sort(F.collect_list(F.when(ok, -s))).alias("scores"),
    )
    tie = F.col("s1").isNotNull() & F.col("s2").isNotNull() & (F.abs(F.col("s1") - F.col("s2")) <= p.decision_ambiguity_gap)
    bar = F.when(tie, F.least(F.lit(1.0), F.col("s1") + p.primary_tie_bonus)).otherwise(F.col("s1")) + p.alternate_switch_margin
    stays = F.col("s1").isNotNull() & (F.col("s2").isNull() | (F.col("s2") < bar))
    one, none = F.col("n_ok") == 1, F.col("n_ok") == 0
    winner = F.when(none, F.lit(None)).when(one, F.col("only")).when(stays, F.col("primary_candidate_id")).otherwise(F.col("best_alternate"))
    x = x.withColumn("selected_candidate_id", winner).withColumn("_stays", F.coalesce(stays, F.lit(False))).withColumn("_tie", F.coalesce(tie, F.lit(False)))
    is_primary = F.coalesce(F.col("selected_candidate_id") == F.col("primary_candidate_id"), F.lit(False))
    kind = F.when(none, "REJECT_WINDOW").when(one & (F.col("n") == 1), "SELECT_SINGLE").when(is_primary, "SELECT_PRIMARY").otherwise("SELECT_ALTERNATE")
    gap = F.when(F.col("n_ok") > 1, F.col("scores")[1] - F.col("scores")[0]).otherwise(0.0)
    amb = (F.col("n_ok") > 1) & (gap <= p.decision_ambiguity_gap)
    why = F.when(none, F.array(F.when(F.col("n") > 1, "BOTH_CANDIDATES_REJECTED").otherwise("CANDIDATE_REJECTED"))).when(one, F.array(F.lit("ONLY_ELIGIBLE_CANDIDATE"))).otherwise(
        F.array_compact(F.array(F.when(F.col("_stays"), "PRIMARY_REMAINS_STRONGER").otherwise("ALTERNATE_OUTSCORES_PRIMARY"), F.when(F.col("_tie") & F.col("_stays") & F.lit(p.primary_tie_bonus > 0), "PRIMARY_TIE_BONUS"), F.when(amb, "SEMANTIC_TIE")))
    )
    alternate = F.when(F.col("n_ok") > 1, F.col("best_alternate")).otherwise(F.col("first_alternate"))
    return x.select("job_id", "stable_window_id", "primary_candidate_id", alternate.alias("alternate_candidate_id"), "selected_candidate_id", kind.alias("decision"), gap.alias("score_gap"), amb.alias("is_semantically_ambiguous"), why.alias("reason_codes"))
