"""Evaluation: predictions matched to true states in time, quality figures, losses by stage, and comparisons of runs."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import ratio, reasons, round_even
from framewright.operators.ranges import points_in

STAGES = ("CANDIDATE", "SEMANTIC", "FINAL_SCREENSHOT", "DOCUMENT")


class Free:
    """Predictions of a sample in the order of time and id, those in use taken out; neighbours are found by path halving."""

    def __init__(self, predictions: list[dict]):
        self.rows = sorted(predictions, key=lambda q: (q["timestamp_seconds"], q["prediction_id"]))
        self.times = [q["timestamp_seconds"] for q in self.rows]
        self.right, self.left = list(range(len(self.rows) + 1)), list(range(len(self.rows) + 1))

    def _walk(self, to: list[int], i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    def after(self, i: int) -> int:
        """The first free one from place i on."""
        return self._walk(self.right, i)

    def before(self, i: int) -> int:
        """The last free one before place i, or -1."""
        return self._walk(self.left, i) - 1

    def take(self, i: int) -> None:
        self.right[i], self.left[i + 1] = i + 1, i

    def nearest(self, target: float, lo: float, hi: float) -> int | None:
        """The free one within [lo, hi] that is nearest to the target; of equally near ones the earlier, then the smaller id."""
        first, end = bisect_left(self.times, lo), bisect_right(self.times, hi)
        at = min(max(bisect_left(self.times, target), first), end)
        found = []
        if (i := self.before(at)) >= first:
            found.append(self.after(max(first, bisect_left(self.times, self.times[i]))))  # the smallest id of that time
        if (i := self.after(at)) < end:
            found.append(i)
        return min(found, key=lambda i: (abs(self.times[i] - target), self.times[i], i), default=None)


def match_sample(states: list[dict], predictions: list[dict]) -> tuple[list[tuple], list, list]:
    """Matches (state, prediction, error), unmatched predictions, and missed required states.

    States go by target time; each takes the nearest unused prediction within its interval.  A group is satisfied once.
    """
    free = Free(predictions)
    used: set[int] = set()
    matched, met, groups = [], set(), set()
    for s in sorted((s for s in states if s["importance"] in ("REQUIRED", "OPTIONAL")), key=lambda s: (s["target_timestamp_seconds"], s["state_id"])):
        group = s.get("acceptable_equivalence_group") or s.get("duplicate_group")
        if group and group in groups:
            met.add(s["state_id"])
            continue
        best = free.nearest(s["target_timestamp_seconds"], s["acceptable_start_seconds"], s["acceptable_end_seconds"])
        if best is None:
            continue
        free.take(best)
        used.add(best)
        met.add(s["state_id"])
        groups |= {group} if group else set()
        matched.append((s["state_id"], free.rows[best]["prediction_id"], abs(free.times[best] - s["target_timestamp_seconds"])))
    missed = sorted(s["state_id"] for s in states if s["importance"] == "REQUIRED" and s["state_id"] not in met)
    return matched, sorted(q["prediction_id"] for i, q in enumerate(free.rows) if i not in used), missed


def temporal_match(states: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, level, kind, state_id, prediction_id, error) with kind MATCH, FALSE_POSITIVE or FALSE_NEGATIVE.

    Greedy over one sample and level, which is a bounded group: every state's choice depends on those before it.
    """
    levels = predictions.select(F.col("sample_id").alias("sample_id"), F.col("level").alias("level")).distinct()  # new columns: both sides are cogrouped
    s = states.join(levels, "sample_id")
    schema = "sample_id string, level string, kind string, state_id string, prediction_id string, error double"

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        clean = lambda d: [{k: None if v is None or v != v else v for k, v in r.items()} for r in d.to_dict("records")]
        got, extra, missed = match_sample(clean(left), clean(right))
        rows = [(*key, "MATCH", a, b, e) for a, b, e in got] + [(*key, "FALSE_POSITIVE", None, q, None) for q in extra] + [(*key, "FALSE_NEGATIVE", m, None, None) for m in missed]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return s.groupBy("sample_id", "level").cogroup(predictions.groupBy("sample_id", "level")).applyInPandas(one, schema)


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))


def summarize(matches: DataFrame, states: DataFrame, predictions: DataFrame, negatives: DataFrame, bucket_seconds: float = 600.0) -> DataFrame:
    """Figures of each sample and level, to six decimals; ``bucket_seconds`` is best about as long as a negative interval."""
    n = lambda k: F.count_if(F.col("kind") == k)
    m = matches.groupBy("sample_id", "level").agg(n("MATCH").alias("tp"), n("FALSE_POSITIVE").alias("fp"), n("FALSE_NEGATIVE").alias("fn"), F.avg("error").alias("e_mean"), F.percentile("error", F.array(F.lit(0.5), F.lit(0.9))).alias("e"), F.max("error").alias("e_max"))
    need = states.where("importance = 'REQUIRED'").select("sample_id", "state_id")
    found = matches.where("kind = 'MATCH'").join(need, ["sample_id", "state_id"]).groupBy("sample_id", "level").agg(F.countDistinct("state_id").alias("met"))
    total = need.groupBy("sample_id").agg(F.countDistinct("state_id").alias("required"))
    spans = negatives.select("sample_id", F.col("start_seconds").alias("_lo"), F.col("end_seconds").alias("_hi"))
    marked = predictions.withColumn("_row", F.monotonically_increasing_id())
    inside = F.col("timestamp_seconds").between(F.col("_lo"), F.col("_hi"))
    bad = points_in(marked, spans, "sample_id", "timestamp_seconds", F.col("_lo"), F.col("_hi"), bucket_seconds, inside)
    hits = bad.groupBy("sample_id", "level").agg(F.countDistinct("_row").alias("hits"))
    count = predictions.groupBy("sample_id", "level").agg(F.count("*").alias("n"))
    key = ["sample_id", "level"]
    x = m.join(found, key, "left").join(hits, key, "left").join(count, key, "left").join(total, "sample_id", "left").na.fill(0, ["met", "hits", "n", "required"])
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return x.select(
        *key, "tp", "fp", "fn", round_even(p, 6).alias("precision"), round_even(r, 6).alias("recall"), round_even(f1(p, r), 6).alias("f1"), round_even(ratio("met", "required"), 6).alias("required_state_recall"), round_even(ratio("hits", "n"), 6).alias("negative_state_violation_rate"),
        round_even("e_mean", 6).alias("timestamp_error_mean"), round_even(F.col("e")[0], 6).alias("timestamp_error_median"), round_even(F.col("e")[1], 6).alias("timestamp_error_p90"), round_even("e_max", 6).alias("timestamp_error_max"),
    )


def aggregate(summary: DataFrame, *by: str) -> DataFrame:
    """Counts added up (micro), recall of required states and violations averaged (macro)."""
    g = summary.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[round_even(F.avg(c), 6).alias(c) for c in ("required_state_recall", "negative_state_violation_rate")])
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return g.withColumns({"precision": round_even(p, 6), "recall": round_even(r, 6), "f1": round_even(f1(p, r), 6)})


def by_member(summary: DataFrame, samples: DataFrame, what: str) -> DataFrame:
    """The same for each category or tag; a sample counts in each that it has."""
    name = {"categories": "category", "tags": "tag"}[what]
    return aggregate(summary.join(samples.select("sample_id", F.explode(F.array_distinct(what)).alias(name)), "sample_id"), name, "level")


def loss_funnel(matches: DataFrame, states: DataFrame) -> DataFrame:
    """For every required state where it was found, and the first stage that lost it."""
    found = matches.where("kind = 'MATCH'").groupBy("sample_id", "state_id").pivot("level", list(STAGES)).agg(F.lit(True))
    x = states.where("importance = 'REQUIRED'").select("sample_id", "state_id").join(found, ["sample_id", "state_id"], "left").na.fill(False, list(STAGES))
    lost = F.lit(None).cast("string")
    for stage, name in reversed(list(zip(STAGES, ("CANDIDATE_MISS", "SEMANTIC_FALSE_REJECTION", "PHASE7_LOSS", "DOCUMENT_LOSS"), strict=True))):
        lost = F.when(~F.col(stage), name).otherwise(lost)
    return x.withColumn("earliest_loss_stage", lost)


def calibration_gate(pairs: DataFrame, min_delta: float = 0.0025, max_precision_loss: float = 0.01) -> DataFrame:
    """ACCEPT, REJECT or MANUAL_REVIEW of candidate against baseline figures (base_*, cand_*), new misses and failures."""
    d = {k: F.col(f"cand_{k}") - F.col(f"base_{k}") for k in ("recall", "precision", "f1")}
    safe = (F.col("new_required_misses") == 0) & (F.col("new_critical_failures") == 0)
    good = ((d["recall"] >= min_delta) | (d["f1"] >= min_delta)) & (d["precision"] >= -max_precision_loss) & safe
    return pairs.withColumns({f"{k}_delta": round_even(c, 6) for k, c in d.items()}).withColumn("recommendation", F.when(good, "ACCEPT").when(~safe, "REJECT").otherwise("MANUAL_REVIEW"))


def performance_gate(pairs: DataFrame, min_gain: float = 0.03, max_memory: float = 0.20, max_disk: float = 0.20) -> DataFrame:
    """Runtime, peak memory and disk of a candidate run against a baseline (base_*, cand_*), with a verdict."""
    rel = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.try_divide(F.col(a) - F.col(b), F.col(b).cast("double")))
    gain, mem, disk = -rel("cand_runtime", "base_runtime"), rel("cand_peak", "base_peak"), rel("cand_disk", "base_disk")
    x = pairs.withColumns({"runtime_improvement_ratio": round_even(gain, 6), "memory_regression_ratio": round_even(mem, 6), "disk_regression_ratio": round_even(disk, 6)})
    return x.withColumn("accepted", (gain >= min_gain) & (mem <= max_memory) & (disk <= max_disk))


def limit_status(observed: DataFrame, limits: dict[str, tuple[float, bool]]) -> DataFrame:
    """PASS, PASS_WITH_WARNINGS or LIMIT_EXCEEDED by limits {column: (limit, hard)}; unknown values are not judged."""
    over = {c: F.coalesce(F.col(c) > F.lit(v), F.lit(False)) for c, (v, _) in limits.items()}
    hard = [over[c] for c, (_, h) in limits.items() if h]
    soft = reasons(*[(over[c], f"{c.upper()}_EXCEEDED") for c, (_, h) in limits.items() if not h])
    fails = reasons(*[(over[c], c.upper()) for c, (_, h) in limits.items() if h])
    x = observed.withColumn("failed_limits", fails if hard else F.array().cast("array<string>")).withColumn("warnings", soft)
    return x.withColumn("status", F.when(F.size("failed_limits") > 0, "LIMIT_EXCEEDED").when(F.size("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


def scaling_class(input_scale: Column, observed_scale: Column) -> Column:
    r = F.try_divide(observed_scale, input_scale)
    return F.when(input_scale <= 1, "UNKNOWN").when(r < 0.75, "SUBLINEAR").when(r <= 1.35, "APPROX_LINEAR").when(r <= 2.5, "SUPERLINEAR").otherwise("EXPLOSIVE")


def possible_leak(samples: DataFrame, min_points: int = 5) -> DataFrame:
    """Series (run_id, k, value) that rise nearly always and by over a fifth."""
    w = Window.partitionBy("run_id").orderBy("k")
    x = samples.withColumn("_up", (F.col("value") > F.lag("value").over(w)).cast("int"))
    g = x.groupBy("run_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("_up"), F.lit(0)).alias("rises"), F.min_by("value", "k").alias("a"), F.max_by("value", "k").alias("z"))
    leak = (F.col("n") >= min_points) & (F.col("rises") >= F.col("n") - 2) & (F.col("z") - F.col("a") > F.greatest(F.lit(1.0), F.abs("a") * 0.20))
    return g.select("run_id", leak.alias("possible_leak"))


def release_readiness(gates: DataFrame) -> DataFrame:
    """READY, READY_WITH_WARNINGS or NOT_READY of each release from gates (release, gate_id, required, ok)."""
    g = gates.groupBy("release").agg(F.count_if(F.col("required") & ~F.col("ok")).alias("failed"), F.count_if(~F.col("required") & ~F.col("ok")).alias("warned"))
    return g.withColumn("readiness", F.when(F.col("failed") > 0, "NOT_READY").when(F.col("warned") > 0, "READY_WITH_WARNINGS").otherwise("READY"))


def local_sweep(parameters: DataFrame, radius: int = 2) -> DataFrame:
    """The values to try around each parameter (current_value, step, min_value, max_value, is_integer): steps to either side, within its range, each once."""
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    at = F.transform(offsets, lambda k: F.greatest(F.col("min_value"), F.least(F.col("max_value"), F.col("current_value") + F.col("step") * k)))
    whole = F.transform(at, lambda v: F.when(F.col("is_integer"), F.bround(v, 0)).otherwise(F.bround(v, 8)))
    return parameters.withColumn("values", F.array_distinct(whole))


def reviewed(annotations: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Annotations whose review_status is among the allowed ones, and the sample ids of the others (an error where reviews are strict)."""
    ok = F.coalesce(F.col("review_status").isin(*allowed), F.lit(False))
    return annotations.where(ok), annotations.where(~ok).select("sample_id")


def dataset_findings(samples: DataFrame, annotations: DataFrame, media: DataFrame, require_media: bool = False) -> DataFrame:
    """(sample_id, severity, code): annotations that are missing or of another sample, media that are named but missing or empty."""
    a = annotations.select("annotation_path", F.col("sample_id").alias("_annotated"))
    m = media.select(F.col("path").alias("media_path"), F.col("length").alias("_length"))
    x = samples.join(a, "annotation_path", "left").join(m, "media_path", "left")
    named = F.col("media_path").isNotNull()
    lost = named & (F.col("_length").isNull() | (F.col("_length") <= 0 if require_media else F.lit(False)))
    found = F.array_compact(F.array(
        F.when(F.col("_annotated").isNull(), F.struct(F.lit("ERROR").alias("severity"), F.lit("ANNOTATION_MISSING").alias("code"))),
        F.when(F.col("_annotated") != F.col("sample_id"), F.struct(F.lit("ERROR").alias("severity"), F.lit("ANNOTATION_SAMPLE_MISMATCH").alias("code"))),
        F.when(lost, F.struct(F.lit("ERROR" if require_media else "WARNING").alias("severity"), F.lit("MEDIA_MISSING").alias("code"))),
    ))
    return x.select("sample_id", F.inline(found))
