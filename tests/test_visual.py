"""Change, timeline and candidates on small vectors."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import candidates, change, neighbours, stability, timeline
from framewright.params import Params
from framewright.sources.tables import keep

P = Params()
PAIR = "job_id string, previous_frame_index bigint, current_frame_index bigint, previous_timestamp_seconds double, current_timestamp_seconds double, delta_seconds double, pixel_difference double, ssim_difference double, phash_difference double, edge_difference double, difference_score double, previous_is_black boolean, current_is_black boolean, valid boolean, reason string"


def pairs(spark, jobs, delta=1.0, black=(), invalid=()):
    rows = []
    for job, scores in jobs.items():
        for i, s in enumerate(scores, 1):
            ok = i - 1 not in invalid
            v = s if ok else None
            rows.append((job, i, i + 1, (i - 1) * delta, i * delta, delta, v, v, v, v, v, False, i - 1 in black, ok, None if ok else "x"))
    return spark.createDataFrame(rows, PAIR)


def events(spark, scores, p=P, **kw):
    x = pairs(spark, {"j": scores}, **kw)
    return sorted(change.change_events(x, change.change_thresholds(x, p), p).collect(), key=lambda r: r.event_id)


def kinds(rows):
    return [r.event_type for r in rows]


@pytest.mark.parametrize(
    "scores, kw, want",
    [
        ([0.01, 0.02, 0.01, 0.03, 0.02] * 10, {}, []),
        ([0.03] * 30 + [0.82] + [0.04] * 20, {}, [0.82]),
        ([0.03] * 20 + [0.72, 0.88, 0.69] + [0.03] * 20, {}, [0.88]),
        ([0.9 if i == 10 else 0.95 if i == 40 else 0.03 for i in range(50)], {}, [0.9, 0.95]),
    ],
)
def test_visual_events(spark, scores, kw, want):
    got = events(spark, scores, **kw)
    assert [pytest.approx(r.difference_score) for r in got] == want
    assert [r.event_id for r in got] == list(range(1, len(got) + 1))


def test_black_and_invalid_events(spark):
    assert kinds(events(spark, [0.1, 0.7, 0.8, 0.6, 0.1], black=(2, 3))).count("BLACK_TRANSITION") == 1
    gap = [r for r in events(spark, [0.02] * 3, invalid=(1,)) if r.event_type == "INVALID_GAP"]
    assert len(gap) == 1 and gap[0].confidence == 0 and gap[0].threshold is None


def test_noisy_jobs_have_higher_thresholds_and_jobs_do_not_mix(spark):
    x = pairs(spark, {"noisy": [0.15, 0.22, 0.31, 0.42, 0.48] * 20, "quiet": [0.01, 0.02, 0.03] * 30})
    t = {r.job_id: r.major_threshold for r in change.change_thresholds(x, P).collect()}
    assert t["noisy"] > t["quiet"] == pytest.approx(0.3)


def test_no_scores_at_all(spark):
    x = pairs(spark, {"j": [0.1, 0.1]}, invalid=(0, 1))
    t = change.change_thresholds(x, P).first()
    assert (t.median_score, t.major_threshold, t.very_major_threshold) == (0.0, 0.3, 0.6)
    d = change.score_distribution(x).first()
    assert (d.total_comparisons, d.valid_comparisons, d.p99) == (2, 0, 0.0)


def segments(spark, scores, p=P, major=0.5, event=None, **kw):
    x = pairs(spark, {"j": scores}, **kw)
    t = keep(change.change_thresholds(x, p).withColumn("major_threshold", F.lit(major)))
    n = change.scored(x).groupBy("job_id").agg(F.count("*").alias("n"))
    e = change.change_events(x, t, p) if event is None else spark.createDataFrame([event], "job_id string, event_type string, start_timestamp_seconds double, end_timestamp_seconds double, timestamp_seconds double")
    e, lim = keep(e), keep(timeline.timeline_thresholds(t, n, p))
    s = timeline.timeline_segments(timeline.pair_states(x, e, lim, p), p)
    return sorted(s.collect(), key=lambda r: r.segment_id)


NONE = ("other", "MAJOR_VISUAL_CHANGE", 0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "scores, change_, want",
    [
        ([0.01] * 10, {}, ["STABLE"]),
        ([0.15] * 10, {}, ["CHANGING"]),
        ([0.01, 0.01, 0.12, 0.01, 0.01], {"max_stable_gap": 1.1}, ["STABLE"]),
        ([0.01, 0.2, 0.2], {"min_stable_duration": 2.0}, ["CHANGING"]),
    ],
)
def test_segments(spark, scores, change_, want):
    got = segments(spark, scores, Params(**change_), event=NONE)
    assert [r.state for r in got] == want
    assert got[0].start_timestamp_seconds == 0 and got[-1].end_timestamp_seconds == len(scores)


def test_strong_short_change_stays_and_major_event_splits(spark):
    assert "CHANGING" in [r.state for r in segments(spark, [0.01, 0.01, 0.45, 0.01, 0.01], Params(max_stable_gap=2.0), event=NONE)]
    got = segments(spark, [0.01] * 5, event=("j", "MAJOR_VISUAL_CHANGE", 2.0, 3.0, 3.0))
    assert [r.state for r in got] == ["STABLE", "MAJOR_TRANSITION", "STABLE"]
    assert sum(r.duration_seconds for r in segments(spark, [0.01] * 4, delta=0.5, event=NONE)) == 2.0


def test_hysteresis_against_a_loop(spark):
    r = random.Random(3)
    jobs = {f"j{k}": [round(r.random() * 0.3, 3) for _ in range(60)] for k in range(12)}
    x = pairs(spark, jobs)
    lim = spark.createDataFrame([(j, 0.1, 0.16, 0.9) for j in jobs], "job_id string, enter_stable_threshold double, exit_stable_threshold double, major_threshold double")
    e = spark.createDataFrame([NONE], "job_id string, event_type string, start_timestamp_seconds double, end_timestamp_seconds double, timestamp_seconds double")
    got = {(s.job_id, s.current_frame_index): s.state for s in timeline.pair_states(x, e, lim, P).collect()}
    for j, scores in jobs.items():
        stable = False
        for i, s in enumerate(scores, 1):
            stable = s <= (0.16 if stable else 0.1)
            assert got[(j, i + 1)] == ("STABLE" if stable else "CHANGING")


@pytest.fixture(scope="module")
def standard(spark):
    """Changing 0-8 s, stable 8-16 s, changing 16-20 s, a frame a second."""
    scores = [0.18] * 8 + [0.02] * 8 + [0.18] * 4
    x = pairs(spark, {"j": scores})
    frames = spark.createDataFrame([("j", i + 1, float(i), f"f{i}", f"p{i}", True, False, False, False, 0.8, 120.0, 0.5, 0.3, 0.05, 0.5, i / 40) for i in range(21)], "job_id string, index bigint, timestamp_seconds double, source_path string, processed_path string, is_valid boolean, is_black boolean, is_blurry boolean, is_low_information boolean, quality_score double, sharpness_score double, brightness double, contrast double, edge_density double, entropy double, level double")
    t = keep(change.change_thresholds(x, P))
    e = keep(change.change_events(x, t, P))
    n = change.scored(x).groupBy("job_id").agg(F.count("*").alias("n"))
    lim = keep(timeline.timeline_thresholds(t, n, P).withColumns({"enter_stable_threshold": F.lit(0.03), "exit_stable_threshold": F.lit(0.05)}))
    seg = keep(timeline.timeline_segments(timeline.pair_states(x, e, lim, P), P))
    w = keep(stability.stability_windows(seg, x, frames, e, lim, P))
    b = keep(stability.boundaries(w, x, lim, P))
    c = keep(candidates.generate(w, b, frames, P))
    s = keep(candidates.score(c, x, lim, P))
    r = keep(candidates.rank(s, P))
    return {"pairs": x, "frames": frames, "segments": seg, "windows": w, "boundaries": b, "candidates": c, "scores": s, "ranked": r, "selected": candidates.selections(w, c, r, P)}


def test_standard_job(standard):
    w = standard["windows"].collect()
    assert len(w) == 1 and w[0].is_valid and (w[0].start_seconds, w[0].end_seconds) == (8.0, 16.0)
    b = standard["boundaries"].first()
    assert b.boundary_type == "CHANGING_TO_STABLE" and b.is_valid and b.activity_drop_score > 0.1
    c = [x for x in standard["candidates"].collect() if x.is_valid]
    assert {x.candidate_type for x in c} == {"SETTLED_START", "MID_STABLE", "PRE_EXIT"}
    assert all(8 <= x.frame_timestamp_seconds <= 16 for x in c)
    r = standard["ranked"].collect()
    assert sorted(x.rank_within_window for x in r) == list(range(1, len(r) + 1))
    assert sum(x.selection_role == "PRIMARY" for x in r) == 1
    s = standard["selected"].first()
    assert s.primary_candidate_id is not None and 0 <= s.selection_confidence <= 1


def test_exact_comparator_agrees_when_no_scores_are_near(standard):
    exact = candidates.rank(standard["scores"], P, exact=True)
    key = lambda d: sorted((x.candidate_id, x.rank_within_window) for x in d.collect())
    assert key(exact) == key(standard["ranked"])


def test_neighbours_lie_on_both_sides(standard):
    h = candidates.handoff(standard["selected"], standard["ranked"]).select("job_id", "candidate_id", "timestamp_seconds", "frame_index", F.lit(0.9).alias("level"), F.lit(8.0).alias("boundary_seconds"), F.lit(8.0).alias("window_start"), F.lit(16.0).alias("window_end"))
    got = neighbours.choose(h, standard["frames"], standard["segments"], P).collect()
    at = {x.candidate_id: x.timestamp_seconds for x in h.collect()}
    assert got and all((x.frame_seconds < at[x.candidate_id]) == (x.role == "PREVIOUS") for x in got)
    assert all(abs(x.frame_seconds - at[x.candidate_id]) >= 1.5 for x in got)


def test_metric_weights(spark):
    x = pairs(spark, {"j": [0.5]}).withColumns({"pixel_difference": F.lit(0.2), "ssim_difference": F.lit(0.4), "phash_difference": F.lit(0.1), "edge_difference": F.lit(0.3)})
    assert change.score_pairs(x, P).first().difference_score == pytest.approx(0.27)
    with pytest.raises(ValueError):
        Params(very_major_min_score=0.1)
