"""Transcripts, judgments, screenshots, evaluation, sources, texts."""

import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import kernels
from framewright.functions import text as T
from framewright.operators import documents, evaluation, jobs, lineage, screenshots, semantic, transcript
from framewright.params import Params
from framewright.sources import media

P = Params()
RAW = "job_id string, segment_id string, chunk_id bigint, source_ordinal bigint, absolute_start_seconds double, absolute_end_seconds double, text string, avg_logprob double, no_speech_prob double, is_within_logical_range boolean"


def test_transcript_dedup_and_merge(spark):
    rows = [
        ("j", "1:0", 1, 0, 0.0, 3.0, "Kafka stores  events", -0.2, 0.01, True),
        ("j", "1:1", 1, 1, 9.0, 12.0, "and the broker sends them on", -0.4, 0.02, False),
        ("j", "2:0", 2, 0, 9.2, 12.0, "And the broker sends them on.", -0.3, 0.02, True),
        ("j", "2:1", 2, 1, 12.5, 14.0, "Über Größe", None, None, True),
        ("j", "2:2", 2, 2, 40.0, 41.0, "   ", None, None, True),
        ("k", "1:0", 1, 0, 0.0, 1.0, "other job", None, None, True),
    ]
    got = sorted((r for r in transcript.normalize(spark.createDataFrame(rows, RAW), P).collect() if r.job_id == "j"), key=lambda r: r.segment_id)
    assert [r.text for r in got] == ["Kafka stores events", "And the broker sends them on. Über Größe"]
    assert set(got[1].source_segment_ids) == {"2:0", "1:1", "2:1"}
    assert set(got[1].normalization_flags) == {"DEDUPLICATED_OVERLAP", "MERGED_ADJACENT"}
    assert got[0].normalization_flags == ["TRIMMED_WHITESPACE"] and got[1].word_count == 8


def test_long_segments_split_between_words():
    words = [{"word": f" w{i}", "start_seconds": 5.0 * i, "end_seconds": 5.0 * i + 4} for i in range(10)]
    item = {"start": 0.0, "end": 49.0, "text": "x", "ids": ["1:0"], "chunks": [1], "logprob": None, "silence": None, "words": words, "flags": set()}
    got = transcript.split_long(item, P)
    assert [s["text"] for s in got] == ["w0 w1 w2 w3", "w4 w5 w6 w7", "w8 w9"] and all(s["end"] - s["start"] <= 20 for s in got)
    assert transcript.split_long({**item, "words": [], "flags": set()}, P)[0]["flags"] == {"LONG_SEGMENT_PRESERVED"}


def test_chunks_and_counts(spark):
    c = transcript.chunk_plan(spark.createDataFrame([("j", 14.0)], "job_id string, duration_seconds double"), Params(chunk_seconds=6.0, chunk_overlap=1.0))
    got = sorted(c.collect(), key=lambda r: r.chunk_id)
    assert [(r.logical_start_seconds, r.logical_end_seconds, r.decode_start_seconds, r.decode_end_seconds) for r in got] == [(0, 6, 0, 7), (6, 12, 5, 13), (12, 14, 11, 14)]
    m = spark.createDataFrame([("j", t) for t in (0.0, 6.0, 11.9, 14.0)], "job_id string, timestamp_seconds double")
    n = transcript.chunk_counts(c, m, Params(chunk_seconds=6.0, chunk_overlap=1.0))
    assert [r.candidate_count for r in sorted(n.collect(), key=lambda r: r.chunk_id)] == [1, 2, 1]


SEG = "job_id string, segment_id bigint, start_seconds double, end_seconds double, text string, avg_logprob double, no_speech_prob double"


def test_alignment_kinds(spark):
    s = spark.createDataFrame([("j", 1, 2.0, 4.0, "one two", -0.1, 0.0), ("j", 2, 8.0, 10.0, "three", -0.1, 0.0)], SEG)
    m = spark.createDataFrame([("j", i, t) for i, t in enumerate((1.0, 3.0, 6.0, 7.0, 12.0))] + [("empty", 9, 1.0)], "job_id string, candidate_id bigint, timestamp_seconds double")
    got = {r.candidate_id: r for r in transcript.align(m, s, P).collect()}
    assert [got[i].alignment_type for i in (0, 1, 2, 3, 4, 9)] == ["BEFORE_FIRST_SPEECH", "OVERLAPPING_SPEECH", "BETWEEN_SPEECH", "BETWEEN_SPEECH", "AFTER_LAST_SPEECH", "NO_TRANSCRIPT"]
    assert [got[i].nearest_speech_direction for i in (0, 1, 2, 3, 4, 9)] == ["AFTER", "OVERLAPPING", "EQUAL_DISTANCE", "AFTER", "BEFORE", "NONE"]
    assert got[1].segment_relative_position == 0.5 and got[9].speech_proximity_score == 0.0


def test_context_skips_what_does_not_fit(spark):
    s = spark.createDataFrame([("j", 1, 0.0, 1.0, "a " * 30, None, None), ("j", 2, 2.0, 3.0, "b " * 200, None, None), ("j", 3, 4.0, 6.0, "now", None, None), ("j", 4, 7.0, 8.0, "c", None, None)], SEG)
    m = spark.createDataFrame([("j", 1, 5.0)], "job_id string, candidate_id bigint, timestamp_seconds double")
    r = transcript.context(m, s, Params(context_max_words=40)).first()
    assert (r.current_segment_ids, r.before_segment_ids, r.after_segment_ids) == ([3], [1], [4])
    assert r.truncated_before and not r.truncated_after and r.words == 32


def reply(**kw):
    return {"candidate_id": 7, "content_type": "SLIDE", "completion_state": "COMPLETE", "completion_score": 0.9, "visual_change_state": "SETTLED", "educational_usefulness": "HIGH", "usefulness_score": 0.9, "transition_probability": 0.1, "has_meaningful_visual_content": True, "teacher_still_writing_likely": False, "transcript_visual_consistency": "CONSISTENT", "confidence": 0.9, "reason_codes": []} | kw


def test_replies(spark):
    good = json.dumps(reply())
    rows = [(good, 7, "SUCCESS"), (f"```json\n{good}\n```", 7, "SUCCESS"), (f"Sure: {good} Bye", 7, "SUCCESS"), ("not-json", 7, "INVALID_JSON"), ("  ", 7, "EMPTY_RESPONSE"), (None, 7, "EMPTY_RESPONSE"), (good, 8, "SCHEMA_ERROR"), (json.dumps(reply(extra=1)), 7, "SCHEMA_ERROR"), (json.dumps(reply(confidence=2)), 7, "SCHEMA_ERROR")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "k int, t string, c bigint")
    got = {r.k: r.s for r in df.select("k", semantic.parse_replies("t", "c")["status"].alias("s")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for *_, w in rows]


def test_window_decisions(spark):
    cols = "job_id string, candidate_id bigint, stable_window_id bigint, selection_role string, rank_within_window bigint, eligible boolean, semantic_decision_score double"
    rows = [("j", 1, 1, "PRIMARY", 1, True, 0.70), ("j", 2, 1, "ALTERNATE", 2, True, 0.73), ("j", 3, 2, "PRIMARY", 1, True, 0.6), ("j", 4, 2, "ALTERNATE", 2, True, 0.9), ("j", 5, 3, "PRIMARY", 1, False, 0.9), ("j", 6, 3, "ALTERNATE", 2, True, 0.6), ("j", 7, 4, "PRIMARY", 1, False, 0.1), ("j", 8, 5, "PRIMARY", 1, True, 0.9)]
    got = {r.stable_window_id: (r.selected_candidate_id, r.decision, r.reason_codes) for r in semantic.window_decisions(spark.createDataFrame(rows, cols), P).collect()}
    assert got[1] == (1, "SELECT_PRIMARY", ["PRIMARY_REMAINS_STRONGER", "PRIMARY_TIE_BONUS", "SEMANTIC_TIE"])
    assert got[2][:2] == (4, "SELECT_ALTERNATE") and got[3][:2] == (6, "SELECT_ALTERNATE")
    assert got[4] == (None, "REJECT_WINDOW", ["CANDIDATE_REJECTED"]) and got[5][:2] == (8, "SELECT_SINGLE")


def test_duplicate_groups_do_not_chain(spark):
    p = spark.createDataFrame([("j", i, float(i)) for i in (1, 2, 3)], "job_id string, candidate_id bigint, selected_timestamp_seconds double")
    d = spark.createDataFrame([("j", 1, 2, "DUPLICATE"), ("j", 2, 3, "DUPLICATE"), ("j", 1, 3, "DISTINCT")], "job_id string, a bigint, b bigint, decision string")
    got = screenshots.duplicate_groups(p, d).collect()
    assert len({r.group_id for r in got}) == 2 and max(r.group_size for r in got) == 2
    assert next(r.group_id for r in got if r.candidate_id == 1) == "dup_" + T.fingerprint([1, 2])[:12]


def test_identical_files_score_one(spark):
    p = spark.createDataFrame([("j", i, float(i), "ab" * 8, "cd" * 8, "SLIDE", "same") for i in (1, 2)], "job_id string, candidate_id bigint, selected_timestamp_seconds double, phash string, dhash string, content_type string, source_file_sha256 string")
    none = spark.createDataFrame([], "job_id string, a bigint, b bigint, thumbnail_ssim double, edge_similarity double, addition_ab double, addition_ba double")
    r = screenshots.score_pairs(screenshots.pair_keys(p, P), p, none, P).first()
    assert (r.duplicate_score, r.decision, r.reason_codes) == (1.0, "DUPLICATE", ["IDENTICAL_FILE_SHA"])


def test_quality_search_needs_gain(spark):
    rows = [("j", 1, k, t, q, False) for k, (t, q) in enumerate([(5.0, 0.40), (4.5, 0.42), (5.5, 0.60), (4.0, 0.61)])]
    r = screenshots.best_attempt(spark.createDataFrame(rows, "job_id string, candidate_id bigint, k int, timestamp_seconds double, quality_score double, is_blank boolean"), P).first()
    assert (r.selected_timestamp_seconds, r.selected_quality_score) == (5.5, 0.60)
    s = screenshots.search_times(spark.createDataFrame([(5.0, 4.4, 9.0)], "timestamp_seconds double, window_start_seconds double, window_end_seconds double"), P).first()
    assert s.attempts == [5.0, 4.5, 5.5, 6.0]


def states(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, state_id string, target_timestamp_seconds double, acceptable_start_seconds double, acceptable_end_seconds double, importance string, duplicate_group string, acceptable_equivalence_group string")


def test_matching_is_one_to_one_and_groups_count_once(spark):
    s = states(spark, [("s", "a", 1.0, 1.0, 2.0, "REQUIRED", None, None), ("s", "b", 2.0, 1.0, 2.0, "REQUIRED", None, None), ("t", "c", 5.0, 4.0, 6.0, "REQUIRED", "g", None), ("t", "d", 5.5, 4.0, 6.0, "REQUIRED", "g", None)])
    q = spark.createDataFrame([("s", "CANDIDATE", "p1", 1.0), ("t", "CANDIDATE", "p2", 5.0), ("t", "CANDIDATE", "p3", 5.4)], "sample_id string, level string, prediction_id string, timestamp_seconds double")
    m = evaluation.temporal_match(s, q)
    got = sorted((r.sample_id, r.kind, r.state_id or "", r.prediction_id or "") for r in m.collect())
    assert got == [("s", "FALSE_NEGATIVE", "b", ""), ("s", "MATCH", "a", "p1"), ("t", "FALSE_POSITIVE", "", "p3"), ("t", "MATCH", "c", "p2")]
    n = spark.createDataFrame([("t", 5.3, 5.5)], "sample_id string, start_seconds double, end_seconds double")
    x = {r.sample_id: r for r in evaluation.summarize(m, s, q, n).collect()}
    assert (x["s"].precision, x["s"].recall, x["s"].f1) == (1.0, 0.5, 0.666667)
    assert (x["t"].precision, x["t"].required_state_recall, x["t"].negative_state_violation_rate) == (0.5, 0.5, 0.5)
    a = evaluation.aggregate(evaluation.summarize(m, s, q, n), "level").first()
    assert (a.tp, a.fp, a.fn, a.precision) == (2, 1, 1, 0.666667)
    f = {r.state_id: r.earliest_loss_stage for r in evaluation.loss_funnel(m, s).collect()}
    assert f["a"] == "SEMANTIC_FALSE_REJECTION" and f["b"] == "CANDIDATE_MISS"


def test_golden_counts():
    """Four matches and one false alarm: the published figures of the golden fixture's candidate level."""
    s = [{"state_id": str(i), "target_timestamp_seconds": 5.0 * i, "acceptable_start_seconds": 5.0 * i - 1, "acceptable_end_seconds": 5.0 * i + 1, "importance": "REQUIRED"} for i in range(4)]
    q = [{"prediction_id": str(i), "timestamp_seconds": 5.0 * i} for i in range(4)] + [{"prediction_id": "x", "timestamp_seconds": 2.5}]
    m, extra, missed = evaluation.match_sample(s, q)
    assert (len(m), extra, missed) == (4, ["x"], [])


def test_matching_against_a_search_of_all(spark):
    """The nearest free prediction, found by looking at every one."""
    r = random.Random(4)
    for _ in range(200):
        q = [{"prediction_id": f"p{r.randint(0, 99)}-{i}", "timestamp_seconds": float(r.randint(0, 12))} for i in range(r.randint(0, 9))]
        s = [{"state_id": str(i), "target_timestamp_seconds": (t := float(r.randint(0, 12))), "acceptable_start_seconds": t - r.randint(-1, 3), "acceptable_end_seconds": t + r.randint(-1, 3), "importance": r.choice(["REQUIRED", "OPTIONAL", "IGNORED"]), "duplicate_group": r.choice([None, None, "g"])} for i in range(r.randint(0, 6))]
        free, want, groups = list(q), [], set()
        for x in sorted((x for x in s if x["importance"] != "IGNORED"), key=lambda x: (x["target_timestamp_seconds"], x["state_id"])):
            near = [p for p in free if x["acceptable_start_seconds"] <= p["timestamp_seconds"] <= x["acceptable_end_seconds"]]
            if x["duplicate_group"] in groups or not near:
                continue
            best = min(near, key=lambda p: (abs(p["timestamp_seconds"] - x["target_timestamp_seconds"]), p["timestamp_seconds"], p["prediction_id"]))
            free.remove(best)
            groups |= {x["duplicate_group"]} - {None}
            want.append((x["state_id"], best["prediction_id"]))
        got, extra, _ = evaluation.match_sample(s, q)
        assert [m[:2] for m in got] == want and extra == sorted(p["prediction_id"] for p in free)


def test_redaction(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    hidden = "***REDACTED***"
    assert one(T.redact(F.create_map(F.lit("My_Private_Key"), F.lit("a"), F.lit("name"), F.lit("b")))) == {"My_Private_Key": hidden, "name": "b"}
    text = '{"token":{"a":1},"list":[{"COOKIE_jar":"x","n":[1,2]}],"cookies":[1],"ok":null}'
    assert one(T.redact_json(F.lit(text))) == f'{{"token":"{hidden}","list":[{{"COOKIE_jar":"{hidden}","n":[1,2]}}],"cookies":"{hidden}","ok":null}}'
    assert one(T.redact_json(F.lit("not json"))) is None and one(T.redact_json(F.lit(None).cast("string"))) is None


def test_gates(spark):
    r = evaluation.performance_gate(spark.createDataFrame([(10.0, 9.0, 1000, 1100, 1000, 1100)], "base_runtime double, cand_runtime double, base_peak bigint, cand_peak bigint, base_disk bigint, cand_disk bigint")).first()
    assert r.accepted and r.runtime_improvement_ratio == 0.1
    leak = spark.createDataFrame([("a", k, 100.0 + 10 * k) for k in range(6)] + [("b", k, 100.0 + (-1) ** k) for k in range(6)], "run_id string, k int, value double")
    assert {x.run_id: x.possible_leak for x in evaluation.possible_leak(leak).collect()} == {"a": True, "b": False}


def test_resume_plan_clears_all_after_the_first_fault(spark):
    v = spark.createDataFrame([("j", f"P{i}", i, s) for i, s in enumerate(["VALID", "VALID", "STALE", "VALID"])] + [("k", "P0", 0, "VALID")], "job_id string, stage string, stage_order int, state string")
    got = {r.job_id: r for r in lineage.resume_plan(v).collect()}
    assert (got["j"].last_valid_stage, got["j"].resume_stage, got["j"].stages_to_clear) == ("P1", "P2", ["P2", "P3"])
    assert got["k"].resume_stage is None and got["k"].stages_to_clear == []


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.clock(F.lit(s))) for s in (0.0, 61.9, 3661.0, -5.0)] == ["00:00", "01:01", "01:01:01", "00:00"]
    assert one(T.word_count(F.lit(""))) == 0 and one(T.word_count(F.lit(" a b  c "))) == 3
    assert one(T.truncate(F.lit("one two three four"), 100, 2)) == "one two…" and one(T.truncate(F.lit("one two"), 100, 5)) == "one two"
    assert one(T.truncate(F.lit("alpha beta gamma"), 9, 5)) == "alpha…"
    assert one(T.filename(F.lit("A/B: Größe?.pdf"))) == "A-B-Größe.pdf" and one(T.filename(F.lit(None).cast("string"))) == "Lecture-Notes.pdf"
    assert one(T.comparison(F.lit("  Héllo,  WORLD! "))) == "héllo world"
    assert T.similarity("the broker", "The broker sends!") == 1.0 and T.similarity("", "x") == 0.0
    assert T.canonical({"b": 1e-05, "a": None}) == '{"a":null,"b":1e-05}' and T.canonical({"b": 1, "a": None}, True) == '{"b":1}'
    assert tuple(one(T.wrapped(F.lit("aaaa bbbb cccc"), 5 * 5.8, 10, 2))) == ("aaaa\nbbbb…", True) and tuple(one(T.wrapped(F.lit(""), 10, 10, 1))) == ("", False)
    assert tuple(one(T.wrapped(F.lit("ab cd efghijk"), 5 * 5.8, 10, 9))) == ("ab cd\nefghi\njk", False) and one(T.wrapped(F.lit(None).cast("string"), 9, 9, 3)).text == ""
    assert one(T.plain(F.lit("Cafe\u0301  \u0007x"))) == "Caf\u00e9 x"


def test_pages(spark):
    d = spark.createDataFrame([("j", 1, 1280, 720), ("j", 2, 600, 900), ("j", 3, 500, 500)], "job_id string, `order` bigint, width bigint, height bigint")
    x = documents.page_layout(d, P)
    got = {r.order: r for r in x.collect()}
    assert [got[i].page_orientation for i in (1, 2, 3)] == ["LANDSCAPE", "PORTRAIT", "PORTRAIT"]
    assert documents.layout_problems(x, P).count() == 0 and all(r.scale <= 1 for r in got.values())


def test_links_metadata_and_probe(spark):
    urls = {"https://youtu.be/abcdef1": "abcdef1", "https://www.youtube.com/watch?x=1&v=abcdef2": "abcdef2", "http://m.youtube.com/shorts/abcdef3?t=1": "abcdef3", "ftp://youtu.be/abcdef1": None, "https://youtube.com/watch": None, "https://evil.org/watch?v=abcdef": None, "": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    i, e = media.video_link(F.col("u"))
    got = {r.u: (r.i, r.e) for r in df.select("u", i.alias("i"), e.alias("e")).collect()}
    assert {u: g[0] for u, g in got.items()} == urls and all((g[0] is None) == (g[1] is not None) for g in got.values())
    probe = json.dumps({"format": {"format_name": "mp4", "duration": "12.5", "size": "99"}, "streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "width": 640, "height": 360, "avg_frame_rate": "30000/1001", "disposition": {"default": 1}}, {"index": 1, "codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}]})
    r = media.media_probe(spark.createDataFrame([("j", probe), ("k", "oops")], "job_id string, json string")).where("job_id = 'j'").first()
    assert (r.container, r.width, r.audio_codec, r.sample_rate) == ("mp4", 640, "aac", 48000) and r.fps == pytest.approx(29.97, abs=0.01)
    m = media.metadata(spark.createDataFrame([('{"id": "a", "title": " ", "upload_date": "20240229", "is_live": false}',), ('{"id": "b", "live_status": "is_live"}',)], "json string")).orderBy("id").collect()
    assert (m[0].title, str(m[0].upload_date), m[0].rejection, m[1].rejection) == ("Untitled", "2024-02-29", None, "LIVE_OR_UPCOMING")
    g = media.sampling_grid(spark.createDataFrame([("j", 2.5)], "job_id string, duration_seconds double"), P)
    assert sorted(x.timestamp_seconds for x in g.collect()) == [0.0, 1.0, 2.0]


def picture(kind, h=60, w=80):
    a = np.full((h, w), 230, np.uint8)
    if kind == "text":
        a[10:50:6, 8:70] = 20
    if kind == "black":
        a[:] = 0
    return a


def test_kernels_and_frame_chain(spark):
    same = kernels.pair_metrics(picture("text"), picture("text"))
    other = kernels.pair_metrics(picture("text"), picture("blank"))
    assert same["pixel_difference"] == same["ssim_difference"] == same["phash_difference"] == same["edge_difference"] == 0
    assert other["pixel_difference"] > 0 and other["ssim_difference"] > 0.05 and other["edge_difference"] > 0
    assert kernels.frame_metrics(picture("text"))["sharpness_score"] > kernels.frame_metrics(picture("blank"))["sharpness_score"]
    assert np.allclose(kernels.resize_area(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert len(kernels.hexed(kernels.phash(picture("text")))) == 16
    rows = [("j", i + 1, float(i), f"s{i}", f"p{i}", bytearray(picture(k).tobytes()), 60, 80) for i, k in enumerate(["text", "text", "blank", "black"])] + [("j", 5, 4.0, "s", "p", bytearray(b"xx"), 60, 80)]
    raw = spark.createDataFrame(rows, "job_id string, index bigint, timestamp_seconds double, source_path string, processed_path string, image binary, height int, width int")
    from framewright.operators import change

    f = change.quality_flags(media.measure_frames(raw, P), P).join(raw.select("job_id", "index", "image"), ["job_id", "index"])
    got = {r["index"]: r for r in f.collect()}
    assert [got[i].is_valid for i in (1, 2, 3, 4, 5)] == [True, True, True, True, False] and got[4].is_black and not got[1].is_black
    x = sorted(change.score_pairs(media.measure_pairs(f, P), P).collect(), key=lambda r: r.current_frame_index)
    assert [r.valid for r in x] == [True, True, True, False] and x[0].difference_score == 0 and x[1].difference_score > 0


def test_sound_logs_and_manifests(spark, tmp_path):
    import io

    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes((3000 * np.sin(np.arange(2500) / 5)).astype("<i2").tobytes())
    a = media.audio_windows(spark.createDataFrame([("j", bytearray(buf.getvalue())), ("k", bytearray(b"no"))], "job_id string, content binary"))
    assert a.where("job_id = 'j'").count() == 3 and a.where("job_id = 'k' and n is null").count() == 1
    d = transcript.audio_diagnostics(a.where("n is not null"), P).first()
    assert 0.05 < d.mean_rms < 0.08 and not d.effectively_silent
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "e.ndjson").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    good, bad = media.read_events(spark, str(tmp_path / "log"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 0
    assert [r.p for r in spark.createDataFrame([("a/b",), ("/a",), ("a/../b",)], "p string").select(media.safe_path(F.col("p")).alias("p")).collect()] == [True, False, False]


def test_job_states(spark):
    j = spark.createDataFrame([("a", "QUEUED", 0.0), ("b", "COMPLETED", 100.0), ("c", "RUNNING", 50.0)], "job_id string, status string, progress double")
    c = spark.createDataFrame([("a", "RUNNING", 5.0), ("b", "RUNNING", 1.0), ("c", "COMPLETED", 10.0)], "job_id string, new_status string, new_progress double")
    done, refused = jobs.apply_changes(j, c)
    assert {r.job_id: (r.status, r.progress) for r in done.collect()} == {"a": ("RUNNING", 5.0), "b": ("COMPLETED", 100.0), "c": ("COMPLETED", 50.0)}
    assert [r.job_id for r in refused.collect()] == ["b"]
    assert {r.constraint: r.broken for r in jobs.broken_constraints(j, {"started": F.col("progress") > 0}).collect()} == {"started": 1}


def test_stream_sessions(spark, tmp_path):
    from framewright.streaming.sessions import change_sessions

    rows = [("j", f"2024-01-01 00:00:{s:02d}", 0.9, True, False, False) for s in (1, 2, 3, 20)] + [("j", "2024-01-01 02:00:00", 0.9, True, False, False)]
    spark.createDataFrame(rows, "job_id string, at string, difference_score double, valid boolean, previous_is_black boolean, current_is_black boolean").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    t = spark.createDataFrame([("j", 0.5)], "job_id string, major_threshold double")
    q = change_sessions(s, t, 5).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.members for r in spark.table("sessions").collect()) in ([1, 3], [1, 1, 3])
