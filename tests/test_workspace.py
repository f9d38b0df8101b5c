import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators import assembly, statistics
from framewright.sources import media, workspace


def test_manifests_are_written_whole(spark, tmp_path):
    path = str(tmp_path / "store" / "manifest")
    for n in (3, 5):
        workspace.write_manifest(spark.range(n), path)
        assert spark.read.json(path).count() == n
    assert sorted(os.listdir(tmp_path / "store")) == ["manifest"]
    os.rename(path, f"{path}.previous")  # a crash before the new one was moved
    (tmp_path / "store" / "manifest.tmp-1").mkdir()
    assert workspace.clean(spark, str(tmp_path / "store")) == ["manifest.tmp-1"]
    assert spark.read.json(path).count() == 5 and workspace.clean(spark, str(tmp_path / "none")) == []


def test_job_listing_and_lookup(spark, tmp_path):
    for name, text in (("a", '{"job_id": "a", "created_at": "2024-01-01T00:00:00Z"}'), ("b", '{"job_id": "b",\n "created_at": "2024-02-01T00:00:00Z"}'), ("c", "{broken"), ("d", '{"created_at": "2024-02-01T00:00:00Z"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    schema = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("created_at", T.TimestampType())])
    jobs = workspace.list_jobs(spark, str(tmp_path), schema)
    assert [j.job_id for j in jobs.collect()] == ["b", "a"]
    assert workspace.lookup(jobs, "job_id", "a").count() == 1
    with pytest.raises(KeyError, match="no row with job_id = 'x'"):
        workspace.lookup(jobs, "job_id", "x")


def test_sizes_invalidation_and_quarantine(spark):
    f = spark.createDataFrame([("/a/x", 1), ("/a/b/y", 2), ("c/z", 4)], "path string, length bigint")
    assert {r.folder: (r.n_files, r.bytes) for r in workspace.folder_sizes(f).collect()} == {"a": (2, 3), "c": (1, 4)}
    c = spark.createDataFrame([("j", s) for s in "ABC"] + [("k", "B")], "job_id string, stage string")
    p = spark.createDataFrame([("j", ["B", "C"])], "job_id string, stages_to_clear array<string>")
    assert sorted(tuple(r) for r in workspace.invalidated(c, p).collect()) == [("j", "A"), ("k", "B")]
    bad = lambda rows: spark.createDataFrame(rows, "job_id string, code string")
    q = {r.job_id: r for r in workspace.quarantine_table(("PHASE_5", bad([("j", "CHUNK_TIMESTAMP_INVALID")])), ("PHASE_6", bad([("j", "CONTEXT_TOO_LONG"), ("k", "what")]))).collect()}
    assert (q["j"].failed_stage, q["j"].error_category, q["j"].n_faults) == ("PHASE_5", "TRANSCRIPTION", 2) and q["k"].error_category == "INTERNAL"


def test_dataset_paths_stay_inside(spark, tmp_path):
    schema = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("annotation_path", T.StringType())])
    (tmp_path / "m.json").write_text('{"samples": [{"sample_id": "s", "annotation_path": "a/s.json"}]}')
    assert workspace.load_dataset(spark, str(tmp_path / "m.json"), schema).first().sample_id == "s"
    (tmp_path / "n.json").write_text('{"samples": [{"sample_id": "s", "annotation_path": "../s.json"}]}')
    with pytest.raises(Exception, match="leaves the dataset"):
        workspace.load_dataset(spark, str(tmp_path / "n.json"), schema).collect()


def test_clocks_and_progress(spark):
    d = spark.createDataFrame([("1:02:03.5",), ("2:03",), ("7.25",), ("x:1",), ("frame= 12",), ("=3",), (None,)], "value string")
    assert [r.s for r in d.select(workspace.clock_seconds(F.col("value")).alias("s")).collect()] == [3723.5, 123.0, 7.25, None, None, None, None]
    assert [tuple(r) for r in workspace.progress_fields(d).collect()] == [("frame", "12")]


def _wav(samples, rate=16000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def test_audio_slices(spark):
    x = np.arange(48000) % 1000
    files = spark.createDataFrame([("j", _wav(x)), ("k", _wav(x, 8000)), ("l", b"")], "job_id string, content binary")
    plan = spark.createDataFrame([("j", 1, 0.0, 1.5), ("j", 2, 1.0, 9.0), ("k", 1, 0.0, 1.0), ("l", 1, 0.0, 1.0)], "job_id string, chunk_id bigint, decode_start_seconds double, decode_end_seconds double")
    got = {(r.job_id, r.chunk_id): r for r in media.audio_slices(files, plan).collect()}
    for key, part in ((("j", 1), x[:24000]), (("j", 2), x[16000:])):
        with wave.open(io.BytesIO(got[key].wav)) as w:
            assert np.array_equal(np.frombuffer(w.readframes(w.getnframes()), "<i2"), part)
    assert got[("k", 1)].error and got[("l", 1)].error and got[("l", 1)].wav is None


def test_models_are_asked_again(spark):
    d = spark.createDataFrame([("j", 1, "good"), ("j", 2, "second"), ("j", 3, "never")], "job_id string, candidate_id bigint, prompt string")
    ask = lambda p, repair: "{}" if p == "good" or (p == "second" and repair) else "?"
    got = {r.candidate_id: (r.result, r.attempt_count) for r in media.judged_by_model(d, ask, lambda t: t if t == "{}" else None).collect()}
    assert got == {1: ("{}", 1), 2: ("{}", 2), 3: (None, 2)}


def test_first_fault_and_ties_of_languages(spark):
    d = spark.createDataFrame([(1, None), (5, 2), (9, 9)], "a int, b int")
    got = [r.c for r in d.select(assembly.first_fault((F.col("b") > 5, "B"), (F.col("a") > 3, "A")).alias("c")).collect()]
    assert got == [None, "A", "B"]
    c = spark.createDataFrame([("j", 1, "fr", 0.5), ("j", 2, "en", 0.7), ("k", 1, None, 0.1)], "job_id string, chunk_id int, language string, language_probability double")
    c = c.withColumns({"empty_segment_count": F.lit(0), "audio_duration_seconds": F.lit(400.0), "wall_clock_seconds": F.lit(10.0)})
    s = spark.createDataFrame([("j", 2, 0.0, 1.0)], "job_id string, word_count bigint, absolute_start_seconds double, absolute_end_seconds double")
    got = {r.job_id: r for r in statistics.raw_transcript_stats(c, s).collect()}
    assert (got["j"].language, got["j"].language_probability, got["j"].warnings) == ("en", 0.7, ["LOW_TRANSCRIPT_COVERAGE"])
    assert (got["k"].language, got["k"].warnings) == (None, ["NO_SPEECH_DETECTED"])


def test_phase_tools(tmp_path):
    from framewright import tools
    from framewright.params import DEFAULT

    m = tools.Measured()
    with m.stage("a"):
        sum(range(1000))
    with pytest.raises(ValueError), m.stage("b"):
        raise ValueError
    assert [(s["stage"], s["failed"]) for s in m.stages] == [("a", False), ("b", True)] and m.total() > 0
    assert tools.capabilities()["recommended_profile"] in ("LOW", "BALANCED", "QUALITY")
    r = tools.readiness(str(tmp_path), tools=("no-such-tool",), min_free_bytes=0)
    assert not r["ready"] and r["failures"] == ["no-such-tool"] and tools.readiness(str(tmp_path), min_free_bytes=0)["ready"]
    a, b = tools.config_snapshot(DEFAULT, "1", api_key="x"), tools.config_snapshot(DEFAULT, "1", api_key="y")
    assert a == b and a["parameters"]["api_key"] == "***REDACTED***"


def test_pdf_files(spark):
    from framewright.functions import pdf
    from framewright.operators import documents

    d = spark.createDataFrame([("j", 1, 1, 64, 48, 61.0, "SLIDE", "Some words " * 40, "T" * 200), ("j", 2, 2, 300, 900, 5.0, "CODE", None, "T"), ("k", 1, 9, 64, 48, 1.0, "CODE", "x", "T")], "job_id string, page_number int, candidate_id bigint, width int, height int, timestamp_seconds double, content_type string, snippet string, title string")
    plan = documents.render_plan(documents.page_layout(d)).withColumn("file_sha256", F.lit("same"))
    rows = {(r.job_id, r.page_number): r for r in plan.collect()}
    assert rows[("j", 1)].caption_text.startswith("01:01 · Slide — Some words") and rows[("j", 1)].caption_cut and rows[("j", 1)].footer_text == "1 / 2"
    assert rows[("j", 2)].caption_text == "00:05 · Code" and not rows[("j", 2)].caption_cut and "\n" not in rows[("j", 1)].header_text
    i = spark.createDataFrame([("j", 1, bytes(64 * 48 * 3), 64, 48, "same"), ("j", 2, bytes(300 * 900 * 3), 300, 900, "same"), ("k", 9, bytes(64 * 48 * 3), 64, 48, "other")], "job_id string, candidate_id bigint, pixels binary, columns int, rows int, sha256 string")
    got = {r.job_id: r for r in documents.pdf_files(plan, i).collect()}
    data = bytes(got["j"].content)
    assert got["j"].pages == 2 == pdf.page_count(data) and data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n") and got["j"].bytes == len(data)
    at = int(data.split(b"startxref\n")[1].split(b"\n")[0])
    assert data[at : at + 4] == b"xref"
    for k, place in enumerate(data[at:].split(b" 65535 f \n")[1].split(b"trailer")[0].split(b" 00000 n \n")[:-1], 1):
        assert data[int(place) :].startswith(b"%d 0 obj" % k)
    assert got["k"].content is None and "not the planned one" in got["k"].error
    with pytest.raises(ValueError):
        pdf.write([])
