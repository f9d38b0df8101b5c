"""Sources: links, metadata and probe replies, frame times, pictures, sound, manifests and event logs."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import kernels
from framewright.params import DEFAULT, Params

HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com")


def video_link(url: Column) -> tuple[Column, Column]:
    """(video id or null, error or null) of a video's address in any of its forms."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(u, r"[?&]v=([^&#]*)", 1)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    found = F.when(host == "youtu.be", first).when(host.isin(*HOSTS), F.when(F.regexp_replace(path, "/+$", "") == "/watch", query).when(first.isin("shorts", "live", "embed"), second))
    web, known = scheme.isin("http", "https"), host.isin("youtu.be", *HOSTS)
    ok = F.coalesce(found.rlike(r"^[A-Za-z0-9_-]{6,20}$"), F.lit(False))
    error = F.when(~web, "UNSUPPORTED_SCHEME").when(~known, "UNSUPPORTED_HOST").when(~ok, "INVALID_VIDEO_ID")
    return F.when(web & known & ok, found), error


def canonical_link(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


FORMAT = "struct<format_id:string,ext:string,height:int,vcodec:string,acodec:string,filesize:bigint,filesize_approx:bigint,tbr:double>"
METADATA = f"id string, title string, uploader string, duration double, upload_date string, is_live boolean, live_status string, formats array<{FORMAT}>"


def metadata(raw: DataFrame, column: str = "json") -> DataFrame:
    """Typed rows of metadata replies; live and coming broadcasts are marked as rejected."""
    x = raw.withColumn("m", F.from_json(column, METADATA)).select("*", "m.*").drop("m")
    live = F.coalesce(F.col("is_live"), F.lit(False)) | F.coalesce(F.col("live_status").isin("is_live", "is_upcoming"), F.lit(False))
    return x.withColumns({"title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")), "upload_date": F.try_to_timestamp("upload_date", F.lit("yyyyMMdd")).cast("date"), "rejection": F.when(F.col("id").isNull(), "NO_METADATA").when(live, "LIVE_OR_UPCOMING")})


def download_size(formats: Column, height: int) -> Column:
    """Bytes of the largest picture-only format within the height plus the largest sound, or else of the largest joint one."""
    size = lambda f: F.coalesce(f["filesize"], f["filesize_approx"])
    has = lambda f, c: f[c].isNotNull() & (f[c] != "none")
    top = lambda keep: F.array_max(F.transform(F.filter(formats, keep), size))
    low = lambda f: F.coalesce(f["height"], F.lit(0)) <= height
    video, sound, joint = top(lambda f: has(f, "vcodec") & ~has(f, "acodec") & low(f)), top(lambda f: has(f, "acodec") & ~has(f, "vcodec")), top(lambda f: has(f, "vcodec") & has(f, "acodec") & low(f))
    return F.coalesce(video + sound, joint)


PROBE = "format struct<format_name:string,duration:string,size:string,bit_rate:string>, streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,sample_rate:string,channels:int,disposition:struct<default:int>>>"


def media_probe(raw: DataFrame, column: str = "json") -> DataFrame:
    """Container, picture and sound of probe replies; of several streams the default one, or else the first."""
    x = raw.withColumn("p", F.from_json(column, PROBE))

    def stream(kind: str) -> Column:
        mine = F.filter("p.streams", lambda s: s["codec_type"] == kind)
        return F.coalesce(F.get(F.filter(mine, lambda s: s["disposition"]["default"] == 1), F.lit(0)), F.get(mine, F.lit(0)))

    def rate(c: Column) -> Column:
        return F.try_divide(F.try_element_at(F.split(c, "/"), F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(F.split(c, "/"), F.lit(2)).try_cast("double"), F.lit(1.0)))

    x = x.withColumn("v", stream("video")).withColumn("a", stream("audio"))
    return x.select(*raw.columns, F.col("p.format.format_name").alias("container"), F.col("p.format.duration").try_cast("double").alias("duration_seconds"), F.col("p.format.size").try_cast("bigint").alias("size_bytes"), F.col("v.codec_name").alias("video_codec"), F.col("v.width").alias("width"), F.col("v.height").alias("height"), F.coalesce(F.nullif(rate(F.col("v.avg_frame_rate")), F.lit(0.0)), rate(F.col("v.r_frame_rate"))).alias("fps"), F.col("a.codec_name").alias("audio_codec"), F.col("a.sample_rate").try_cast("int").alias("sample_rate"), F.col("a.channels").alias("channels"))


def sampling_grid(media: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(job_id, index, timestamp_seconds): the times at which a job's frames are taken; jobs with too many are left out."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_seconds") * p.frame_sample_fps - 1e-9)).cast("bigint")
    x = media.withColumn("n", n).where(F.col("n") <= p.max_sampled_frames)
    x = x.select("job_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("index"))
    return x.withColumn("timestamp_seconds", F.bround((F.col("index") - 1) / p.frame_sample_fps, 6))


def sampling_problems(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Jobs whose frames are off by more than two and more than two in a hundred."""
    n = lambda d, c: d.groupBy("job_id").agg(F.count("*").alias(c))
    x = n(expected, "expected").join(n(found, "found"), "job_id", "left").na.fill(0, ["found"])
    return x.where(F.abs(F.col("found") - F.col("expected")) > F.greatest(F.lit(2), F.ceil(F.col("expected") * 0.02)))


def _picture(data: bytes | None, height, width) -> np.ndarray | None:
    if data is None or height is None or width is None or not height or not width or len(data) not in (height * width, 3 * height * width):
        return None
    a = np.frombuffer(data, np.uint8)
    return a.reshape(int(height), int(width)) if len(data) == height * width else a.reshape(int(height), int(width), 3)


FRAME_METRICS = ("brightness", "contrast", "sharpness_score", "edge_density", "black_pixel_ratio", "entropy")


def measure_frames(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Raw pictures (image binary, height, width) to metrics; a picture that cannot be read makes an invalid frame."""
    keep = [c for c in frames.columns if c not in ("image", "is_valid", "invalid_reason", *FRAME_METRICS)]
    schema = T.StructType([frames.schema[c] for c in keep] + [T.StructField(m, T.DoubleType()) for m in FRAME_METRICS] + [T.StructField("is_valid", T.BooleanType()), T.StructField("invalid_reason", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = []
            for data, h, w in zip(d["image"], d["height"], d["width"], strict=True):
                a = _picture(data, h, w)
                m = None if a is None else kernels.frame_metrics(kernels.fit_width(a, p.analysis_width), p.edge_low, p.edge_high, p.black_pixel_value)
                rows.append([None] * 6 + [False, "image_decode_failed"] if m is None else [m[k] for k in FRAME_METRICS] + [True, None])
            yield pd.concat([d[keep].reset_index(drop=True), pd.DataFrame(rows, columns=[*FRAME_METRICS, "is_valid", "invalid_reason"])], axis=1)

    return frames.select(*keep, "image").mapInPandas(run, schema)


PAIR_METRICS = ("pixel_difference", "ssim_similarity", "ssim_difference", "phash_difference", "edge_difference")


def measure_pairs(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each picture against the one before it: pairs with their four metrics, to be scored by ``change.score_pairs``."""
    w = Window.partitionBy("job_id").orderBy("timestamp_seconds", "index")
    cols = ("index", "timestamp_seconds", "image", "height", "width", "is_valid", "is_black")
    x = frames.withColumns({f"previous_{c}": F.lag(c).over(w) for c in cols}).where(F.col("previous_index").isNotNull())
    x = x.select(
        "job_id", F.col("previous_index").cast("bigint").alias("previous_frame_index"), F.col("index").cast("bigint").alias("current_frame_index"), "previous_timestamp_seconds", F.col("timestamp_seconds").alias("current_timestamp_seconds"),
        F.greatest(F.lit(0.0), F.col("timestamp_seconds") - F.col("previous_timestamp_seconds")).alias("delta_seconds"), F.coalesce("previous_is_black", F.lit(False)).alias("previous_is_black"), F.coalesce("is_black", F.lit(False)).alias("current_is_black"),
        F.when(~F.col("previous_is_valid"), "previous_frame_invalid").when(~F.col("is_valid"), "current_frame_invalid").alias("reason"), "image", "height", "width", "previous_image", "previous_height", "previous_width",
    )
    pictures = ("image", "height", "width", "previous_image", "previous_height", "previous_width")
    keep = [c for c in x.columns if c not in (*pictures, "reason")]
    schema = T.StructType([x.schema[c] for c in keep] + [T.StructField("reason", T.StringType()), T.StructField("valid", T.BooleanType())] + [T.StructField(m, T.DoubleType()) for m in PAIR_METRICS])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = []
            for r in d.itertuples(index=False):
                why = r.reason if isinstance(r.reason, str) else None
                a, b = _picture(r.previous_image, r.previous_height, r.previous_width), _picture(r.image, r.height, r.width)
                why = why or ("processed_frame_decode_failed" if a is None or b is None else None)
                m = None if why else kernels.pair_metrics(a, b, p.edge_low, p.edge_high, p.phash_size)
                rows.append([why, m is not None, *([m[k] for k in PAIR_METRICS] if m else [None] * 5)])
            yield pd.concat([d[keep].reset_index(drop=True), pd.DataFrame(rows, columns=["reason", "valid", *PAIR_METRICS])], axis=1)

    return x.mapInPandas(run, schema)


def hash_frames(frames: DataFrame) -> DataFrame:
    """(job_id, candidate_id, phash, dhash) of raw pictures; null where a picture cannot be read."""
    kind = frames.schema["candidate_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            got = [_picture(a, h, w) for a, h, w in zip(d["image"], d["height"], d["width"], strict=True)]
            one = lambda f: [None if a is None else kernels.hexed(f(kernels.grey(a))) for a in got]
            yield pd.DataFrame({"job_id": d["job_id"], "candidate_id": d["candidate_id"], "phash": one(kernels.phash), "dhash": one(kernels.dhash)})

    return frames.select("job_id", "candidate_id", "image", "height", "width").mapInPandas(run, f"job_id string, candidate_id {kind}, phash string, dhash string")


def audio_windows(files: DataFrame, seconds: float = 1.0) -> DataFrame:
    """WAV files (job_id, content) to sums by window; a file that is no 16-bit WAV gives one row with n null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            for job, data in zip(d["job_id"], d["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(data or b"")) as w:
                        if w.getsampwidth() != 2:
                            raise wave.Error("not 16 bits")
                        rows, rate, k = [], w.getframerate(), 0
                        while raw := w.readframes(max(1, int(rate * seconds))):
                            rows += [r | {"window_no": k} for r in kernels.audio_windows(np.frombuffer(raw, "<i2"), rate, seconds)]
                            k += 1
                except (wave.Error, EOFError):
                    rows = [{"window_no": 0, "n": None, "sum": None, "sum_sq": None, "peak": None, "clipped": None}]
                if rows:
                    yield pd.DataFrame(rows).assign(job_id=job)[["job_id", "window_no", "n", "sum", "sum_sq", "peak", "clipped"]]

    return files.select("job_id", "content").mapInPandas(run, "job_id string, window_no bigint, n bigint, sum double, sum_sq double, peak double, clipped bigint")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with size, time of change and SHA-256."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.withColumn("sha256", F.sha2("content", 256))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of a fixed schema; anything else is an error and never a guess."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """An event log of JSON lines: its events, and broken lines other than a file's last (which may be half written)."""
    raw = spark.read.text(path).withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()}).where(F.trim("value") != "")
    e = raw.withColumn("e", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = F.max("_at").over(Window.partitionBy("_file"))
    bad = e.withColumn("_last", last).where(F.col("e._bad").isNotNull() & (F.col("_at") < F.col("_last"))).select("_file", "value")
    return e.where(F.col("e._bad").isNull()).select("e.*").drop("_bad"), bad


def safe_path(path: Column) -> Column:
    """True for relative paths that do not climb."""
    return path.isNotNull() & ~path.startswith("/") & ~F.array_contains(F.split(path, r"[/\\]"), "..")


def audio_slices(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(job_id, chunk_id, wav, error): the part of each job's 16 kHz mono 16-bit WAV that a chunk decodes, as a WAV of its own.

    ``files`` has (job_id, content), ``plan`` the chunks with decode_start_seconds and decode_end_seconds.  A file of
    another form gives rows with an error.  The chunks of a job come with its file, so each file is read once.
    """
    spans = plan.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "decode_start_seconds", "decode_end_seconds"))).alias("spans"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            for job, data, todo in zip(d["job_id"], d["content"], d["spans"], strict=True):
                for s in todo:
                    wav, error = None, None
                    try:
                        with wave.open(io.BytesIO(data or b"")) as src:
                            if (src.getsampwidth(), src.getnchannels(), src.getframerate()) != (2, 1, 16000):
                                raise wave.Error("not 16 kHz mono 16-bit")
                            first, last = (min(src.getnframes(), round(s[k] * 16000)) for k in ("decode_start_seconds", "decode_end_seconds"))
                            src.setpos(first)
                            raw = src.readframes(max(0, last - first))
                        out = io.BytesIO()
                        with wave.open(out, "wb") as dst:
                            dst.setparams((1, 2, 16000, 0, "NONE", ""))
                            dst.writeframes(raw)
                        wav = out.getvalue()
                    except (wave.Error, EOFError) as e:
                        error = str(e) or "broken file"
                    yield pd.DataFrame({"job_id": [job], "chunk_id": [s["chunk_id"]], "wav": [wav], "error": [error]})

    return files.join(spans, "job_id").select("job_id", "content", "spans").mapInPandas(run, "job_id string, chunk_id bigint, wav binary, error string")


def judged_by_model(inputs: DataFrame, ask, parse, retries: int = 1) -> DataFrame:
    """(job_id, candidate_id, raw_text, result, attempt_count): a model asked until its reply parses, ``retries`` times more at most.

    ``ask(prompt, repair)`` gives a text; ``parse(text)`` gives canonical JSON text, or None if the reply is no good.
    After the first attempt the prompt asks for a repair; a reply that never parses leaves ``result`` null.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = []
            for job, candidate, prompt in zip(d["job_id"], d["candidate_id"], d["prompt"], strict=True):
                text, result, attempt = None, None, 0
                while result is None and attempt <= retries:
                    text = ask(prompt, attempt > 0)
                    result = parse(text)
                    attempt += 1
                rows.append((job, candidate, text, result, attempt))
            yield pd.DataFrame(rows, columns=["job_id", "candidate_id", "raw_text", "result", "attempt_count"])

    return inputs.select("job_id", "candidate_id", "prompt").mapInPandas(run, "job_id string, candidate_id bigint, raw_text string, result string, attempt_count int")
