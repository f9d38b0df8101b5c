"""Stored jobs: manifests written whole or not at all, listings, lookups, sizes, and what an unfinished write left behind.

Paths go through the session's file systems, so a workspace may be on any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.sources.tables import _files


def write_manifest(df: DataFrame, path: str) -> None:
    """Write JSON lines beside ``path`` and move them there: readers see the old manifest or the new one, never half of one.

    The old one is kept as ``path.previous`` until the new one is in place; ``clean`` puts it back after a crash between.
    """
    spark = df.sparkSession
    fresh = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.json(fresh)
    fs, at = _files(spark, path)
    new, old = _files(spark, fresh)[1], _files(spark, f"{path}.previous")[1]
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"cannot move a manifest to {path}")
    fs.delete(old, True)


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Put back manifests whose replacement never came, and remove what unfinished writes left; the names that went."""
    fs, at = _files(spark, folder)
    if not fs.exists(at):
        return []
    names = {f.getPath().getName() for f in fs.listStatus(at)}
    gone = []
    for name in sorted(names):
        here = _files(spark, f"{folder}/{name}")[1]
        if name.endswith(".previous") and name.removesuffix(".previous") not in names:
            fs.rename(here, _files(spark, f"{folder}/{name.removesuffix('.previous')}")[1])
        elif name.endswith(".previous") or ".tmp-" in name:
            fs.delete(here, True)
            gone.append(name)
    return gone


def list_jobs(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Jobs from ``root/<job>/job.json``, the newest first; files that do not parse, or lack an id, are left out."""
    files = spark.read.schema(schema).options(multiLine="true", mode="DROPMALFORMED", recursiveFileLookup="true", pathGlobFilter="job.json")
    return files.json(root).where(F.col("job_id").isNotNull()).orderBy(F.desc("created_at"), "job_id")


def lookup(rows: DataFrame, key: str, value: object, **more: object) -> DataFrame:
    """The rows of one key, whose filter reaches the scan; KeyError if there is none (one row is read to know)."""
    cond = F.col(key) == F.lit(value)
    for k, v in more.items():
        cond = cond & (F.col(k) == F.lit(v))
    found = rows.where(cond)
    if not found.take(1):
        raise KeyError(f"no row with {key} = {value!r}")
    return found


def folder_sizes(files: DataFrame, depth: int = 1) -> DataFrame:
    """(folder, n_files, bytes) of files (path, length), by the first ``depth`` parts of their paths."""
    folder = F.array_join(F.slice(F.split(F.regexp_replace("path", "^/+", ""), "/"), 1, depth), "/")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def invalidated(checkpoints: DataFrame, plan: DataFrame) -> DataFrame:
    """Checkpoints (job_id, stage) without those that a plan (job_id, stages_to_clear) clears; a store then drops their artifacts.

    Checkpoints go first: an artifact without one counts as missing, so a crash between the two loses nothing.
    """
    out = plan.select("job_id", F.explode("stages_to_clear").alias("stage"))
    return checkpoints.join(out, ["job_id", "stage"], "left_anti")


def load_dataset(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Samples of an evaluation manifest ({"samples": [...]}), a row each; paths that leave the folder are an error."""
    from framewright.sources.media import safe_path

    m = spark.read.schema(T.StructType([T.StructField("samples", T.ArrayType(schema))])).option("mode", "FAILFAST").option("multiLine", "true").json(path)
    s = m.select(F.inline("samples"))
    inside = F.col("annotation_path").isNotNull() & safe_path(F.col("annotation_path"))
    return s.where(F.when(inside, True).otherwise(F.raise_error(F.concat(F.lit("path leaves the dataset: "), F.coalesce("annotation_path", F.lit("null")))).cast("boolean")))


def clock_seconds(text: Column) -> Column:
    """H:M:S.f, M:S or seconds as a number; anything else is null."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    ok = F.forall(parts, lambda p: p.isNotNull()) & (F.size(parts) <= 3)
    return F.when(ok, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60.0 + p))


def progress_fields(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines key=value of a tool's progress report as (key, value); others are left out."""
    at = F.instr(F.col(line), "=")
    return lines.where(at > 1).select(F.trim(F.expr(f"substring({line}, 1, instr({line}, '=') - 1)")).alias("key"), F.trim(F.expr(f"substring({line}, instr({line}, '=') + 1)")).alias("value"))


#: Faults by code, with the category that people filter by (fixed values).
CATEGORIES = {
    "INTERNAL": ("job_not_found", "invalid_job_transition", "processing_error", "REFERENCE_MISMATCH", "HANDOFF_REFERENCES_INCONSISTENT", "SELECTED_WINDOW_INCONSISTENT"),
    "CANCELLED": ("job_cancelled",),
    "STORAGE": ("storage_error", "MEDIA_MISSING"),
    "MEDIA": ("TIMESTAMP_OUTSIDE_VIDEO", "RESOLUTION_TOO_SMALL", "INVALID_FRAME"),
    "TRANSCRIPTION": ("CHUNK_TIMESTAMP_INVALID", "TIMESTAMP_OUTSIDE_LECTURE", "CONTEXT_TOO_LONG"),
    "DOCUMENT": ("PAGE_COUNT_DIFFERS", "PAGE_IDENTITY_DIFFERS", "GEOMETRY_RECALCULATED"),
}


def quarantine_table(*faults: tuple[str, DataFrame]) -> DataFrame:
    """One row a job with its first fault in stage order: (job_id, failed_stage, error_code, error_category, n_faults).

    ``faults`` are (stage, rows with job_id and code), in the order of the stages; unknown codes are INTERNAL.
    """
    rows = [f.select("job_id", F.lit(k).alias("k"), F.lit(stage).alias("failed_stage"), F.col("code").alias("error_code")) for k, (stage, f) in enumerate(faults)]
    x = rows[0]
    for r in rows[1:]:
        x = x.unionByName(r)
    first = F.min(F.struct("k", "error_code", "failed_stage"))
    category = F.lit("INTERNAL")
    g = x.groupBy("job_id").agg(first.alias("f"), F.count("*").alias("n_faults"))
    for name, codes in CATEGORIES.items():
        category = F.when(F.col("f.error_code").isin(*codes), name).otherwise(category)
    return g.select("job_id", "f.failed_stage", "f.error_code", category.alias("error_category"), "n_faults")
