"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers used to spread integer hashes (fixed values).
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only where none is named (tests), make a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the value written as text, modulo ``n``; -1 for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(n), F.lit(-1))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit integers so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= MIX
        x ^= x >> np.uint64(29)
        x *= MIX2
        x ^= x >> np.uint64(32)
    return x


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every segment, one segment after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lens > 0
    s, n = starts[keep], lens[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


def segment_sum(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of consecutive segments (empty ones give zero) along the first axis."""
    c = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    end = np.cumsum(lens)
    return c[end] - c[end - lens]


def subword_buckets(words: list[str], sizes: tuple[int, ...], bits: int, affixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: the word itself, its byte n-grams within '<word>', and (optionally) prefixes and suffixes.

    Returns the bucket numbers, word after word, and how many each word has.  No word is shortened.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    starts = np.cumsum(lens) - lens
    ends = starts + lens
    owner = np.repeat(np.arange(len(raw)), lens)
    feats, owners = [], []
    with np.errstate(over="ignore"):
        # prefix[i] = hash of text[:i] in a wrapping polynomial; a word's hash is a difference of two
        h = text + np.uint64(1)
        grams = {1: h}
        base = np.uint64(1_000_003)
        for n in range(2, max((*sizes, *affixes, 1)) + 1):
            nxt = np.zeros_like(text)
            room = max(0, len(text) - n + 1)  # a few short words may hold no string of n bytes
            nxt[:room] = grams[n - 1][:room] * base + text[n - 1 :] + np.uint64(1)
            grams[n] = nxt
        at = np.arange(len(text))
        for n in sizes:
            ok = np.flatnonzero(at + n <= ends[owner])
            feats.append(mix64(grams[n][ok] + np.uint64(n << 56)))
            owners.append(owner[ok])
        for n in affixes:
            ok = np.flatnonzero(lens >= n + 2)
            feats.append(mix64(grams[n][starts[ok] + 1] + np.uint64((32 + n) << 56)))
            feats.append(mix64(grams[n][ends[ok] - 1 - n] + np.uint64((64 + n) << 56)))
            owners += [ok, ok]
        # whole word: position-weighted sum, so that order counts
        pos = (at - starts[owner]).astype(np.uint64)
        w = mix64((text + np.uint64(1)) * MIX + mix64(pos + np.uint64(7)))
        total = np.add.reduceat(w, starts)
        feats.append(mix64(total))
        owners.append(np.arange(len(raw)))
    f, o = np.concatenate(feats), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return (f[order] >> np.uint64(64 - bits)).astype(np.int64), np.bincount(o, minlength=len(raw)).astype(np.int64)


def stash(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Write the rows as a compressed table in the shared checkpoint folder and read them from there; ``paths`` gets its place."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove stashed tables that nothing reads any more."""
    sc = spark.sparkContext
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def few(df: DataFrame, most: int) -> DataFrame:
    """The rows, marked for broadcast if they are ``most`` at most; a larger table is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tidied(run):
    """A worker's function for mapInArrow that gives freed memory back when its task ends: workers live on, stage after stage."""

    def inner(batches):
        yield from run(batches)
        give_back()

    return inner


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass
