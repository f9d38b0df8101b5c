"""Media columns: chroma fingerprints of audio, and alignment of recordings.

A spectrogram is folded into twelve pitch classes a frame, smoothed and normalised.  Filters compare rectangles of this
picture, summed by its integral image; each answers with two bits (a Gray code of its quarter), and sixteen of them make
one packed 32-bit integer for each place in time.

Recordings are aligned by landmarks, which are the integers at all their places: the differences of the places of equal
ones vote for offsets, and the bit errors of the overlaps at the ``offsets`` with most votes decide.  Recordings with the
same fingerprint are one class, and only classes are compared: a class is linked to another if at such an offset they
overlap by ``min_overlap`` integers or more with a bit error rate of ``max_error`` or less.

Two recordings that have no integer in common, all 32 bits equal, do not meet.  With bits wrong at random, of 47 integers
(the tunes of the test tables) at least one is whole in 99.99 % of cases at 5 % of wrong bits, 80 % at 10 %, 23 % at 15 %.

Audio is 16-bit little-endian mono PCM, in a binary column.  The test tables hold no audio, so ``render`` plays a vector
as a tune (a note for each component); it is a source for the operator and not a part of it.

Defined cases: null or empty audio, and audio too short for one integer, has an empty fingerprint, which belongs to the
class of empty fingerprints and is linked to nothing; repeated rows all come back; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import stash, tidied

RATE = 5512
FRAME = 2048
HOP = 689
PITCHES = 12
SPAN = 16  # frames that one integer looks at
#: Smoothing over neighbouring frames (fixed values).
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch, pitches, frames) of sixteen filters: every kind of comparison at a few places and sizes."""
    out = []
    for i in range(16):
        kind = i % 5
        height = (4, 6, 8, 12)[i // 4]
        width = (16, 12, 8, 14, 10)[(i * 3) % 5]
        out.append((kind, (i * 5) % (PITCHES - height + 1), height, width))
    return out


def _folding(rate: int) -> np.ndarray:
    """Which pitch class a frequency bin belongs to, as a matrix; bins outside 100 Hz to 2.5 kHz belong to none."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    ok = (hz >= 100) & (hz <= 2500)
    note = np.round(12 * np.log2(np.maximum(hz, 1) / 440.0)).astype(int) % PITCHES
    m = np.zeros((len(hz), PITCHES))
    m[np.flatnonzero(ok), note[ok]] = 1
    return m


_MATRIX = {RATE: _folding(RATE)}
_WINDOW = np.hanning(FRAME)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by pitch classes, each frame of length one (or zero where nothing sounds)."""
    if len(samples) < FRAME:
        return np.zeros((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    fold = _MATRIX.setdefault(rate, _folding(rate)) if rate in _MATRIX else _folding(rate)
    out = []
    for lo in range(0, len(frames), 512):
        spec = np.fft.rfft(frames[lo : lo + 512] * _WINDOW, axis=1)
        out.append((spec.real**2 + spec.imag**2) @ fold)
    c = np.concatenate(out)
    pad = len(SMOOTH) // 2
    e = np.pad(c, ((pad, pad), (0, 0)))
    c = sum(w * e[i : i + len(c)] for i, w in enumerate(SMOOTH))
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.divide(c, norm, out=np.zeros_like(c), where=norm > 1e-6)


def _areas(kind: int, y: int, x: int, h: int, w: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Rectangles (first frame, frames, first pitch, pitches) that a filter adds up on either side."""
    if kind == 0:  # lower against upper pitches
        return [(x, w, y, h // 2)], [(x, w, y + h // 2, h - h // 2)]
    if kind == 1:  # earlier against later
        return [(x, w // 2, y, h)], [(x + w // 2, w - w // 2, y, h)]
    if kind == 2:  # the diagonals
        return [(x, w // 2, y, h // 2), (x + w // 2, w - w // 2, y + h // 2, h - h // 2)], [(x, w // 2, y + h // 2, h - h // 2), (x + w // 2, w - w // 2, y, h // 2)]
    if kind == 3:  # middle pitches against those around
        return [(x, w, y + h // 3, h // 3)], [(x, w, y, h // 3), (x, w, y + 2 * (h // 3), h - 2 * (h // 3))]
    return [(x + w // 3, w // 3, y, h)], [(x, w // 3, y, h), (x + 2 * (w // 3), w - 2 * (w // 3), y, h)]


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Packed integers of a recording."""
    c = chroma(samples, rate)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    total = np.zeros((len(c) + 1, PITCHES + 1))
    total[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        return (total[at + x + w, y + h] - total[at + x, y + h] - total[at + x + w, y] + total[at + x, y]) / max(1, w * h)

    out = np.zeros(n, np.int64)
    for k, (kind, y, h, w) in enumerate(filters()):
        plus, minus = _areas(kind, y, 0, h, w)
        a = sum(area(*r) for r in plus) / len(plus)
        b = sum(area(*r) for r in minus) / len(minus)
        v = np.log1p(4 * np.maximum(a, 0)) - np.log1p(4 * np.maximum(b, 0))
        quarter = np.digitize(np.round(v, 9), (-0.25, 0.0, 0.25))
        out |= (quarter ^ (quarter >> 1)) << (2 * k)
    return out.astype(np.uint32).view(np.int32)


def render(vector: list[float] | None, seconds: float = 0.125, rate: int = RATE) -> bytes:
    """A vector as PCM: each component plays the note that its size stands for, an octave up if it is negative."""
    if not vector:
        return b""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float64), posinf=0.0, neginf=0.0)
    size = np.abs(v) / (np.abs(v).max() or 1.0)
    note = np.minimum(PITCHES - 1, (size * PITCHES).astype(int))
    hz = 220.0 * 2 ** (note / 12.0) * np.where(v < 0, 2.0, 1.0)
    phase = 2 * np.pi * np.arange(int(seconds * rate))[None, :] * hz[:, None] / rate
    return (8000 * np.sin(phase)).astype("<i2").tobytes()


def fingerprints(rows: DataFrame, id_col: str, audio_col: str, rate: int = RATE, as_audio=None) -> DataFrame:
    """(id, n_seconds, fp array<int>) of every row; ``as_audio`` turns the column's value into PCM bytes if it is not that."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n, fp = [], []
                for x in part.column(1):
                    raw = x.as_py() if as_audio is None else as_audio(x.as_py())
                    s = np.frombuffer(raw or b"", "<i2", count=len(raw or b"") // 2).astype(np.float64)
                    n.append(len(s) / rate)
                    fp.append(fingerprint(s, rate))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.float64()), pa.array(fp, pa.list_(pa.int32()))], names=["id", "n_seconds", "fp"])

    return rows.select(id_col, audio_col).mapInArrow(tidied(run), f"id {kind}, n_seconds double, fp array<int>")


def _errors(a: str, b: str, offset: str, n: str) -> F.Column:
    """Bits that differ where b's integers at i stand against a's at i + offset."""
    first_a, first_b = F.greatest(F.lit(0), F.col(offset)) + 1, F.greatest(F.lit(0), -F.col(offset)) + 1
    xor = F.zip_with(F.slice(a, first_a, F.col(n)), F.slice(b, first_b, F.col(n)), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(xor, F.lit(0), lambda s, x: s + x)


def align(prints: DataFrame, is_query, min_overlap: int = 16, max_error: float = 0.15, offsets: int = 3) -> DataFrame:
    """id, n_ints, fp_sha256, class_id, n_links, best_class, best_offset, best_error for every row of ``prints``.

    The last four are null for rows that are not queries; n_links counts linked classes other than the row's own.
    """
    rows = stash(prints.select("id", "fp", F.sha2(F.array_join("fp", " "), 256).alias("fp_sha256")))
    classes = rows.groupBy("fp_sha256").agg(F.min("id").alias("class_id"), F.max(F.coalesce(is_query(F.col("id")), F.lit(False))).alias("asked"), F.first("fp").alias("fp"))
    classes = stash(classes)
    # every integer at every place is a landmark
    marks = classes.where(F.size("fp") >= min_overlap).select("class_id", "asked", F.posexplode("fp").alias("pos", "mark"))
    q = marks.where("asked").select("mark", F.col("class_id").alias("q"), F.col("pos").alias("q_pos"))
    c = marks.select("mark", F.col("class_id").alias("c"), F.col("pos").alias("c_pos"))
    votes = q.join(c, "mark").where(F.col("q") != F.col("c")).groupBy("q", "c", (F.col("q_pos") - F.col("c_pos")).alias("offset")).count()
    # the offsets with most votes, the nearest to none first among equals; the least error of them decides
    ballot = F.sort_array(F.collect_list(F.struct("count", (-F.abs("offset")).alias("near"), "offset")), asc=False)
    best = votes.groupBy("q", "c").agg(F.slice(ballot, 1, offsets).alias("top")).select("q", "c", F.explode("top.offset").alias("offset"))
    fp = classes.select("class_id", "fp")
    both = best.join(fp.withColumnsRenamed({"class_id": "q", "fp": "a"}), "q").join(fp.withColumnsRenamed({"class_id": "c", "fp": "b"}), "c")
    n = F.least(F.size("a") - F.greatest(F.lit(0), F.col("offset")), F.size("b") - F.greatest(F.lit(0), -F.col("offset")))
    both = both.withColumn("n", n).where(F.col("n") >= min_overlap).withColumn("error", _errors("a", "b", "offset", "n") / (F.col("n") * 32.0))
    checked = both.where(F.col("error") <= max_error).groupBy("q", "c").agg(F.min(F.struct("error", F.abs("offset").alias("far"), "offset")).alias("x")).select("q", "c", "x.error", "x.offset")
    links = checked.groupBy(F.col("q").alias("class_id")).agg(F.count("*").alias("n_links"), F.min(F.struct("error", "c", "offset")).alias("m"))
    told = classes.select("fp_sha256", "class_id").join(links, "class_id", "left")
    asked = F.coalesce(is_query(F.col("id")), F.lit(False))
    only = lambda x: F.when(asked, x)
    return rows.join(told, "fp_sha256").select(
        "id", F.size("fp").alias("n_ints"), "fp_sha256", "class_id", only(F.coalesce("n_links", F.lit(0)).cast("bigint")).alias("n_links"), only(F.col("m.c")).alias("best_class"), only(F.col("m.offset")).alias("best_offset"), only(F.col("m.error")).alias("best_error")
    )


def brute_align(x: np.ndarray, y: np.ndarray, min_overlap: int = 16) -> tuple[int, float] | None:
    """Offset and least error rate of two fingerprints over every offset; for tests."""
    found = []
    for off in range(min_overlap - len(y), len(x) - min_overlap + 1):
        pairs = [(int(x[i + off]), int(y[i])) for i in range(len(y)) if 0 <= i + off < len(x)]
        if len(pairs) >= min_overlap:
            found.append((sum(((p ^ q) & 0xFFFFFFFF).bit_count() for p, q in pairs) / (32 * len(pairs)), abs(off), off))
    return (min(found)[2], min(found)[0]) if found else None
