"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of the fingerprints fall into ``m`` parts, correlated bits together.  If two fingerprints differ in at most r bits
and the parts' thresholds add up to r - m + 1, some part differs in at most its own threshold (-1: never probed).  The
thresholds are unequal: dynamic programming picks those with the least estimated work (rows probed and candidates met),
estimated on a bounded sample of fingerprints; the estimate changes the speed, never the links.

Equal fingerprints are one row.  Each distinct fingerprint is indexed once for each part in use and probes the ball of
its part's threshold; candidates are verified on all bits within the join.  Buckets with more than ``hot`` members are
compared block by block instead, and each pair of blocks returns only links that its own forest needs, so a crowded
bucket emits rows in proportion to its members and not to their pairs.

Defined cases: null text is text without words; a text without words has fingerprint 0 and links like any other; fewer
words than a shingle make one shingle; repeated rows all come back; a null doc_id is never a component's name unless
all of the component's ids are null (then it is null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut, tidied
from framewright.llm.graph import components

BITS = 64
_hash = xxhash.xxh64_intdigest


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of the lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [_hash(b" ".join(words), 42)]
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(length + 1) - (length + 1)
    end = (begin + length)[size - 1 :]
    return [_hash(line[i:j], 42) for i, j in zip(begin.tolist(), end.tolist(), strict=False)]


def majority(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 255 * 256):  # 255 rows add up within a byte
        bits = np.unpackbits(h[lo : lo + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):
            ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, size: int = 4) -> int:
    """The majority of the hashes of a text's shingles, repeats included; 0 for a text without words."""
    return majority(np.array(shingle_hashes(text, size), np.uint64))


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp bigint) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint((t.as_py() or "").encode("utf-8"), size) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidied(run), f"doc_id {kind}, text_hash bigint, fp bigint")


# -- the plan ---------------------------------------------------------------------------------------------------
def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size (but for one), each grown from its most correlated bit."""
    bits = np.unpackbits(sample.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    if len(bits) > 1:
        x = bits - bits.mean(axis=0)
        s = np.sqrt((x * x).sum(axis=0))
        corr = np.abs(x.T @ x) / np.maximum(1e-9, s[:, None] * s[None, :])
    else:
        corr = np.eye(BITS)
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        first = max(free, key=lambda b: (corr[b, list(free)].sum(), -b))
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds (>= -1) adding up to ``total`` with the least summed cost; cost[i][t + 1] is part i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, path) in best.items():
            for t, w in enumerate(row):
                if used + t <= total + len(cost) and (used + t not in nxt or c + w < nxt[used + t][0]):
                    nxt[used + t] = (c + w, [*path, t - 1])
        best = nxt
    return best[total + len(cost)][1]


def plan(sample: np.ndarray, n: int, radius: int, probe_cost: float = 20.0, share: float = 0.5) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part in use, with the least estimated work over 1 to radius + 1 parts.

    The chance that a part of two fingerprints is within t is taken from pairs of the sample, but at least what it would
    be for random bits.  A probed row costs ``probe_cost`` candidates; of all n x n pairs a ``share`` is compared.
    """
    rng = np.random.default_rng(3)
    found = None
    u = sample.astype(np.uint64)
    i, j = (rng.integers(0, len(u), 400_000) for _ in range(2)) if len(u) > 1 else (np.zeros(0, np.int64),) * 2
    i, j = i[u[i] != u[j]], j[u[i] != u[j]]
    for m in range(1, radius + 2):
        groups = group_bits(u, m)
        total = radius - m + 1
        cost = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            d = np.bitwise_count((u[i] ^ u[j]) & mask)
            row = [0.0]
            for t in range(total + m):
                ball = sum(comb(len(g), k) for k in range(min(t, len(g)) + 1))
                p = max(ball / 2.0 ** len(g), float((d <= t).mean()) if len(d) else 0.0)
                row.append(n * probe_cost * (ball + 1) + float(n) * n * share * p if ball < 20_000 else float("inf"))
            cost.append(row)
        t = allocate(cost, total)
        w = sum(r[x + 1] for r, x in zip(cost, t, strict=True))
        if found is None or w < found[0]:
            found = (w, [(g, x) for g, x in zip(groups, t, strict=True) if x >= 0])
    return found[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: list[int], radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(radius + 1) for c in combinations(bits, k)]


# -- the links ----------------------------------------------------------------------------------------------------
def forest(x: np.ndarray, y: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between near members of two blocks, only as many as connect what is connected."""
    nodes = np.unique(np.concatenate([x, y]))
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    out = []
    ys = np.searchsorted(nodes, y)
    for v, i in zip(x, np.searchsorted(nodes, x), strict=True):
        near = ys[np.bitwise_count((v ^ y).view(np.uint64)) <= radius]
        for j in near[parent[near] != parent[i]]:
            a, b = root(int(i)), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def near_links(distinct: DataFrame, radius: int = 4, sample_size: int = 20_000, hot: int = 2_000, block: int = 4_000) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that connect all those within ``radius`` bits of each other."""
    n = distinct.count()
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_size)
    sample = np.array([r.fp for r in some.collect()], np.int64).view(np.uint64)
    parts = plan(sample, n, radius)
    masks = [_signed(sum(1 << b for b in g)) for g, _ in parts]
    each = lambda rows: F.explode(F.array(*rows))
    index = distinct.select("fp", each([F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]).alias("x")).select("x.part", "x.key", F.col("fp").alias("b"))
    probes = [
        distinct.select(F.lit(k).alias("part"), F.col("fp").alias("a"), F.explode(F.lit(_masks(g, t))).alias("flip")).select("part", F.col("a").bitwiseAND(F.lit(masks[k])).bitwiseXOR(F.col("flip")).alias("key"), "a")
        for k, (g, t) in enumerate(parts)
    ]
    probe = probes[0]
    for p in probes[1:]:
        probe = probe.unionByName(p)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    crowded = cut(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot))
    on = ["part", "key"]
    if not crowded.take(1):
        return probe.join(index, on).where((F.col("a") < F.col("b")) & near).select("a", "b")
    calm = probe.join(index.join(crowded, on, "left_anti"), on).where((F.col("a") < F.col("b")) & near).select("a", "b")
    few = crowded.select(*on, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    right = index.join(few, on).withColumn("j", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    # as many probes as members, a ball's size apart: probes come in the same number of blocks times the ball
    left = probe.join(few, on).withColumn("i", F.pmod(F.xxhash64("a"), F.col("blocks") * 4).cast("int"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*on, "i", "j", "a")
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") * 4 - 1))).select(*on, "i", "j", "b")

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        rows = forest(x.column("a").to_numpy(), y.column("b").to_numpy(), radius) if x.num_rows and y.num_rows else []
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    key = [*on, "i", "j"]
    return calm.unionByName(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a bigint, b bigint"))


def groups(docs: DataFrame, size: int = 4, radius: int = 4, **how) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, component) of every distinct fingerprint."""
    fps = cut(fingerprints(docs, size))
    distinct = cut(fps.select("fp").distinct())
    comp = components(near_links(distinct, radius, **how))
    return fps, distinct.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, **how) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``."""
    fps, named = groups(docs, size, radius, **how)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    name = named.join(first, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.join(name, "component").select("fp", "component_id")
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 4, radius: int = 4, **how) -> DataFrame:
    """One row of every group of near duplicates, with all its columns: the one with the smallest doc_id.

    Ids may be null or repeated: rows are told apart by (doc_id, text), and of equal ones one stays.
    """
    fps, named = groups(docs, size, radius, **how)
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    stay = named.join(first, "fp").groupBy("component").agg(F.min("first").alias("k")).select(F.col("k.doc_id").alias("_d"), F.col("k.text_hash").alias("_h")).distinct()
    kept = docs.join(stay, docs.doc_id.eqNullSafe(stay._d) & (F.xxhash64(docs.text) == stay._h)).select(docs["*"], "_h")
    return kept.dropDuplicates(["doc_id", "_h"]).drop("_h")
