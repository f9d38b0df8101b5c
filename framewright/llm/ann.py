"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a nearest-neighbour graph; the graph is cut into balanced parts with few neighbours
apart; a small network learns to tell a vector's part, with the parts of its neighbours as soft labels.  Every row is
indexed under its most probable part.  A query probes its most probable parts, as many as a validation split of the sample
needs for ``recall``, and at least as many as hold k candidates; the candidates are ranked by exact distance.

Crowded parts are dealt to blocks by a hash, and a query visits all blocks of its parts; each block answers with at most
k rows a query.  Of equal vectors in a block the k + 1 smallest ids stand for all: more can never be among the nearest.

Defined cases: vectors that are null, empty, zero, hold a null or a non-finite number, or have another length than the most
common one take no part, nor do null ids; rows that repeat a query's id are not its candidates; of repeated query rows
one is answered; ties go to the smaller id; a table with fewer than two vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import tidied


#: Rows of the table for each part, and least and most parts.
PART_ROWS, PARTS = 2_000, (64, 256)


def knn_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of every row."""
    sq = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        d = sq[None, :] - 2 * (x[lo : lo + 1024] @ x.T)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) else np.argsort(d, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 25, slack: float = 1.05, seed: int = 5) -> np.ndarray:
    """Part of every node: halved again and again along the direction of most spread, then refined on the graph.

    A round moves nodes to the part that most of their neighbours are in, largest gain first, as long as it has room.
    """
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[rows] = first
            return
        y = x[rows] - x[rows].mean(axis=0)
        v = rng.normal(size=x.shape[1])
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        order = rows[np.argsort(y @ v, kind="stable")]
        left = n // 2
        cut = len(order) * left // n
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, n - left)

    halve(np.arange(len(x)), 0, parts)
    room = int(np.ceil(slack * len(x) / parts))
    both = np.concatenate([np.column_stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.column_stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])])
    for _ in range(rounds):
        votes = np.bincount(both[:, 0] * parts + part[both[:, 1]], minlength=len(x) * parts).reshape(len(x), parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room and rng.random() < 0.7:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < len(x) // 500:
            break
    return part


class Router:
    """One hidden layer, softmax over parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 40, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(axis=0), x.std() + 1e-9
        d, p = x.shape[1], target.shape[1]
        w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, p)), np.zeros(p)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        z = (x - self.mean) / self.std
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), 256):
                b = order[lo : lo + 256]
                h = np.maximum(0, z[b] @ w[0] + w[1])
                s = h @ w[2] + w[3]
                s = np.exp(s - s.max(axis=1, keepdims=True))
                g = (s / s.sum(axis=1, keepdims=True) - target[b]) / len(b)
                gh = (g @ w[2].T) * (h > 0)
                grads = [z[b].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
                step += 1
                rate = 3e-3 * (1 - epoch / epochs) + 1e-4
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.mean) / self.std @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]


class Index:
    """The router and how many parts a query probes."""

    def __init__(self, router: Router | None, parts: int, probes: int):
        self.router, self.parts, self.probes = router, parts, probes

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.router.scores(x), axis=1, kind="stable")


def fit(x: np.ndarray, k: int, recall: float, parts: int, neighbours: int = 12) -> Index:
    """Learn an index from the sample; a tenth of it, unseen by the network, sets the number of probes."""
    n = len(x)
    parts = min(parts, n // 40)
    if parts < 2:
        return Index(None, 1, 1)
    x = x.astype(np.float64)
    test = np.arange(n) % 10 == 3
    train = x[~test]
    graph = knn_graph(train, neighbours)
    part = balanced_parts(train, graph, parts)
    near = np.zeros((len(train), parts))
    for col in range(graph.shape[1]):
        np.add.at(near, (np.arange(len(train)), part[graph[:, col]]), 1.0)
    near[np.arange(len(train)), part] += 2.0
    router = Router(train, near / near.sum(axis=1, keepdims=True))
    index = Index(router, parts, parts)
    # rows go where the network says, so recall is measured on its own placement
    home = index.order(train)[:, 0]
    q = x[test]
    sq = (train * train).sum(axis=1)
    d = sq[None, :] - 2 * (q @ train.T)
    near_q = np.argpartition(d, min(k, len(train)) - 1, axis=1)[:, : min(k, len(train))]
    where = np.argsort(index.order(q), axis=1)  # place of each part in the query's order
    place = np.take_along_axis(where, home[near_q], axis=1)
    for probes in range(1, parts + 1):
        if (place < probes).mean() >= recall:
            index.probes = probes
            break
    return index


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def search(vectors: DataFrame, is_query, k: int = 10, recall: float = 0.97, sample_size: int | None = None, parts: int | None = None, block: int = 20_000, query_block: int = 50_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every query row (``is_query`` is a condition on the id).

    Parts follow the table: one for each PART_ROWS rows, PARTS[0] at least and PARTS[1] at most; the sample has 100 rows a
    part, 10,000 at least.  Beyond that size parts grow and are dealt to blocks.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    ok = F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("vec", lambda a: a != 0)
    v = v.where(F.col("vec").isNotNull()).where(ok)
    dims = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim = dims[0].d
    parts = parts or min(PARTS[1], max(PARTS[0], -(-dims[0]["count"] // PART_ROWS)))
    sample_size = sample_size or max(10_000, 100 * parts)
    v = v.where(F.size("vec") == dim)
    some = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_size).select("vec").toArrow()
    sample = np.array(some.column(0).to_pylist(), np.float64)
    index = fit(np.unique(sample, axis=0)[np.random.default_rng(1).permutation(len(np.unique(sample, axis=0)))], k, recall, parts)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = shared.value.order(_matrix(b.column(1)))[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], names=["vec_id", "vec", "part"])

    placed = v.mapInArrow(tidied(place), "vec_id bigint, vec array<double>, part int")
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number a part
    blocks = {p: max(1, -(-n // block)) for p, n in sizes.items()}
    queries = v.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    n_queries = queries.count()
    halls = max(1, -(-n_queries * index.probes // (max(1, index.parts) * query_block)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            take, part, blk = [], [], []
            for i, order in enumerate(shared.value.order(_matrix(b.column(1))).tolist()):
                held = 0
                for n, p in enumerate(order):
                    if n >= shared.value.probes and held > k:
                        break
                    held += sizes.get(p, 0)
                    for c in range(blocks.get(p, 0)):
                        take.append(i)
                        part.append(p)
                        blk.append(c)
            t = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), pa.array(part, pa.int32()), pa.array(blk, pa.int32())], names=["query_id", "vec", "part", "block"])

    n_blocks = F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("part"))
    right = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int"))
    left = queries.mapInArrow(tidied(visit), "query_id bigint, vec array<double>, part int, block int").withColumn("hall", F.pmod(F.xxhash64("query_id"), F.lit(halls)).cast("int"))
    right = right.withColumn("hall", F.explode(F.sequence(F.lit(0), F.lit(halls - 1))))

    def rerank(q: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if q.num_rows and rows.num_rows:
            qi, qx = q.column("query_id").to_numpy(), _matrix(q.column("vec").combine_chunks())
            ri, rx = rows.column("vec_id").to_numpy(), _matrix(rows.column("vec").combine_chunks())
            order = np.lexsort((ri, *rx.T[:2]))
            ri, rx = ri[order], rx[order]
            # equal vectors: the k + 1 smallest ids of each
            group = np.unique(rx, axis=0, return_inverse=True)[1].ravel()
            order = np.lexsort((ri, group))
            g = group[order]
            new = np.append(True, g[1:] != g[:-1])
            at = np.arange(len(g))
            keep = order[at - np.maximum.accumulate(np.where(new, at, 0)) <= k]
            ri, rx = ri[keep], rx[keep]
            sq = (rx * rx).sum(axis=1)
            for lo in range(0, len(qi), 256):
                part = qx[lo : lo + 256]
                d = sq[None, :] - 2 * (part @ rx.T) + (part * part).sum(axis=1)[:, None]
                d[qi[lo : lo + 256, None] == ri[None, :]] = np.inf
                cut = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                tol = 1e-9 * ((part * part).sum(axis=1) + np.where(np.isfinite(cut), cut, 0) + sq.max())
                for i in range(len(part)):
                    near = np.flatnonzero((d[i] <= cut[i] + tol[i]) & np.isfinite(d[i]))
                    exact = np.sqrt(((rx[near] - part[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ri[near], exact))[:k]
                    out[0] += [int(qi[lo + i])] * len(best)
                    out[1] += ri[near[best]].tolist()
                    out[2] += exact[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    on = ["part", "block", "hall"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
