"""One document of every group of near copies: SimHash candidates, verified on whole sets of shingles.

Texts with the same set of ``size``-word shingles are one node.  A node's fingerprint is the majority of its shingles' hashes, and
nodes within ``radius`` of 64 bits are found by the generalised pigeonhole principle of simhash.py (correlated bits
together, thresholds by dynamic programming, probe and verify).  Sets that are similar have similar sizes, so nodes meet
only within neighbouring bands of sizes.  What is near on 64 bits must be so on 256, and then have a Jaccard similarity of
``least`` or more on the whole sets, which is exact; only such pairs are linked.

At a similarity of 0.8 two fingerprints differ in about 9.7 of 64 bits (standard deviation 2.9).  The radius of 14 finds
98.7 % of the similar pairs of the check's smaller documents table (by all pairs); groups have several, so fewer documents
are missed.  The cost of a radius this wide grows faster than the table: at 14 million nodes a part has about 16 bits, and a
node meets about one in a hundred of the nodes of its size.

No group is gathered.  A part's nodes are dealt by size band and leading bits, and blocks split what is crowded.  First each
node is compared with one of its bucket, which joins large groups; then with all nodes of other components.  A node names its
nearest ``PARTNERS`` partners.  Where it has more, it and they are the crowd, whose pairs a prefix filter finds without naming
all: the shingles of every crowded set are ordered by how many of these sets hold them, the rarest first, and sets of sizes n
and m that share o or more have one in common among their first n - o + 1 and m - o + 1.  Of many edits of one text that lie
just short of ``least`` nearly none have.  The filter loses nothing: what it leaves out is not similar enough.

Defined cases: null text is text without words, and texts without words are copies of each other; fewer words than a shingle make
one shingle; ids may be null or repeated: rows are told apart by (doc_id, text), and of equal ones one stays; an empty
table gives an empty one; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import MIX, drop_tables, few, give_back, mix64, ragged, stash, tidied, unused
from framewright.llm.graph import components
from framewright.llm.simhash import majority, plan, shingle_hashes

RADIUS = 14
WORDS = 4  # of 64 bits, in the wide fingerprint
#: Bits of the wide fingerprint that may differ: at a similarity of 0.8 they are 39, with a standard deviation of 5.7.
WIDE_RADIUS = 56
SAMPLE = 20_000
#: Rows (an id and a hash) that are broadcast at most.
SMALL = 50_000
PARTNERS = 8
#: Classes of sizes that a similar set of the crowd may be away, at most.
CLASSES = 5
#: Nodes of one task's block, about.
BLOCK = 30_000
#: What looking up a key costs, in comparisons.
PROBE_COST = 12.0
#: Pairs of a bucket from which on it is compared as a matrix.
LARGE = 4096


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different shingles of a text as sorted hashes."""
    return np.unique(np.array(shingle_hashes((text or "").encode("utf-8"), size), np.uint64))


def wide_print(found: np.ndarray) -> list[int]:
    """Majorities of the shingles' hashes and of three rehashes of them."""
    if not len(found):
        return [0] * WORDS
    with np.errstate(over="ignore"):
        return [majority(found if k == 0 else mix64(found + MIX * np.uint64(k))) for k in range(WORDS)]


def ball(bits: int, radius: int) -> list[int]:
    """All numbers of ``bits`` bits with ``radius`` set at most."""
    return [sum(1 << b for b in c) for k in range(min(bits, radius) + 1) for c in combinations(range(bits), k)]


def take_bits(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of 64-bit integers, next to each other."""
    out = np.zeros(len(x), np.int64)
    for k, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _column_bits(col: F.Column, bits: list[int]) -> F.Column:
    return reduce(lambda s, kb: s + F.shiftleft(F.shiftrightunsigned(col, kb[1]).bitwiseAND(F.lit(1)).cast("int"), kb[0]), enumerate(bits), F.lit(0))


class Block:
    """Comparison of probing nodes with indexed ones under one part of the bits."""

    def __init__(self, bits: list[int], threshold: int, radius: int, least: float):
        self.bits, self.masks, self.radius, self.least = bits, ball(len(bits), threshold), radius, least

    def near(self, x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index in x, index in y) of different components that may be similar."""
        kx, ky = (take_bits(t["w0"].view(np.uint64), self.bits) for t in (x, y))
        ox, oy = np.lexsort((x["c"], kx)), np.lexsort((y["c"], ky))
        kx, ky = kx[ox], ky[oy]
        starts = np.flatnonzero(np.append(True, kx[1:] != kx[:-1])) if len(kx) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(kx))
        size = ends - starts
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for m in self.masks:
            lo, hi = (np.searchsorted(ky, kx[starts] ^ m, side=side) for side in ("left", "right"))
            met = size * (hi - lo)
            for k in np.flatnonzero(met > LARGE).tolist():  # a large bucket is a matrix
                i, j = ox[starts[k] : ends[k]], oy[lo[k] : hi[k]]
                for at in range(0, len(i), step := max(1, 2_000_000 // len(j))):
                    p = i[at : at + step]
                    a, b = np.nonzero(np.bitwise_count(x["w0"][p].view(np.uint64)[:, None] ^ y["w0"][j].view(np.uint64)[None, :]) <= self.radius)
                    self._filter(x, y, p[a], j[b], found)
            few = np.flatnonzero((met > 0) & (met <= LARGE))
            if not len(few):
                continue
            rows = ragged(starts[few], size[few])  # small ones are lists of pairs
            first, many = np.repeat(lo[few], size[few]), np.repeat((hi - lo)[few], size[few])
            edge = np.append(0, np.cumsum(many))
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(edge, edge[at] + 2_000_000, side="right")) - 1)
                u, v = np.repeat(ox[rows[at:to]], many[at:to]), oy[ragged(first[at:to], many[at:to])]
                ok = np.bitwise_count((x["w0"][u] ^ y["w0"][v]).view(np.uint64)) <= self.radius
                self._filter(x, y, u[ok], v[ok], found)
                at = to
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = (np.concatenate([f[n] for f in found]) for n in (0, 1))
        once = np.unique(i * len(ky) + j)  # a pair may meet under several masks
        return once // len(ky), once % len(ky)

    def _filter(self, x: dict, y: dict, u: np.ndarray, v: np.ndarray, found: list) -> None:
        if not len(u):
            return
        n, m = x["n"][u], y["n"][v]
        ok = (x["c"][u] != y["c"][v]) & (np.minimum(n, m) >= self.least * np.maximum(n, m) - 1e-9)
        u, v = u[ok], v[ok]
        far = sum(np.bitwise_count((x[w][u] ^ y[w][v]).view(np.uint64)).astype(np.int64) for w in (f"w{k}" for k in range(WORDS)))
        ok = far <= WIDE_RADIUS
        if ok.any():
            found.append((u[ok], v[ok]))


def chosen(x: np.ndarray, y: np.ndarray, salt: int, most: int, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are named, ``most`` of each x at most, the least far first and then by a hash of y; and the x that have more."""
    with np.errstate(over="ignore"):
        h = mix64(y.view(np.uint64) + MIX * np.uint64(salt + 1))
    order = np.lexsort((h, x) if far is None else (h, far, x))
    new = np.append(True, x[order][1:] != x[order][:-1]) if len(x) else np.zeros(0, bool)
    at = np.arange(len(x))
    rank = at - np.maximum.accumulate(np.where(new, at, 0)) if len(x) else at
    return order[rank < most], np.unique(x[order[rank >= most]])


def _search(nodes: DataFrame, parts: list[tuple[list[int], int]], n_nodes: int, radius: int, least: float, most: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(a, b) candidates of different components; and the crowd (s): nodes that have more than ``most``, and those that they have."""
    cols = ["s", "n", "c", *[f"w{k}" for k in range(WORDS)]]
    lead = max(0, int(np.ceil(np.log2(max(1.0, n_nodes / (8 * BLOCK))))))  # leading bits of the key that deal a part's nodes
    left, right = [], []
    for k, (bits, t) in enumerate(parts):
        first = bits[: min(lead, len(bits))]
        cell = _column_bits(F.col("w0"), first)
        flips = ball(len(first), t)
        right.append(nodes.select(F.lit(k).alias("part"), "band", cell.alias("cell"), *cols))
        both = nodes.select("band", cell.alias("cell"), *cols)
        both = both.withColumn("flip", F.explode(F.lit(flips))).withColumn("up", F.explode(F.lit([0, 1])))
        left.append(both.select(F.lit(k).alias("part"), (F.col("band") + F.col("up")).alias("band"), F.col("cell").bitwiseXOR(F.col("flip")).alias("cell"), *[F.col(c).alias(f"x_{c}") for c in cols]))
    index, probe = (reduce(DataFrame.unionByName, x) for x in (right, left))
    on = ["part", "band", "cell"]
    # crowded cells are compared in blocks
    crowd = stash(index.groupBy(*on).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select(*on, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), paths)
    if crowd.take(1):
        index = index.join(crowd, on, "left").withColumn("j", F.pmod(F.xxhash64("s"), F.coalesce("blocks", F.lit(1))).cast("int"))
        index = index.withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        probe = probe.join(crowd, on, "left").withColumn("i", F.pmod(F.xxhash64("x_s"), F.coalesce("blocks", F.lit(1))).cast("int"))
        probe = probe.withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        on = [*on, "i", "j"]
    shared = [Block(b, t, radius, least) for b, t in parts]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, far, extra = (np.zeros(0, np.int64) for _ in range(4))
        if left.num_rows and right.num_rows:
            x, y = {c: left.column(f"x_{c}").to_numpy() for c in cols}, {c: right.column(c).to_numpy() for c in cols}
            i, j = shared[left.column("part")[0].as_py()].near(x, y)
            a, b = x["s"][i], y["s"][j]
            far = sum(np.bitwise_count((x[w][i] ^ y[w][j]).view(np.uint64)).astype(np.int64) for w in (f"w{k}" for k in range(WORDS)))
            take, more = chosen(a, b, 0, most, far)
            extra = np.union1d(more, b[np.isin(a, more)])
            a, b, far = a[take], b[take], far[take]
        if left.num_rows > 5_000:
            give_back()
        none = np.arange(len(a) + len(extra)) >= len(a)
        return pa.table({"a": pa.array(np.concatenate([a, extra])), "b": pa.array(np.concatenate([b, extra]), mask=none), "far": pa.array(np.concatenate([far, extra]), mask=none)})

    found = stash(probe.groupBy(*on).cogroup(index.groupBy(*on)).applyInArrow(compare, "a bigint, b bigint, far bigint").distinct(), paths)
    # of what several blocks name for a node again ``most``: as many rows a node as blocks that it is in times that
    rank = F.row_number().over(Window.partitionBy("a").orderBy("far", F.xxhash64("b")))
    ranked = stash(found.where("b is not null").withColumn("rank", rank), paths)
    over = ranked.where(F.col("rank") > most)
    crowd = found.where("b is null").select(F.col("a").alias("s")).unionByName(over.select(F.col("a").alias("s"))).unionByName(over.select(F.col("b").alias("s"))).distinct()
    return ranked.where(F.col("rank") <= most).select("a", "b"), stash(crowd, paths)


def _crowded(nodes: DataFrame, sets: DataFrame, radius: int, least: float) -> DataFrame:
    """Pairs (a, b) of different components among the crowd's nodes that are near and pass the prefix filter."""
    share, step = least / (1 + least), float(-np.log(least) / CLASSES * 1.000001)
    tokens = sets.select("s", F.explode("found").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("s")  # a node's shingles that no other has stand first, and need no rows
    place = F.row_number().over(own.orderBy("often", "token")) - F.count("*").over(own)
    placed = tokens.join(often, "token").select("s", "token", place.alias("at")).join(nodes, "s")
    placed = placed.withColumn("at", F.col("at") + F.col("n")).withColumn("class", F.floor(F.log("n") / F.lit(step)).cast("int"))

    def side(mark: str, up: int) -> DataFrame:
        """A node's first shingles for every class of sizes that it may meet, under the lower and the upper class."""
        rows = placed.withColumn("away", F.explode(F.lit(list(range(CLASSES + 1))))).withColumn("other", F.col("class") + F.col("away") * F.lit(up))
        low = F.greatest(F.exp(F.col("other") * F.lit(step)) * F.lit(1 - 1e-9), F.col("n") * F.lit(least))
        rows = rows.where(F.col("at") <= F.col("n") - F.ceil(F.lit(share) * (F.col("n") + low) - F.lit(1e-6)) + 1)
        return rows.select("token", F.least("class", "other").alias("lower"), "away", *[F.col(c).alias(f"{mark}_{c}") for c in ("s", "n", "c", "at", *(f"w{k}" for k in range(WORDS)))])

    x, y = side("x", 1), side("y", -1)
    both = F.ceil(F.lit(share) * (F.col("x_n") + F.col("y_n")) - F.lit(1e-6))
    apart = [F.bit_count(F.col(f"x_w{k}").bitwiseXOR(F.col(f"y_w{k}"))) for k in range(WORDS)]
    ok = (F.col("x_c") != F.col("y_c")) & ((F.col("away") > 0) | (F.col("x_s") < F.col("y_s")))
    ok &= (F.col("x_at") <= F.col("x_n") - both + 1) & (F.col("y_at") <= F.col("y_n") - both + 1)
    ok &= (apart[0] <= radius) & (reduce(lambda a, b: a + b, apart) <= WIDE_RADIUS)
    return x.join(y, ["token", "lower", "away"]).where(ok).select(F.col("x_s").alias("a"), F.col("y_s").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    x = sets.select(F.col("s").alias("a"), F.col("found").alias("x"))
    y = sets.select(F.col("s").alias("b"), F.col("found").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("i") >= F.lit(least) * (F.size("x") + F.size("y") - F.col("i")) - 1e-9).select("a", "b")


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """One row of every group of near copies, with all its columns: the one with the smallest doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wide = [f"w{k}" for k in range(WORDS)]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(2):
                f = shingle_set(t.as_py(), size)
                found.append((xxhash.xxh3_64_intdigest(f.tobytes()), len(f), *wide_print(f)))
            cols = [pa.array(np.array([f[k] for f in found], np.uint64).view(np.int64)) for k in range(2 + WORDS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "text_hash", "s", "n", *wide])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), size).view(np.int64) for t in part.column(1)], pa.list_(pa.int64()))], names=["s", "found"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    paths: list[str] = []  # tables that go before this function ends
    named = stash(rows.mapInArrow(tidied(name), f"doc_id {kind}, text_hash bigint, s bigint, n bigint, " + ", ".join(f"{w} bigint" for w in wide)), paths)
    step = -np.log(least) * 1.000001  # sets that are similar are in the same band of sizes or in neighbouring ones
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.lit(float(step))).cast("int")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = stash(named.groupBy("s").agg(first, *[F.first(c).alias(c) for c in ("n", *wide)]).withColumn("band", band), paths)
    worded = nodes.where("n > 0").drop("first")
    sizes = {r.band: r.k for r in worded.groupBy("band").agg(F.count("*").alias("k")).collect()}  # some dozens of rows
    n_nodes = sum(sizes.values())
    some = worded.orderBy(F.xxhash64("s"), "s").limit(SAMPLE).select("w0").toArrow().column(0).to_numpy().view(np.uint64)
    share = sum(k * (k + sizes.get(b + 1, 0)) for b, k in sizes.items()) / max(1, n_nodes) ** 2
    parts = plan(some, n_nodes, radius, PROBE_COST, share)

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = few(nodes.join(ids, "s").select("s", F.col("first.doc_id").alias("_d"), F.col("first.text_hash").alias("_h")), SMALL)
        texts = rows.join(wanted, rows.doc_id.eqNullSafe(wanted._d) & (rows.text_hash == wanted._h)).select("s", "text")
        return stash(texts.mapInArrow(tidied(whole), "s bigint, found array<bigint>").dropDuplicates(["s"]), paths)

    links, label, crowd = None, None, None
    for k in range(3):
        here = worded.withColumn("c", F.col("s")) if label is None else stash(worded.join(label, "s", "left").withColumn("c", F.coalesce("c", "s")), paths)
        sets = None
        if k == 0:  # one node of each bucket, under each part
            keys = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), _column_bits(F.col("w0"), b).alias("key")) for p, (b, _) in enumerate(parts)]))
            dealt = here.select(keys.alias("x"), "band", "s", "n", *wide).select("x.part", "x.key", "band", "s", "n", *wide)
            centre = dealt.groupBy("part", "key", "band").agg(F.min(F.struct(F.xxhash64("s").alias("h"), F.col("s").alias("b"), *[F.col(w).alias(f"v{w}") for w in wide])).alias("y")).select("part", "key", "band", "y.*")
            far = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"v{w}"))) for w in wide])
            new = dealt.join(centre, ["part", "key", "band"]).where((F.col("s") != F.col("b")) & (far <= WIDE_RADIUS)).select(F.col("s").alias("a"), "b")
        elif k == 1:
            new, crowd = _search(here, parts, n_nodes, radius, least, PARTNERS, paths)
        elif crowd.take(1):
            sets = sets_of(crowd)
            new = _crowded(here.join(crowd, "s", "left_semi"), sets, radius, least)
        else:
            break
        pairs = stash(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), paths)
        if pairs.take(1):
            sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()) if sets is None else sets
            good = _verified(pairs, sets, least)
            links = stash(good if links is None else links.unionByName(good).distinct(), paths)
            label = stash(components(links).select(F.col("node").alias("s"), F.col("component").alias("c")), paths)
    group = nodes if label is None else nodes.join(label, "s", "left")
    group = group.withColumn("g", F.col("s") if label is None else F.coalesce("c", "s"))
    key = ["doc_id", "text_hash"]
    stay = group.groupBy("g").agg(F.min("first").alias("k")).select("k.doc_id", "k.text_hash", F.lit(1).alias("stays")).distinct()
    seen = named.groupBy(*key).agg(F.count("*").alias("times"))
    same = seen.doc_id.eqNullSafe(stay.doc_id) & (seen.text_hash == stay.text_hash)
    out = seen.join(stay, same, "left").select(seen.doc_id.alias("_d"), seen.text_hash.alias("_h"), "times", "stays")
    repeated = out.where("stays = 1 and times > 1").limit(1).count() > 0
    gone = stash(out.where("stays is null").select("_d", "_h"))
    drop_tables(docs.sparkSession, paths)
    gone = few(gone, SMALL)
    mark = unused(docs, "text_hash")
    kept = docs.withColumn(mark, F.xxhash64("text"))
    kept = kept.join(gone, kept["doc_id"].eqNullSafe(gone["_d"]) & (kept[mark] == gone["_h"]), "left_anti")
    if repeated:  # of rows alike in id and text one stays
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.drop(mark)


def brute_groups(texts: list[str | None], size: int = 5, least: float = 0.8) -> list[int]:
    """The group of each text, comparing all pairs; for tests."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    return group
