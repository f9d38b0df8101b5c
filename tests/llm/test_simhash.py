import numpy as np
import pytest
import xxhash

from framewright.llm import graph, simhash


def brute_print(text, size=4):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("hot", [2000, 2])
def test_links_are_complete(spark, hot):
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 12, dtype=np.int64).astype(np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in r.integers(0, 64, r.integers(0, 6))) for b in base for _ in range(8)]
    values = sorted({*near, 0, 1, (1 << 64) - 1})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    links = simhash.near_links(df, 4, hot=hot, block=3)
    got = {x.node: x.component for x in graph.components(links).collect()}
    comp = {}
    for v in values:
        s = v - (1 << 64) if v >> 63 else v
        comp.setdefault(got.get(s, s), set()).add(v)
    want = {}
    for v, c in brute_components(values, 4).items():
        want.setdefault(c, set()).add(v)
    assert {frozenset(x) for x in comp.values()} == {frozenset(x) for x in want.values()}


def test_query_against_brute_force(spark, make_docs, prose):
    long = prose(1, 3000)
    rows = [(1, long), (2, long.upper()), (3, long.replace("the", "thee", 1)), (4, None), (5, ""), (6, " \t\n"), (7, "a b"), (8, "A\x0bB"), (9, prose(9)), (9, prose(9)), (None, prose(10)), (11, "é É x y z")]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    fp = {}
    for i, t in rows:
        fp.setdefault(i, []).append(brute_print(t))
    for r in got:
        assert int(r.fingerprint, 16) in fp[r.doc_id]
    comp = brute_components(sorted({v for x in fp.values() for v in x}), 4)
    first = {}
    for i, t in rows:
        c = comp[brute_print(t)]
        first[c] = i if first.get(c) is None else first[c] if i is None else min(first[c], i)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, first[comp[brute_print(t)]]) for i, t in rows}


def test_keep_one_leaves_one_row_of_each_group(spark, make_docs, prose):
    rows = [(1, prose(1)), (2, prose(1)), (2, prose(1)), (3, prose(3)), (None, prose(3)), (None, prose(4)), (5, None), (6, "")]
    kept = simhash.keep_one(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (True, 0)]
    assert simhash.keep_one(make_docs(rows).limit(0)).count() == 0


def test_thresholds_add_up_and_are_cheapest():
    cost = [[0, 5, 9, 30], [0, 1, 2, 3], [0, 7, 7, 7]]
    t = simhash.allocate(cost, 1)
    assert sum(t) == 1
    from itertools import product

    assert sum(c[x + 1] for c, x in zip(cost, t, strict=True)) == min(sum(c[x + 1] for c, x in zip(cost, p, strict=True)) for p in product(range(-1, 3), repeat=3) if sum(p) == 1)


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
