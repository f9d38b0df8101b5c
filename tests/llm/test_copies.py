import numpy as np

from framewright.llm import copies


def edited(text, r, n):
    w = text.split()
    for k in r.choice(len(w), n, replace=False):
        w[k] = f"changed{int(r.integers(1000))}"
    return " ".join(w)


def kept_by_brute_force(rows):
    first = {}
    for (i, _), g in zip(rows, copies.brute_groups([t for _, t in rows]), strict=True):
        first[g] = min(first.get(g, i), i)
    return sorted(first.values())


def test_near_copies_of_five_words_and_a_similarity_of_four_fifths(spark, make_docs, prose):
    r = np.random.default_rng(5)
    rows = [(i, prose(i, 160)) for i in range(12)]
    rows += [(100 + 20 * n + i, edited(rows[i][1], r, n)) for n in (1, 2, 3, 4, 5) for i in range(12)]
    rows += [(300 + i, edited(rows[0][1], r, 2)) for i in range(40)] + [(400, None), (401, ""), (402, "a b"), (403, "A  b")]
    got = sorted(x.doc_id for x in copies.keep_one(make_docs(rows)).collect())
    want = kept_by_brute_force(rows)
    assert set(want) <= set(got)  # no document goes that has no near copy
    assert len(set(got) - set(want)) <= 1  # 64 bits at a radius of 14 miss about one pair in a hundred


def test_rounds_blocks_and_repeated_rows(spark, make_docs, prose, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, edited(prose(1, 120), r, int(r.integers(1, 4)))) for i in range(60)] + [(100, prose(2)), (100, prose(2))]
    want = kept_by_brute_force(rows)
    for partners, block in ((1, 30_000), (8, 7)):
        monkeypatch.setattr(copies, "PARTNERS", partners)
        monkeypatch.setattr(copies, "BLOCK", block)
        assert sorted(x.doc_id for x in copies.keep_one(make_docs(rows), radius=20).collect()) == want
    docs = make_docs(rows).withColumnRenamed("component", "text_hash")
    assert copies.keep_one(docs.limit(0)).count() == 0
    one = copies.keep_one(docs.where("doc_id = 100"))
    assert one.columns == docs.columns and one.count() == 1
    nulls = make_docs([(None, "x y"), (None, "x y"), (None, "z"), (3, "Z")])
    assert sorted((x.doc_id or -1, x.text) for x in copies.keep_one(nulls).collect()) == [(-1, "x y"), (3, "Z")]


def test_a_crowd_of_edits_that_are_not_similar_enough_names_few_pairs(spark, make_docs, prose, monkeypatch):
    r = np.random.default_rng(7)
    rows = [(i, edited(prose(1, 150), r, int(r.integers(3, 6)))) for i in range(160)] + [(200 + i, edited(prose(1, 150), r, 1)) for i in range(20)]
    named, verified = [], copies._verified
    monkeypatch.setattr(copies, "_verified", lambda pairs, *rest: (named.append(pairs.count()), verified(pairs, *rest))[1])
    got = sorted(x.doc_id for x in copies.keep_one(make_docs(rows), radius=20).collect())
    want = kept_by_brute_force(rows)
    assert got == want and len(want) > 40
    assert sum(named) <= 12 * len(rows)  # and not in proportion to all pairs of those that stay


def test_the_prefix_filter_leaves_out_no_similar_pair(spark):
    r = np.random.default_rng(10)
    base = r.integers(-(2**62), 2**62, 120)
    sets = []
    for n in range(90):  # of different sizes, a part of their own and a part of one base
        own = r.integers(-(2**62), 2**62, int(r.integers(0, 25)))
        sets.append(sorted({*r.choice(base, int(r.integers(3, 12)) if n % 9 == 0 else int(r.integers(85, 121)), replace=False).tolist(), *own.tolist()}))
    wide = ", ".join(f"w{k} bigint" for k in range(copies.WORDS))
    nodes = spark.createDataFrame([(i, len(x), i // 2, *[0] * copies.WORDS) for i, x in enumerate(sets)], f"s bigint, n bigint, c bigint, {wide}")
    found = spark.createDataFrame(list(enumerate(sets)), "s bigint, found array<bigint>")
    for least in (0.6, 0.8, 0.95):
        got = {(min(x.a, x.b), max(x.a, x.b)) for x in copies._crowded(nodes, found, 14, least).collect()}
        alike = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
        want = {(a, b) for b in range(len(sets)) for a in range(b) if a // 2 != b // 2 and alike(a, b) >= least}
        assert want <= got
        assert want or least > 0.8
        assert all(a // 2 != b // 2 for a, b in got)


def test_blocks_compare_all_pairs_within_the_radius():
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 20)
    w = np.array([[int(b) ^ sum(1 << int(k) for k in r.choice(63, int(r.integers(0, 12)), replace=False)) for b in base] for _ in range(40)]).ravel()
    t = {"s": np.arange(len(w)), "n": np.full(len(w), 100), "c": np.arange(len(w)) // 3, **{f"w{k}": w if k == 0 else np.zeros(len(w), np.int64) for k in range(copies.WORDS)}}
    d = np.bitwise_count(w.view(np.uint64)[:, None] ^ w.view(np.uint64)[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero((d <= 10) & (t["c"][:, None] != t["c"][None, :])), strict=True)}
    parts = [(list(range(0, 16)), 2), (list(range(16, 32)), 2), (list(range(32, 48)), 2), (list(range(48, 64)), 1)]  # 7 = 10 - 4 + 1
    for large in (0, 4096):
        copies.LARGE = large
        got = set()
        for bits, threshold in parts:
            got |= set(zip(*(x.tolist() for x in copies.Block(bits, threshold, 10, 0.8).near(t, t)), strict=True))
        assert got == want
    copies.LARGE = 4096


def test_majority_and_partners():
    r = np.random.default_rng(9)
    h = r.integers(0, 2**64, 70_001, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
    assert copies.majority(h) == sum(1 << k for k in range(64) if 2 * bits[:, k].sum() > len(h))
    x, y = np.repeat(np.arange(5), [1, 2, 3, 9, 20]), np.arange(35)
    now, more = copies.chosen(x, y, 1, 3)
    assert np.bincount(x[now]).tolist() == [1, 2, 3, 3, 3] and more.tolist() == [3, 4]
