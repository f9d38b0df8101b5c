import hashlib
import tempfile
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import esais, substrings


def check_order(t, cap, base, budget):
    with tempfile.TemporaryDirectory() as d:
        p, l = esais.sort_all(np.asarray(t, np.int64), cap, d, budget, base)
    n, t = len(t), list(map(int, t))
    cut = lambda i: t[i : i + cap]
    assert sorted(p.tolist()) == list(range(n))
    assert [cut(i) for i in p] == sorted(map(cut, range(n)))
    for k in range(1, n):
        a, b, c = cut(p[k - 1]), cut(p[k]), 0
        while c < min(len(a), len(b)) and a[c] == b[c]:
            c += 1
        assert l[k] == c


@pytest.mark.parametrize("base", [1, 3, 1 << 24])
@pytest.mark.parametrize("budget", [64, 1 << 20])
def test_suffix_order_and_common_prefixes(base, budget):
    r = np.random.default_rng(base + budget)
    for k in range(60):
        t = r.integers(0, int(r.integers(1, 6)), int(r.integers(1, 70)))
        if k % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 5)], 5)
        check_order(t, int(r.choice([5, 20, 1000])), base, budget)


@pytest.fixture(scope="module")
def texts(prose):
    a = [prose(i, 260) for i in range(8)]
    return [*a, a[2], a[3][:700] + a[4][300:1000], "zz" + a[3][100:800] + "é" * 300, "a" * 1500, "ab" * 700 + "c" * 500, a[5][:399], a[6][:400] + "!", "", None, "short"]


@pytest.mark.parametrize("how", [{}, {"hot_bytes": 500, "shard_bytes": 4096}])
def test_removed_bytes_are_those_of_brute_force(spark, make_docs, texts, how):
    raw = [(t or "").encode() for t in texts]
    want = substrings.brute(raw, 400)
    got = {r.doc_id: r for r in substrings.dedup(make_docs(list(enumerate(texts))), **how).collect()}
    assert len(got) == len(texts)
    for i, (gone, spans, left) in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw[i]), gone, spans, hashlib.sha256(left).hexdigest())


def test_repeated_rows_null_ids_and_empty_table(spark, make_docs, prose):
    t = prose(1, 200)
    docs = make_docs([(1, t), (1, t), (None, prose(2)), (None, None)])
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup(docs).collect())
    assert got == [(0, 0), (0, 0), (1, len(t)), (1, len(t))]
    assert substrings.dedup(docs.limit(0)).count() == 0
    stripped = substrings.strip(docs)
    assert stripped.columns == docs.columns
    assert sorted(r.text or "" for r in stripped.collect()) == sorted(["", "", "", prose(2)])


def test_regions_name_every_window_once(texts):
    raw = [(t or "").encode() for t in texts]
    owner, start, size, *_ = substrings.regions(raw)
    for i, t in enumerate(raw):
        k = np.argsort(start[owner == i])
        s, n = start[owner == i][k], size[owner == i][k]
        assert n.sum() == max(0, len(t) - 399)
        assert (s[1:] == (s + n)[:-1]).all()


def brute_words(texts, length):
    """What is left of each text's words without those in a string of ``length`` words that stands more than once."""
    seen = {}
    split = [(t or "").encode().split() for t in texts]
    for w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in split:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append([x.decode() for j, x in enumerate(w) if j not in gone])
    return out


def test_types_and_runs_a_block_at_a_time():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 40):
        for k in (1, 2, 3, 9):
            t = r.integers(0, k, n)
            s = esais.Suffixes(t, 5, "")
            want = [False] * n
            for i in range(n - 2, -1, -1):
                want[i] = bool(t[i] < t[i + 1] or (t[i] == t[i + 1] and want[i + 1]))
            assert all(s.s_types(block).tolist() == want for block in (1, 2, 7, 1 << 20))
            assert [s.run_length(p) for p in range(n)] == [next((q - p for q in range(p, n) if t[q] != t[p]), n - p) for p in range(n)]


@pytest.mark.parametrize("how", [{}, {"hot_bytes": 500, "shard_bytes": 4096}])
def test_passages_of_more_than_fifty_words_go_and_shorter_ones_stay(spark, make_docs, prose, how):
    w = [prose(50 + i, 200).split() for i in range(8)]
    join = lambda *x: " ".join(a for b in x for a in b)
    texts = [join(w[0]), join(w[1][:40], w[0][20:71], w[1][40:]), join(w[2], w[0][100:150]), join(w[3]), join(w[3]).replace(" ", "\n  ", 90)]
    texts += [join(w[4][:60]), "un" + join(w[4][:60]), join(w[5], list("abc") * 30), join(w[6], ["a"] * 120), "  " + join(w[7], w[7][10:90]) + "\t", join(["x"] * 51), join(["é"] * 50), "", None, " "]
    assert len(join(w[0][20:71])) < 400
    got = {r.doc_id: r.text for r in substrings.strip(make_docs(list(enumerate(texts))), 51, words=True, **how).collect()}
    assert [(got[i] or "").split() for i in range(len(texts))] == brute_words(texts, 51)
    assert got[2] == texts[2] and got[13] is None


def test_memory_follows_the_slice_and_not_the_batch(tmp_path):
    """An Arrow batch is read some bytes of text at a time, and places are compared a block at a time."""
    texts = ["x" * 1_500_000, None, "y" * 9_000_000, "", "z" * 3_000_000, "w"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    got = list(substrings._slices([batch, batch.slice(0, 0), batch.slice(2)], 1))
    assert [b.column(0).to_pylist() for b in got] == [[0, 1], [2], [3, 4, 5], [2], [3, 4, 5]]
    assert all(b.column(1).to_pylist() == [texts[i] for i in b.column(0).to_pylist()] for b in got)
    r = np.random.default_rng(4)
    text, a, b = r.integers(0, 2, 300_000).astype(np.int16), r.integers(0, 300_000, 200_000), r.integers(0, 300_000, 200_000)
    tracemalloc.start()
    try:
        common = esais.Suffixes(text, 20, str(tmp_path))._compare(a, b, 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
    for i in range(0, 200_000, 997):
        x, y = text[a[i] : a[i] + 20].tolist(), text[b[i] : b[i] + 20].tolist()
        assert common[i] == next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
