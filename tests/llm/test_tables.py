import hashlib
import math

import numpy as np
import pytest

from framewright.llm import chroma, mixing, sharding


def test_shards_fit_and_only_large_buckets_split(spark, make_docs, prose):
    rows = [(i, prose(i, 40)) for i in range(200)] + [(7, prose(7, 40))] * 3 + [(None, None), (300, ""), (301, prose(301, 900))]
    limit = 3000
    got = sharding.shard(make_docs(rows), limit).collect()
    assert len(got) == len(rows)
    size, n = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        n[r.shard] = n.get(r.shard, 0) + 1
    assert all(v <= limit or n[k] == 1 for k, v in size.items())
    names = {k.split(".")[0] for k in size}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for k in names:  # a shard stands at its depth because the bucket above is too large
        if k:
            assert sum(v for s, v in size.items() if s.startswith(k[:-1])) > limit
    assert sharding.shard(make_docs(rows).limit(0), limit).count() == 0


def test_rows_alike_in_all_bits_are_dealt(spark, make_docs):
    got = sharding.shard(make_docs([(1, "x" * 100)] * 40), 500).collect()
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + 1
    assert len(got) == 40 and len(size) >= 8


def test_own_columns_stay_as_they_are(spark, make_docs):
    docs = make_docs([(i, "x" * 100) for i in range(30)]).withColumnsRenamed({"component": "name", "source": "high", "lang": "bits", "score": "shard_bits"})
    got = sharding.shard(docs.selectExpr("*", "7 as depth", "'l' as low"), 500)
    assert got.columns == [*docs.columns, "low", "shard", "depth", "n_bytes"]
    assert {(r.name, r.high, r.bits, r.shard_bits, r.low) for r in got.collect()} == {("x", None, "en", 2.0, "l")}


def brute_copies(u, rate):
    k, p = 0, math.exp(-rate)
    f = p
    while f < u:
        k += 1
        p *= rate / k
        f += p
    return k


def test_copies_invert_the_poisson_distribution(spark, make_docs):
    rows = [(i, "x") for i in range(300)]
    docs = make_docs(rows[:200], "en").union(make_docs(rows[200:], "fr")).union(make_docs([(None, None)], None))
    got = mixing.mix(docs, {"en": 0.3, "fr": 0.6}, "lang")
    rate = {"en": 0.3 * 301 / 200, "fr": 0.6 * 301 / 100, None: 0.1 * 301 / 1}
    have = {}
    for r in got.collect():
        assert r.copy < r.copies
        have[(r.doc_id, r.lang)] = have.get((r.doc_id, r.lang), 0) + 1
    for i, lang in [(i, "en" if i < 200 else "fr") for i in range(300)]:
        u = (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        assert have.get((i, lang), 0) == brute_copies(u, rate[lang])
    assert mixing.mix(docs.limit(0), {"en": 1.0}, "lang").count() == 0


def test_rows_without_an_id_draw_by_their_columns(spark, make_docs):
    docs = make_docs([(None, f"text {i % 40}") for i in range(80)])
    n = {}
    for r in mixing.mix(docs, {"en": 1.0}, "lang").collect():
        n[r.text] = n.get(r.text, 0) + 1
    assert len(set(n.values())) > 1 and all(v % 2 == 0 for v in n.values())  # the two of a text alike, texts apart
    own = docs.withColumnsRenamed({"component": "_steps", "score": "steps"}).selectExpr("*", "map(1, 2) as who")
    assert mixing.mix(own, {"en": 1.0}, "lang").columns == [*own.columns, "copies", "copy", "shuffle_key"]


def test_high_rates_are_drawn_by_halving(spark, make_docs):
    docs = make_docs([(0, "x")], "fr").union(make_docs([(i, "x") for i in range(1, 4000)], "en"))
    got = mixing.mix(docs, {"fr": 0.75}, "lang", shuffle=False).where("lang = 'fr'").count()  # a mean of 3,000
    assert abs(got - 3000) < 6 * 3000**0.5
    steps = [0.1, 0.2, 0.2, 0.7, 0.95]
    d = spark.createDataFrame([(float(u), steps) for u in (0.05, 0.1, 0.15, 0.2, 0.3, 0.94, 0.95, 0.99)], "u double, s array<double>")
    assert [r.n for r in d.select(mixing.below(d.s, d.u).alias("n")).collect()] == [sum(x < u for x in steps) for u in (0.05, 0.1, 0.15, 0.2, 0.3, 0.94, 0.95, 0.99)]


def tune(seed, n=70):
    r = np.random.default_rng(seed)
    return r.normal(size=n).tolist()


def test_recordings_align_at_their_offset(spark):
    base = chroma.render(tune(1, 90))
    step = 2 * chroma.HOP * 12  # bytes of twelve frames
    noise = np.frombuffer(base, "<i2") + np.random.default_rng(0).normal(0, 150, len(base) // 2)
    audio = {0: base, 20: base[step:], 21: base, 40: noise.astype("<i2").tobytes(), 60: chroma.render(tune(2)), 61: b"", 62: None, 80: b"\0\0" * 50_000, 81: b"\1\0" * 100}
    df = spark.createDataFrame(list(audio.items()), "id bigint, audio binary")
    got = {r.id: r for r in chroma.align(chroma.fingerprints(df, "id", "audio"), lambda i: i % 20 == 0).collect()}
    assert len(got) == len(audio)
    assert got[21].class_id == 0 and got[21].n_links is None
    assert (got[20].n_links, got[20].best_class in (0, 40), got[20].best_offset) == (2, True, -12)
    assert got[0].n_links == 2 and got[60].n_links == 0
    prints = {i: chroma.fingerprint(np.frombuffer(a or b"", "<i2").astype(float)) for i, a in audio.items()}
    off, err = chroma.brute_align(prints[0], prints[40])
    assert off == 0 and err <= 0.15
    pairs = {(a, b) for a in (0, 20, 40, 60, 80) for b in (0, 20, 40, 60, 80) if a != b and (m := chroma.brute_align(prints[a], prints[b])) and m[1] <= 0.15}
    assert {a: sum(x == a for x, _ in pairs) for a in (0, 20, 40, 60, 80)} == {a: got[a].n_links for a in (0, 20, 40, 60, 80)}
    assert chroma.align(chroma.fingerprints(df.limit(0), "id", "audio"), lambda i: i % 20 == 0).count() == 0


def test_links_of_noisy_recordings_against_every_offset(spark):
    """Copies with bits wrong at random and their starts cut off: what every offset finds, landmarks find nearly as often."""
    r = np.random.default_rng(3)
    base = [r.integers(-(2**31), 2**31, 60).astype(np.int32) for _ in range(12)]
    rows = {20 * i: b for i, b in enumerate(base)}
    for k, share in enumerate((0.01, 0.03, 0.05)):
        for i, b in enumerate(base):
            wrong = np.packbits(r.random((60, 32)) < share, axis=1).view("<i4").ravel()
            rows[1000 * (k + 1) + 20 * i + 1] = (b ^ wrong)[int(r.integers(0, 10)) :]
    df = spark.createDataFrame([(i, [int(x) for x in f]) for i, f in rows.items()], "id bigint, fp array<int>")
    got = {r.id: r for r in chroma.align(df, lambda i: (i % 20 == 0) & (i < 1000)).collect() if r.n_links is not None}
    want = found = 0
    for i in range(12):
        true = [j for j in rows if j % 20 == 1 and (j - 1) % 1000 == 20 * i and chroma.brute_align(rows[20 * i], rows[j])[1] <= 0.15]
        want, found = want + len(true), found + got[20 * i].n_links
    assert want == 36 and found <= want and found >= 0.9 * want


def test_integral_image_sums_rectangles():
    s = np.frombuffer(chroma.render(tune(5)), "<i2").astype(float)
    c, fp = chroma.chroma(s), chroma.fingerprint(s)
    for i in (0, 7, len(fp) - 1):
        want = 0
        for k, (kind, y, h, w) in enumerate(chroma.filters()):
            side = [np.mean([c[i + x : i + x + n, p : p + m].sum() / max(1, n * m) for x, n, p, m in part]) for part in chroma._areas(kind, y, 0, h, w)]
            q = int(np.digitize(np.round(np.log1p(4 * side[0]) - np.log1p(4 * side[1]), 9), (-0.25, 0, 0.25)))
            want |= (q ^ (q >> 1)) << (2 * k)
        assert want == int(fp[i]) & 0xFFFFFFFF
