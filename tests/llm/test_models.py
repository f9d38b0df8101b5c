import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from framewright.llm import ann, langid, lm, toxicity

SYL = {"de": "sch ung ein ver keit der lich", "fr": "eau eux ment tion le que elle", "es": "cion ado mente illa que os"}


def speech(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYL[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_documents(spark):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(["de", "fr", "es"] * 60)]
    rows += [(900, None, "de"), (901, "123 !?", "fr"), (902, "", None), (903, speech("de", 903), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:180]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred == "de"
    assert langid.predict(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs.where("lang is null")).collect()} == {"und"}
    kept = {r.doc_id for r in langid.accept(docs).collect()}
    assert kept == set(range(180)) | {903}


def test_words_of_switched_text_and_forward_backward():
    m = langid.train([(speech(lang, i), lang) for lang in ("de", "fr") for i in range(40)], chains=600)
    words = langid.words_of(speech("de", 77, 12) + " " + speech("fr", 78, 12))
    post = m.label_words([words])[0]
    assert np.allclose(post.sum(axis=1), 1)
    assert (post[:10].argmax(axis=1) == 0).mean() > 0.8 and (post[-10:].argmax(axis=1) == 1).mean() > 0.8
    # against all label sequences
    r = np.random.default_rng(0)
    e, t, s = r.normal(size=(4, 1, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    from itertools import product

    want, total = np.zeros((4, 3)), 0.0
    for y in product(range(3), repeat=4):
        w = math.exp(s[y[0]] + sum(e[i, 0, y[i]] for i in range(4)) + sum(t[y[i], y[i + 1]] for i in range(3)))
        total += w
        for i in range(4):
            want[i, y[i]] += w
    post, z = langid.forward_backward(e, t, s, np.array([4]))
    assert np.allclose(post[:, 0], want / total) and np.isclose(z[0], math.log(total))


INSULTS = ["idiot", "moron", "scum", "clown"]


def toxic_rows(prose, n=120):
    rows, labels = [], []
    for i in range(n):
        w = prose(i, 80).split()
        bad = i % 3 == 0
        if bad:
            w.insert(i % 70, INSULTS[i % 4])
            w.insert((i * 7) % 70, INSULTS[(i // 3) % 4])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    return rows, labels


def test_posteriors_of_whole_chains():
    """Blocks passed on from one to the next give what one pass over the whole chain gives."""
    r = np.random.default_rng(12)
    sizes = np.array([1, 63, 64, 65, 500, 0, 129])
    emit, flat = r.normal(0, 3, (40, 3)), r.integers(0, 40, sizes.sum())
    trans, start = r.normal(0, 2, (3, 3)), r.normal(0, 1, 3)
    for slab in (2, 4096):
        got = langid.posteriors(emit, flat, sizes, trans, start, slab)
        at = 0
        for n in sizes.tolist():
            if n:
                want, _ = langid.forward_backward(emit[flat[at : at + n]][:, None, :], trans, start, np.array([n]))
                assert np.allclose(got[at : at + n], want[:, 0], atol=1e-9)
            at += n
    assert langid.posteriors(emit, flat[:0], sizes[:0], trans, start).shape == (0, 3)


def test_numerals_are_no_letters():
    assert langid.words_of("\u00b2 \u00bd \u2167 \u0663 12 _") == [] and langid.words_of("A\u00b2b \u00c9t\u00e9") == ["a", "b", "\u00e9t\u00e9"]


def test_toxic_documents_and_misspellings(spark, make_docs, prose):
    rows, labels = toxic_rows(prose)
    docs = make_docs([*rows, (500, "the idiiot was there"), (501, prose(501)), (502, None), (503, ""), (504, "of moronn and")])
    table = spark.createDataFrame([*labels, (1, None, 1), (None, 1, 1)], "doc_id bigint, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score(docs, table).collect()}
    assert len(got) == len(rows) + 5
    assert all(got[i].predicted == y for i, y, _ in labels)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert (got[500].predicted, got[504].predicted, got[501].predicted) == (1, 1, 0)
    assert got[502].score == got[503].score and 0 <= got[502].score <= 1
    assert {r.score for r in toxicity.score(docs, table.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), table).count() == 0


def test_toxicity_training_hashes_its_words_in_slices():
    """Of many different words only the bucket numbers are held, not the hashes of all their n-grams at once."""
    r = random.Random(3)
    rows = [(" ".join(f"{r.getrandbits(48):x}" for _ in range(250)) + (" idiot" if i % 2 else ""), i % 2) for i in range(400)]
    tracemalloc.start()
    try:
        model = toxicity.train(rows, epochs=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 160e6 and model.only is None
    words = [w for t, _ in rows[:80] for w in t.split()]
    b, n = toxicity._features(words)
    want, sizes = toxicity.subword_buckets(words, toxicity.SIZES, toxicity.BITS)
    assert len(words) > 2 * toxicity.SLICE and (b == want).all() and (n == sizes).all()


def test_toxicity_scores_by_plain_loops():
    """A bag's n-gram vectors averaged, put through the softmax; a document scores as its most toxic bag of two words."""
    r = np.random.default_rng(13)
    embed, out, bias = r.normal(0, 1, (1 << toxicity.BITS, toxicity.DIM)), r.normal(0, 1, (toxicity.DIM, 2)), r.normal(0, 1, 2)
    model = toxicity.Model(embed, out, bias, 0.25)
    texts = ["some words to look at", "one", "", None, "UPPER lower mixed|parted", "a " * 50]
    want = []
    for t in texts:
        words = toxicity.words_of(t)
        rows = [embed[toxicity.subword_buckets([w], toxicity.SIZES, toxicity.BITS)[0]] for w in words]
        scores = []
        for i in range(max(1, len(words) - toxicity.WINDOW + 1)):
            if words:
                z = np.concatenate(rows[i : i + toxicity.WINDOW]).mean(axis=0) @ out + bias
                scores.append(np.exp(z[1]) / np.exp(z).sum())
        want.append(max(scores, default=0.25))
    assert model.score(texts) == pytest.approx(want, abs=1e-5)


def test_lm_against_dictionaries(spark, make_docs, prose):
    rows = [(i, prose(i, 60)) for i in range(24)] + [(50, None), (51, ""), (52, "Zzz É qq"), (None, prose(3, 10))]
    learn = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    raw = [(t or "").encode() for t in learn]
    counts = {}
    for t in raw:
        for w in [*t.lower().split(), "end"]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    got = lm.score(make_docs(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        t = (text[r.doc_id] or "").encode()
        words = [*t.lower().split(), "end"]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words), abs=1e-6)
        assert r.score == pytest.approx(lm.brute_log10(raw, t), rel=1e-9, abs=1e-6)
    few = {(r.doc_id, r.held_out): r.score for r in lm.score(make_docs(rows).repartition(3), frequent=40).collect()}  # nearly all joined
    assert few == pytest.approx({(r.doc_id, r.held_out): r.score for r in got}, rel=1e-12)
    none = lm.score(make_docs([(i, "x") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])).first()
    assert (none.train_tokens, none.base_score) == (0, 0.0)


def test_codes_sum_to_one(spark, prose):
    """Over all symbols that may follow a context, known or not, with the trie as the table that scoring uses."""
    g, _ = lm.grams([(i, b"", prose(i).encode(), True) for i in range(5)])
    seen = dict(zip(*(x.tolist() for x in np.unique(g, return_counts=True)), strict=True))
    for ctx in (b"the o", b"xxxxx", b"ing t"):
        base = 0
        for b in ctx:
            base = base << 9 | b
        keys = [base << 9 | s for s in range(lm.ALPHABET)]
        rows = [(k, n, 1) for k, n in seen.items()] + [(k, 0, 1) for k in keys if k not in seen]
        short = np.array([k & 0x3FFFF for k in seen]), np.array(list(seen.values()))
        strings = spark.createDataFrame(rows, "key bigint, n bigint, m bigint")
        got = {r.key: r.value for r in lm.codes(strings, lm._summed([short[0]], [short[1]])).collect()}
        assert sum(10 ** got[k] for k in keys) == pytest.approx(1.0, abs=1e-9)


def test_pieces_of_long_texts():
    texts = [b"", b"ab", bytes(range(97, 123)) * 3, b"x" * 5]
    whole, lens = lm.grams([(i, b"", t, True) for i, t in enumerate(texts)])
    for limit in (5, 7, 26, 1000):
        parts = list(lm.pieces(texts, limit))
        assert np.concatenate([lm.grams(p)[0] for p in parts]).tolist() == whole.tolist()
        owner = [x[0] for p in parts for x in p]
        size = np.concatenate([lm.grams(p)[1] for p in parts])
        assert np.bincount(owner, size).tolist() == lens.tolist()
    text = b"Some words  of\tsome LENGTH and averylongword that is not cut\n"
    assert [w for part in lm.words_of(text, 4) for w in part] == text.lower().split()
    codes = lm.Codes(np.arange(0, 9000, 3), np.arange(3000) / 7)
    value, found = codes(np.array([3, 0, 1, 8997, 300]))
    assert value.tolist() == [1 / 7, 0.0, 0.0, 2999 / 7, 100 / 7] and found.tolist() == [True, True, False, True, True]
    with pytest.raises(ValueError):
        lm.looked_up(np.array([3, 1]), codes, lm.Codes(np.zeros(0, np.int64), np.zeros(0)))


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=(12, 16))
    x = (centre[r.integers(0, 12, 1500)] + 0.3 * r.normal(size=(1500, 16))).astype(np.float32)
    x[700:760] = x[5]  # one common vector
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)]
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0] * 3), (2400, []), (None, rows[3][1]), (2500, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    got = {}
    for q in ann.search(df, lambda i: i % 50 == 0, block=400).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    assert set(got) == {i for i in range(0, 1500, 50)}
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and len({f[1] for f in found}) == 10
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
        assert all(d[v] == pytest.approx(s, abs=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        d[i] = np.inf
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9
    few = ann.search(df.where("vec_id < 4"), lambda i: i == 0).collect()
    assert sorted(f.vec_id for f in few) == [1, 2, 3]
    assert ann.search(df.limit(0), lambda i: i == 0).count() == 0
