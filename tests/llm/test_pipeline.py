import hashlib
import math
import random
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from framewright.llm import bpe, copies, langid
from framewright.llm.queries import ORACLE_SQL, QUERIES, WEIGHTS


def test_stages_keep_the_columns_and_work_on_all_rows(spark, make_docs, prose, tmp_path):
    rows = [(i, prose(i, 150)) for i in range(30)] + [(100, prose(0, 150)), (101, None), (102, "12 34"), (103, "intro " + prose(5, 150)[:500] + " outro")]
    docs = make_docs(rows)
    docs = docs.union(make_docs([(200 + i, " ".join(f"eau{w}ment" for w in prose(i, 60).split())) for i in range(20)], "fr"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, docs))
    assert [n for n, _ in seen] == ["language", "near_duplicates", "repeated_passages", "mixture", "tokens"]
    language, near, passages, mixed, tokens = (d for _, d in seen)
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(language) == set(range(30)) | {100, 103} | set(range(200, 220))
    assert ids(near) == ids(language) - {100}
    assert ids(passages) == ids(near)
    short = {r.doc_id: r for r in passages.collect()}
    assert len(short[103].text) < 200 and short[103].n_chars == len(short[103].text)
    assert ids(mixed) <= ids(near) and mixed.columns == language.columns
    assert tokens.count() == mixed.count()


def without_repeats(texts, length=51):
    """Texts without the windows of ``length`` words that stand more than once, as lists of words; by counting every window."""
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_every_stage_against_brute_force(spark, make_docs, prose, tmp_path):
    """Each stage on what the one before it kept: its rows are those of a plain version."""
    r = random.Random(5)
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, prose(i, 120)) for i in range(12)] + [(20 + i, prose(30 + i, 40) + " " + passage + " " + prose(50 + i, 40)) for i in range(3)]
    rows += [(40, rows[1][1]), (41, " ".join(w if k != 60 else "other" for k, w in enumerate(rows[2][1].split()))), (42, None), (43, "12 34 56"), (44, "")]
    english = make_docs(rows)
    french = [(60 + i, " ".join(f"eau{w}ment" for w in prose(70 + i, 60).split())) for i in range(8)]
    docs = english.union(make_docs(french, "fr"))
    r.shuffle(rows)
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = (before, docs.collect())
    ids = lambda rows: sorted(x.doc_id for x in rows)

    before, after = held["language"]
    model = langid.train(langid.sample(spark.createDataFrame(before, english.schema), 400, 8192))
    said = model.predict([x.text for x in before])
    assert ids(after) == sorted(x.doc_id for x, (lang, score) in zip(before, said, strict=True) if lang != "und" and score >= 0.35)

    before, after = held["near_duplicates"]
    first = {}
    for x, g in zip(before, copies.brute_groups([x.text for x in before]), strict=True):
        first[g] = min(first.get(g, x.doc_id), x.doc_id)
    assert ids(after) == sorted(first.values()) and len(first) < len(before)

    before, after = held["repeated_passages"]
    want = dict(zip([x.doc_id for x in before], without_repeats([x.text for x in before]), strict=True))
    assert {x.doc_id: x.text.split() for x in after} == want and any("shared5" in x.text for x in before) and not any("shared5" in x.text for x in after)
    assert all(x.n_chars == len(x.text) for x in after)

    before, after = held["mixture"]
    size = Counter(x.lang for x in before)
    stated = sum(WEIGHTS[g] for g in size if g in WEIGHTS)
    copies_of = Counter(x.doc_id for x in after)
    for x in before:
        rate = WEIGHTS[x.lang] / stated * sum(n for g, n in size.items() if g in WEIGHTS) / size[x.lang]
        u = (int(hashlib.md5(f"mix|{x.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k, p = 0, math.exp(-rate)
        f = p
        while f < u:
            k += 1
            p *= rate / k
            f += p
        assert copies_of[x.doc_id] == k

    before, after = held["tokens"]
    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((x.doc_id, len(i := lib.encode_ordinary(x.text)), sha(" ".join(map(str, i)).encode()), sha(x.text.encode())) for x in before)
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in after) == want


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
