import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from framewright.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    b = bpe.load(PATH, P.PATTERN)
    return b, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_ids_are_those_of_the_library_and_decode_back(both, prose):
    b, lib = both
    r = random.Random(1)
    texts = [prose(i) for i in range(20)] + ["", " ", "a" * 5000, "ab" * 3000, " " * 4000, "é" * 3000, "日本語テキスト" * 600, "don't we'll <|endoftext|>", "\n\n  x\t1234567890123"]
    texts += ["".join(r.choice("abcdefghé \n'") for _ in range(r.randint(1, 4000))) for _ in range(40)]
    for t, (ids, raw, packed) in zip(texts, bpe.encode_texts(texts, b), strict=True):
        want = lib.encode_ordinary(t)
        assert ids == " ".join(map(str, want))
        assert raw == t.encode()
        assert len(packed) == 4 * len(want)
        assert b.encode(t) == want


def test_long_pieces_in_rounds_of_many_merges(both):
    b, lib = both
    r = random.Random(2)
    for alphabet in ("ab", "abc", "aeiou", "etaoinshr", "theTHEing", "éa", "日本a"):
        for n in (2100, 3500, 9000):
            t = "".join(r.choice(alphabet) for _ in range(n))
            assert b._encode_long(t.encode()) == lib.encode_ordinary(t)


def test_query_columns_nulls_and_repeats(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")])
    rows = bpe.encode(docs, PATH, P.PATTERN).collect()
    assert len(rows) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, empty, empty)}
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_decode_inverts_encode(spark, make_docs, prose):
    docs = make_docs([(i, prose(i)) for i in range(5)])
    ids = bpe.encode(docs, PATH, P.PATTERN, keep="ids")
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(ids, PATH, P.PATTERN).collect()}
    assert got == {i: prose(i) for i in range(5)}
