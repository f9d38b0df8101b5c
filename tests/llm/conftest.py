import random

import pytest

WORDS = "the of and to in it was that for on with as his they at be this from have or one had by word but not what all were we when your can said there".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) as a table of the documents' shape, with columns whose names operators use inside."""

    def make(rows, lang="en"):
        data = [(i, t, lang, None, 1, "x", 2.0) for i, t in rows]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, score double")

    return make


@pytest.fixture(scope="session")
def prose():
    def text(seed, n=200):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "er", "ing", "ed", str(r.randint(0, 99))]) for _ in range(n))

    return text
