from collections import Counter

import corpus_pipeline
from framewright.llm import langid, toxicity


def test_a_language_with_long_documents_only_is_learned(spark, prose):
    rows = [(i, prose(i, 60), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(f"eau{w}ment" for w in prose(i, 150).split()), "fr") for i in range(40)]
    rows += [(2000 + i, prose(i, 300), "de") for i in range(900)] + [(3000 + i, prose(i, 30), "de") for i in range(100)] + [(4000, None, "de")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 50, 1_000)
    texts = [t for _, t, _ in rows if t]
    assert all(0 < len(t.encode()) <= 1_000 and any(t in x for x in texts) for t, _ in got)
    n = Counter(lang for _, lang in got)
    assert n["fr"] > 20 and n["de"] == n["en"] == 50
    assert all(len(t) < 300 for t, lang in got if lang == "de")  # short ones suffice


def test_languages_without_a_weight_stay_in_the_mixture(spark, make_docs, tmp_path):
    docs = make_docs([(i, "a") for i in range(300)]).union(make_docs([(1000 + i, "b") for i in range(300)], "it")).union(make_docs([(2000 + i, "c") for i in range(300)], None))
    n = Counter(r.lang for r in corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect())
    assert all(230 < n[lang] < 370 for lang in ("en", "it", None))


def test_toxicity_samples_ids_after_the_length_filter(spark, make_docs):
    docs = make_docs([(i, "x" * 900 if i % 2 else f"w{i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 4 < 2) for i in range(200)], "doc_id bigint, toxic boolean")
    got = toxicity.sample(docs, labels, 30, 100)
    assert Counter(y for _, y in got) == {0: 30, 1: 30}
