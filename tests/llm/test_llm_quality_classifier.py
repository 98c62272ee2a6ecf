import random

import pytest
from llm_cases import no_documents, odd_documents

from quercus.llm import quality_classifier as qc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        good = int(rng.random() < 0.7)
        words = ["".join(rng.choices("abcdefg", k=rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))]
        text = " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words)
        source = rng.choice(["a", "b"]) if good or rng.random() < 0.3 else "junk"
        docs.append((i, text, "en", source, len(text)))
        if i % 2:
            labels.append((i, good))
    return docs, labels, {}


@pytest.fixture(scope="module")
def model(spark):
    docs, labels, _ = corpus()
    return qc.fit(
        spark.createDataFrame(docs, SCHEMA).filter("doc_id < 400"),
        spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id bigint, quality int"),
    )


def test_held_out_rows(spark, model):
    docs, labels, _ = corpus()
    rows = {r.doc_id: r for r in qc.judge(spark.createDataFrame(docs[400:], SCHEMA), model).collect()}
    asked = [(i, q) for i, q in labels if i >= 400]
    assert sum(rows[i].predicted == q for i, q in asked) >= 0.97 * len(asked)
    assert all(r.kept == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    # the metadata alone tell less, but something
    share = {q: sum(rows[i].metadata_score for i, x in asked if x == q) / sum(x == q for _, x in asked) for q in (0, 1)}
    assert share[1] > share[0]


def test_views_share_no_input():
    assert len(qc.text_features("A b.")) == len(qc.TEXT_FEATURES)
    assert qc.text_features(None) == qc.text_features("") == [0.0] * len(qc.TEXT_FEATURES)
    assert qc.metadata_features(None, None, None) != qc.metadata_features("en", None, None)
    assert qc.metadata_features("en", "a", float("nan"))[0] == 0.0 == qc.metadata_features("en", "a", -5)[0]


def test_odd_rows(spark, model):
    given = odd_documents(spark)
    rows = qc.judge(given, model).collect()
    assert len(rows) == given.count() and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark, model):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert qc.judge(no_documents(spark), model).count() == 0
    unlearned = qc.fit(odd_documents(spark, with_clash=False), none)
    assert len({r.score for r in qc.judge(odd_documents(spark), unlearned).collect()}) == 1


def test_all_unlabelled_rows_take_part(spark, monkeypatch):
    """No bound on unlabelled rows: each is scored in each round, and all of them weigh a fixed share together."""
    docs, labels, _ = corpus(300)
    docs += [(10_000 + i, *docs[i % 300][1:]) for i in range(24_000)]
    seen = []

    def watched(rows, features, size):
        by = {r["weight"]: r["count"] for r in rows.groupBy("weight").count().collect()}
        seen.append(by)
        return fit_linear(rows, features, size)

    fit_linear = qc.fit_linear
    monkeypatch.setattr(qc, "fit_linear", watched)
    model = qc.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int"), rounds=1)
    own, taught = seen[0][1.0], [by for by in seen[2:4] if len(by) == 2]
    assert taught and max(sum(k for w, k in by.items() if w < 1) for by in taught) > 20_000
    for by in taught:
        assert sum(w * k for w, k in by.items() if w < 1) <= qc.PSEUDO_SHARE * own * 1.001
    rows = {r.doc_id: r for r in qc.judge(spark.createDataFrame(docs[:300], SCHEMA), model).collect()}
    assert sum(rows[i].predicted == q for i, q in labels) >= 0.97 * len(labels)
