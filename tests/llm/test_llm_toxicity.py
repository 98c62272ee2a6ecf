import random

import numpy as np
import pytest
from llm_cases import no_documents, odd_documents

from quercus.llm import toxicity as tx
from quercus.llm.boosting import Calibration, fit_isotonic, fit_trees


def corpus(seed=3, n=900):
    """Texts of invented words; toxic ones hold insults, or words that begin with an insulting stem."""
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "me", "lo", "sa", "ne"]

    def word():
        return "".join(rng.choices(syllables, k=rng.randrange(2, 4)))

    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        words = [word() for _ in range(rng.randrange(10, 60))]
        for _ in range(2 * toxic):
            bad = rng.choice(["idiot", "moron"]) if i % 2 else "gruff" + word()
            words[rng.randrange(len(words))] = bad
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return tx.fit(
        spark.createDataFrame(docs, "doc_id bigint, text string").filter("doc_id < 700"),
        spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id bigint, toxic int"),
    )


def test_lexicon_and_held_out_rows(spark, model):
    assert "idiot" in model.words and any("gruff".startswith(s[:5]) for s in model.stems)
    docs, labels = corpus()
    rows = tx.judge(spark.createDataFrame(docs[700:], "doc_id bigint, text string"), model).collect()
    right = dict(labels)
    assert sum(r.predicted == right[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_disguised_words(model):
    assert "idiot" in tx.words_of("you 1d10t and id1ot") or "idiot" in tx.words_of("an id1ot")
    heads = tx.heads_of(model.stems)
    x = dict(zip(tx.FEATURES, tx.features_of("You are an id1ot!! SHOUT", model.words, model.stems, heads)))
    assert x["lexicon_density"] > 0 and x["obfuscated"] > 0 and x["hits_near_you"] > 0 and x["exclamations"] > 0
    assert tx.features_of(None, {}, {}, set()) == [0.0] * len(tx.FEATURES)
    assert len(tx.features_of(" 1 ", {}, {}, set())) == len(tx.FEATURES)


def test_odd_rows(spark, model):
    given = odd_documents(spark)
    rows = tx.judge(given, model).collect()
    by = {r.doc_id: r.score for r in rows}
    assert len(rows) == given.count() and by[0] == by[1] and all(0 <= r.score <= 1 for r in rows)
    kept = tx.keep_civil(given, model)
    assert kept.columns == given.columns and kept.count() == given.count()


def test_empty_tables_and_one_class(spark, model):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert tx.judge(no_documents(spark), model).count() == 0
    unlearned = tx.fit(odd_documents(spark), labels)
    assert len({r.score for r in tx.judge(odd_documents(spark), unlearned).collect()}) == 1
    clean = tx.fit(odd_documents(spark), spark.createDataFrame([(3, 0), (4, 0)], "doc_id bigint, toxic int"))
    assert not tx.judge(odd_documents(spark), clean).filter("predicted = 1").count()


def test_exported_trees_equal_spark(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    df = spark.createDataFrame([(list(map(float, r)), int(l)) for r, l in zip(x, y)], "features array<double>, label int")
    trees = fit_trees(df, rounds=5, depth=3)
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    data = df.select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("y"))
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, stepSize=0.3, maxBins=64, seed=7).fit(data)
    want = [r[0][1] for r in model.transform(data).select(vector_to_array("probability")).collect()]
    assert np.allclose(trees.probability(x), want)


def test_calibration_is_monotone(spark):
    rows = spark.createDataFrame([(k / 20, int(k % 3 == 0 or k > 12)) for k in range(20)], "raw double, label int")
    c = fit_isotonic(rows)
    p = np.linspace(0, 1, 50)
    assert isinstance(c, Calibration) and (np.diff(c(p)) > 0).all() and c(p).min() >= 0 and c(p).max() <= 1


def test_lexicon_by_hand(spark):
    """Every term is weighed, however many there are: those that pass equal a count by hand."""
    docs, labels = corpus(seed=11, n=500)
    rows = [(text, toxic) for (_, text), (_, toxic) in zip(docs, labels)]
    words, stems = tx.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(5))
    n = [sum(t == k for _, t in rows) for k in (0, 1)]
    counts = {}
    for text, toxic in rows:
        for term in tx.terms_of(text):
            counts.setdefault(term, [0, 0])[toxic] += 1
    odds = {t: ((h + 0.5) / (n[1] + 1)) / ((c + 0.5) / (n[0] + 1)) for t, (c, h) in counts.items() if h >= 6}
    assert words == {t: pytest.approx(float(np.log(o))) for t, o in odds.items() if o >= 15 and not t.endswith("*")}
    assert set(stems) <= {t[:-1] for t, o in odds.items() if o >= 15 and t.endswith("*")} and stems
