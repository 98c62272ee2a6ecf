import math
from collections import Counter

import numpy as np
import pytest
from llm_cases import LONG, no_documents, odd_documents

from quercus.llm import language_id as li
from quercus.llm.common import crc_mod

SAMPLES = {
    "en": ["the cat and the dog", "this is the house that they built", "where are the other things"],
    "de": ["der hund und die katze", "das ist das haus und der garten", "wo sind die anderen sachen"],
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(lang, t) for lang, ts in SAMPLES.items() for t in ts] + [(None, "no language"), ("fr", None)]
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(docs)


def brute_buckets(text):
    points = [ord(c) + 1 for c in text.lower()]
    for n in li.ORDERS:
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i : i + n]:
                h = (h * 0x100000001B3 + p) % 2**64
            yield ((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> 48


def test_equals_brute_force(model):
    counts = {lang: Counter(b for t in ts for b in brute_buckets(t)) for lang, ts in SAMPLES.items()}
    for text in ["the garden", "und die anderen", "katze", "x"]:
        log = {}
        for lang, c in counts.items():
            total = sum(c.values()) + li.SMOOTHING * li.BUCKETS
            log[lang] = math.log(0.5) + sum(math.log((c[b] + li.SMOOTHING) / total) for b in brute_buckets(text))
        top = max(log.values())
        odds = {k: math.exp(v - top) for k, v in log.items()}
        got = li.posteriors(model, [text])[0]
        assert model.languages == ["de", "en"]
        for k, lang in enumerate(model.languages):
            assert got[k] == pytest.approx(odds[lang] / sum(odds.values()), rel=1e-9)


def test_cut_texts_count_like_whole_ones(model, monkeypatch):
    whole = li.posteriors(model, ["the cat " * 20, None, "und " * 9])
    monkeypatch.setattr(li, "RUN", 7)
    assert np.allclose(li.posteriors(model, ["the cat " * 20, None, "und " * 9]), whole)


def test_odd_rows(spark, model):
    given = odd_documents(spark)
    rows = li.identify(given, model).collect()
    assert len(rows) == given.count()
    by = {r.doc_id: r for r in rows}
    for unlettered in (0, 1, 2, 3):
        assert (by[unlettered].lang_pred, by[unlettered].score) == ("und", 0.0)
    assert by[8].lang_pred == "en" and len(LONG) > 300_000
    assert all(0 <= r.score <= 1 for r in rows)
    kept = li.keep_identified(given, model)
    assert kept.columns == given.columns and 0 < kept.count() < given.count()


def test_empty_tables(spark, model):
    assert li.identify(no_documents(spark), model).count() == 0
    unlearned = li.fit(no_documents(spark))
    assert {r.lang_pred for r in li.identify(odd_documents(spark), unlearned).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_mod("doc_id", 3) == 1
    found = li.identify(docs, li.fit(docs.filter(~held))).join(docs.filter(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found)
