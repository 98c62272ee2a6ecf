import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import no_documents, odd_documents

from quercus.llm import language_model as lm

TRAIN = ["the cat sat on the mat", "the cat ran", "a dog sat on the cat", "the dog ran on", "", "the cat sat"]


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


class Brute:
    """Backoff by definition: counts of n-grams kept by count, recursion over contexts."""

    def __init__(self, texts, order, least):
        self.order = order
        self.uni = Counter(w for t in texts for w in [*brute_words(t), ""])
        self.total, self.distinct = sum(self.uni.values()), len(self.uni)
        self.vocabulary = {w for w, n in self.uni.items() if n >= least or w == ""}
        self.grams = {}
        for k in range(2, order + 1):
            c = Counter()
            for t in texts:
                seq = ["", *brute_words(t), ""]
                c.update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
            self.grams[k] = {
                g: n for g, n in c.items()
                if n >= least and (all(w in self.vocabulary for w in g) if k == 2 else g[:-1] in self.grams[k - 1] and g[1:] in self.grams[k - 1])
            }

    def p(self, word, context):
        if not context:
            return (self.uni.get(word, 0) + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        k = len(context) + 1
        table = self.grams[k]
        if (*context, word) in table:
            return (table[(*context, word)] - lm.DISCOUNT) / self.context(context)
        return self.backoff(context) * self.p(word, context[1:])

    def context(self, context):
        return self.uni[context[0]] if len(context) == 1 else self.grams[len(context)][context]

    def backoff(self, context):
        k = len(context) + 1
        known = context[0] in self.vocabulary if len(context) == 1 else context in self.grams[len(context)]
        after = [g[-1] for g in self.grams[k] if g[:-1] == context] if known else []
        if not after:
            return 1.0
        left = 1 - sum((self.grams[k][(*context, w)] - lm.DISCOUNT) / self.context(context) for w in after)
        return left / (1 - sum(self.p(w, context[1:]) for w in after))

    def log10(self, text):
        seq = ["", *brute_words(text), ""]
        return sum(math.log10(self.p(seq[i], tuple(seq[max(0, i - self.order + 1) : i]))) for i in range(1, len(seq)))

    def base(self, text):
        return sum(math.log10(self.p(w, ())) for w in [*brute_words(text), ""])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


ASKED = [*TRAIN, "The  dog\nsat", "unknown words only", "the unknown cat sat on the mat the cat", None, "cat " * 700]


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    brute = Brute(TRAIN, order, 2)
    for context in [("",), ("the",), ("cat",), ("mat",)] + ([("the", "cat"), ("", "the"), ("sat", "on")] if order == 3 else []):
        unknown = brute.p("never seen", context)
        assert sum(brute.p(w, context) for w in brute.uni) + unknown == pytest.approx(1.0)


def test_lanes_do_not_change_scores(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ASKED))), pa.array(ASKED)], ["id", "text"])
    (chunk,) = lm.chunks(iter([batch]))
    ids = np.concatenate(chunk.texts).astype(np.int64)
    levels = lm.distinct_grams(ids, 3)
    sizes = [len(chunk.words), *[len(k) for k, _ in levels]]
    counts = [np.full(sizes[0], 9), *[n + 1 for _, n in levels]]
    backs = [np.linspace(-1, 0, n) for n in sizes[:2]]
    automaton = lm.assemble(sizes, [k for k, _ in levels], counts, backs, 1000.0)
    lengths = np.array([len(t) - 3 for t in chunk.texts])
    whole = lm.walk_texts(ids, lengths, automaton)
    monkeypatch.setattr(lm, "LANE", 3)
    assert np.allclose(lm.walk_texts(ids, lengths, automaton), whole)


def test_odd_rows(spark):
    model = lm.fit(odd_documents(spark))
    given = odd_documents(spark)
    rows = lm.score(given, model).collect()
    assert len(rows) == given.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == by[1].n_tokens == by[2].n_tokens == 1 and by[0].score == by[1].score
    assert sum(r.doc_id == 9 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert all(r.n_known == r.n_tokens and r.base_score < 0 for r in rows)


def test_empty_tables(spark):
    model = lm.fit(no_documents(spark))
    assert lm.score(no_documents(spark), model).count() == 0
    row = lm.score(frame(spark, ["a b"]), model).first()
    assert (row.n_tokens, row.n_known, row.score) == (3, 0, 0.0)


def test_better_than_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.fit(docs.filter("doc_id % 5 <> 0"))
    rows = lm.score(docs.filter("doc_id % 5 = 0"), model).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("chunk", [lm.CHUNK, 5])
def test_joined_scores_equal_brute_force(spark, monkeypatch, order, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    brute = Brute(TRAIN, order, 2)
    model = lm.fit(frame(spark, TRAIN), order=order)
    assert (model.total, model.distinct) == (brute.total, brute.distinct)
    rows = {r.doc_id: r for r in lm.score(frame(spark, ASKED), model).collect()}
    assert len(rows) == len(ASKED)
    for i, text in enumerate(ASKED):
        words = [*brute_words(text), ""]
        assert rows[i].n_tokens == len(words) and rows[i].n_known == sum(w in brute.uni for w in words)
        assert rows[i].base_score == pytest.approx(brute.base(text), rel=1e-9)
        assert rows[i].score == pytest.approx(brute.log10(text), rel=1e-9)


def test_least_count_does_not_grow_with_the_corpus(spark):
    filler = spark.range(3000).selectExpr("id + 10 AS doc_id", "repeat('filler words here and there ', 400) AS text")
    docs = frame(spark, ["rare pair", "rare pair"]).unionByName(filler)  # six million tokens, one pair twice
    grams = {r.gram: r.n for r in lm.fit(docs).grams.filter("gram LIKE '%rare%'").collect()}
    assert grams == {"rare": 2, " rare": 2, "rare pair": 2}
    assert lm.fit(docs).grams.filter("gram = 'pair '").first().n == 2
