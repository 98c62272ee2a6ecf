import numpy as np
import pytest
from llm_cases import no_documents, odd_documents
from pyspark.sql import functions as F
from test_llm_language_model import ASKED, TRAIN, Brute, brute_words, frame

from quercus.llm import corpus_scoring as cs, language_model as lm


@pytest.mark.parametrize("chunk, entries", [(lm.CHUNK, cs.PART_ENTRIES), (5, 7), (20, 3)])
def test_scores_equal_brute_force(spark, chunk, entries):
    texts = [*TRAIN, *ASKED]
    brute = Brute(TRAIN, 2, 2)
    rows = {r.doc_id: r for r in cs.score_corpus(
        frame(spark, texts), F.col("doc_id") < len(TRAIN), chunk_tokens=chunk, part_entries=entries).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = [*brute_words(text), ""]
        assert rows[i].n_tokens == len(words) and rows[i].n_known == sum(w in brute.uni for w in words)
        assert rows[i].train_tokens == brute.total
        assert rows[i].base_score == pytest.approx(brute.base(text), rel=1e-9)
        assert rows[i].score == pytest.approx(brute.log10(text), rel=1e-9)


def test_scores_equal_those_of_the_joined_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trains = F.col("doc_id") % 5 != 0
    model = lm.fit(docs.filter(trains))
    want = {r.doc_id: r for r in lm.score(docs, model).collect()}
    got = cs.score_corpus(docs, trains).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, model.total)
        assert r.base_score == pytest.approx(w.base_score, rel=1e-9) and r.score == pytest.approx(w.score, rel=1e-9)


def test_odd_rows(spark):
    given = odd_documents(spark)
    rows = cs.score_corpus(given, F.lit(True)).collect()
    assert len(rows) == given.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == by[1].n_tokens == by[2].n_tokens == 1 and by[0].score == by[1].score
    assert sum(r.doc_id == 9 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert all(r.n_known == r.n_tokens and r.base_score < 0 for r in rows)


def test_empty_tables(spark):
    assert cs.score_corpus(no_documents(spark), F.lit(True)).count() == 0
    row = cs.score_corpus(frame(spark, ["a b"]), F.lit(None).cast("boolean")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


@pytest.mark.parametrize("kind", [np.int32, np.int64, np.float64])
def test_packed_arrays_come_back(kind):
    values = np.array([0, 1, -1, 255, 256, 70_000, -(1 << 31)], kind)
    for given in (values, values[:0], np.tile(values, 1000)[::2]):
        back = cs.numbers(cs.packed(given), kind)
        assert back.dtype == kind and back.tolist() == given.tolist()


def test_pair_lists_are_ordered_and_small():
    seed = np.random.default_rng(3)
    ids = seed.permutation(60_000)
    pairs = np.unique(seed.integers(0, 50_000, 200_000) << 32 | (50_000 * seed.random(200_000) ** 4).astype(np.int64))
    lists = cs.sent_pairs(pairs, ids, 3)
    assert sorted(np.concatenate([at for _, at in lists]).tolist()) == list(range(len(pairs)))
    for _, at in lists:
        first, second = ids[pairs[at] >> 32], ids[pairs[at] & 0xFFFFFFFF]
        assert (np.diff(second) >= 0).all() and (np.diff(first)[np.diff(second) == 0] > 0).all()
        packed = len(cs.packed(first)) + len(cs.packed(np.diff(second, prepend=-1)))
        assert packed < 3 * len(at)  # two numbers below 60,000 take four bytes
