import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from llm_cases import CLASH, LONG, no_documents, odd_documents

from quercus.llm import fill_in_middle as fim

MARKED = ["a <P> b", "<S>", "ends with <M>", "half <P", "<", "<<P", "S>P>M>"]


def expected(doc_id, text):
    """The contract, word for word, over Python's code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=3000), st.integers(0, 60))
def test_index_is_exact_and_bounded(steps, epsilon):
    at = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)]).astype(np.int64)
    index = fim.fit(at, epsilon)
    ranks = np.arange(len(at))
    assert (index.offsets(ranks) == at).all()
    assert np.abs(index.residual).max() <= epsilon + 1
    assert index.first[0] == 0 and (np.diff(index.first) > 0).all()


def test_even_steps_are_one_segment():
    assert len(fim.fit(np.arange(0, 3_000_000, 3)).first) == 1
    bent = np.concatenate([np.arange(5000), 5000 + 4 * np.arange(5000)])
    assert 2 <= len(fim.fit(bent).first) <= 4
    assert len(fim.fit(np.zeros(0, np.int64)).first) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé日😀<PSM> ", max_size=30), max_size=8), st.integers(1, 60))
def test_cuts_equal_slices(texts, group_bytes):
    ids = list(range(len(texts)))
    want = [expected(i, t) for i, t in zip(ids, texts)]
    digests = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in ids]
    h = [np.array([int(d[8 * k : 8 * k + 8], 16) for d in digests], np.int64) for k in (0, 1)]
    given_texts = pa.array(["left out", *texts], pa.string())[1:]
    got = fim.cut_texts(given_texts, h[0], h[1], [w[1] for w in want], group_bytes).to_pylist()
    assert [(g["n"], g["prefix_chars"], g["middle_chars"], g["told"]) for g in got] == [(w[0], w[2], w[3], w[4]) for w in want]


@pytest.fixture(scope="module")
def rows(spark):
    docs = odd_documents(spark)
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(MARKED * 20)], "doc_id bigint, text string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    told = fim.transform(both)
    return told.select("*", fim.restore(told.told, told.form).alias("restored")).collect()


def test_equals_the_contract(rows):
    assert len(LONG) > 300_000
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.told) == expected(r._row.doc_id, r._row.text)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_round_trip(rows):
    assert all(r.restored == (r._row.text or "") for r in rows)


def test_other_columns_and_repeated_rows_stay(rows):
    assert all(r._row[c] in ("extra", None) for r in rows for c in CLASH)
    assert sum(r._row.doc_id == 9 for r in rows) == 2 and sum(r._row.doc_id is None for r in rows) == 1


def test_empty_table(spark):
    assert fim.transform(no_documents(spark)).count() == 0
