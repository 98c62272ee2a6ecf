import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from llm_cases import LONG, ODD_TEXTS, no_documents, odd_documents
from tokenizers import Tokenizer

from quercus.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ids():
    return packing.TokenIds(PATH)


def by_library(library, text):
    return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


def test_ids_equal_the_library(ids, library):
    assert ids.core is not None
    odd = ["a  b", " x", "x ", "don't I'VE we'll", "a\n\nb", "　a b", "a  b", "1 2  3", "\x1c a \x1f b", "é é"]
    for text in [t for t in ODD_TEXTS if t] + odd:
        assert ids(text) == by_library(library, text), repr(text[:50])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é'st  \n\t 　.!1日😀<|>endoftext"), max_size=40))
def test_ids_equal_the_library_on_any_text(text):
    assert packing_ids(text) == by_library(LIBRARY, text)


LIBRARY = Tokenizer.from_file(PATH)
packing_ids = packing.TokenIds(PATH)


def test_remembered_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    few = packing.TokenIds(PATH)
    text = " ".join(f"word{i}" for i in range(50))
    assert few(text) == by_library(library, text) and len(few.known) <= 5


def test_other_kinds_of_tokenizer_files():
    other = packing.TokenIds(WORDS)
    assert other.core is None
    assert other("Some words, here") == by_library(Tokenizer.from_file(WORDS), "Some words, here")


def brute_place(lengths, size):
    """The rule, word for word: try every open bin and a new one, take the least sum of squares."""
    gaps, out = [], []

    def squares(open_gaps):
        return sum(open_gaps.count(g) ** 2 for g in set(open_gaps) if g)

    for s in lengths:
        options = []
        for g in sorted({g for g in gaps if g >= s}):
            after = gaps[:]
            after[after.index(g)] -= s
            options.append((squares(after), 0, g))
        options.append((squares(gaps + [size - s]), 1, size))
        _, new, g = min(options)
        if new:
            gaps.append(size - s)
        else:
            gaps[len(gaps) - 1 - gaps[::-1].index(g)] -= s
        out.append(g)
    return out, len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_place_follows_the_rule(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 5, 8, 13, 20]) for _ in range(60)]
    bins, offsets = packing.place(np.array(lengths), 20)
    used, n = brute_place(lengths, 20)
    assert [20 - o for o in offsets] == used and bins.max() + 1 == n


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check(rows, texts, library, length):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    for doc, text in texts.items():
        whole = (by_library(library, text) if text else b"") + bytes(4)
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        n = len(whole) // 4
        assert [r["piece"] for r in own] == list(range(-(-n // length)))
        assert sum(r["length"] for r in own) == n and all(r["length"] == length for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(whole[4 * r["start"] : 4 * (r["start"] + r["length"])])


def test_pack(spark, library):
    df = odd_documents(spark).filter("doc_id <> 9 AND doc_id IS NOT NULL")
    rows = rows_of(packing.pack(df, PATH, length=64, shard_pieces=500))
    assert len(LONG) > 300_000
    check(rows, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}, library, 64)


def test_repeated_rows_and_null_ids(spark):
    rows = rows_of(packing.pack(odd_documents(spark), PATH))
    assert sum(r["doc_id"] == 9 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_empty_table(spark):
    assert packing.pack(no_documents(spark), PATH).count() == 0


def test_few_sequences(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rows_of(packing.pack(df, PATH))
    check(rows, {r.doc_id: r.text for r in df.collect()}, library, packing.LENGTH)
    least = -(-sum(r["length"] for r in rows) // packing.LENGTH)
    assert len({r["sequence_id"] for r in rows}) <= 1.04 * least + 1


@pytest.mark.parametrize("key", [None, 3])
def test_repeated_rows_spread_over_shards(spark, key):
    df = spark.createDataFrame([(key, "the same few words")] * 4000, "doc_id bigint, text string").repartition(4)
    shards = [r["sequence_id"] >> 40 for r in rows_of(packing.pack(df, PATH, length=64, shard_pieces=500))]
    assert len(shards) == 4000 and set(shards) == set(range(8))
    assert max(shards.count(k) for k in range(8)) < 700
