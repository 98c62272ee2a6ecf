import random
import re
import zlib
from collections import Counter

import pytest
from llm_cases import LONG, no_documents, odd_documents

from quercus.llm import spelling

LETTERS = "abàÀß"


def brute_words(rows):
    """The contract, word for word."""
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))}
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)}
    return out - {word}


def brute(words):
    """{word: (form, root, n, n_near, form_n)} by all edits of every word."""
    letters = sorted(set("".join(words)))
    near = {w: edits(w, letters) & set(words) for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows_of(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def random_words(seed, n=400):
    rng = random.Random(seed)
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(LETTERS) for _ in range(rng.choice([5, 5, 6, 7, 8, 12])))
        words[w] = rng.choice([3, 4, 7, 9, 20, 50, 300])
        if rng.random() < 0.6:
            words[rng.choice(sorted(edits(w, "ab")))] = rng.choice([3, 6, 12, 700])
    return {w: c for w, c in words.items() if len(w) >= 5}


@pytest.mark.parametrize("seed, regions, block", [(1, 3, 2048), (2, 3, 7), (3, 2, 16), (4, 5, 3)])
def test_near_words_equal_brute_force(spark, seed, regions, block):
    words = random_words(seed)
    table = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    pairs = spelling.near_pairs(table, regions, block).collect()
    assert len({frozenset((r.a, r.b)) for r in pairs}) == len(pairs)
    want = {frozenset((w, x)) for w in words for x in edits(w, LETTERS) & set(words)}
    assert {frozenset((r.a, r.b)) for r in pairs} == want


def test_blocks_of_long_words(spark):
    long_word = "ab" * 4000
    words = {long_word: 9, long_word + "a": 4, long_word[:5000] + "ß" + long_word[5001:]: 3, long_word[1:]: 3, "ba" * 4001: 5}
    table = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    got = {frozenset((r.a, r.b)) for r in spelling.near_pairs(table, 3, 2048, cells=10_000).collect()}
    assert got == {frozenset((w, x)) for w in words for x in words if w < x and within_one(w, x)}
    assert len(got) >= 4


def within_one(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_one_list_of_many_words_is_tiled(spark):
    words = {"start" + a + b + "ending": 3 for a in "abcdefghij" for b in "abcdefghijklmnopqrst"}
    table = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    spread = spelling.tiles(spelling.listed(table), block=20)
    assert spread.groupBy("key", "tile_a", "tile_b").count().agg({"count": "max"}).first()[0] <= 80
    assert spread.select("tile_a", "tile_b").distinct().count() > 10
    pairs = {frozenset((r.a, r.b)) for r in spelling.near_pairs(table, block=20).collect()}
    assert pairs == {frozenset((w, x)) for w in words for x in words if w < x and within_one(w, x)}


def test_damage_is_that_of_the_contract():
    text = " ".join("".join(random.Random(i).choices("abcdefgàÉ", k=6)) for i in range(3000)) + " MiXeD ÀÉ a x"
    for doc_id in (7, None, -3):
        assert {w.decode(): n for w, n in spelling.runs_of(doc_id, text).items() if len(w.decode()) >= 5 and n >= 3} == brute_words([(doc_id, text)])
        plain = Counter(re.findall(r"[a-zÀ-ÿ]+", text.translate({c: c + 32 for c in range(65, 91)})))
        assert 10 < sum((plain - Counter({w.decode(): n for w, n in spelling.runs_of(doc_id, text).items()})).values()) < 80


def test_equals_brute_force_on_odd_rows(spark):
    df = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert len(LONG) > 300_000
    assert rows_of(spelling.group_variants(df)) == brute(brute_words(rows))


def test_equals_brute_force_on_documents(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 5000)
    monkeypatch.setattr(spelling, "HELD_WORDS", 500)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got, want = rows_of(spelling.group_variants(df, block=16)), brute(brute_words(rows))
    assert got == want and sum(v[0] is not None for v in want.values()) > 20


def test_chains_are_followed_to_their_end(spark):
    chain = ["aaaaa" + "b" * i for i in range(20)]
    words = {w: 3 * 2**i for i, w in enumerate(chain)}
    table = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    chosen = spelling.forms(table, spelling.near_pairs(table))
    ends = {r.word: r.root for r in spelling.roots(chosen).collect()}
    assert ends == {w: chain[-1] for w in chain[:-1]}


def test_empty_table(spark):
    assert spelling.group_variants(no_documents(spark)).count() == 0
