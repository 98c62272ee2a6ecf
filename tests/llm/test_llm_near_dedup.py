import random

import numpy as np
import pytest
from llm_cases import no_documents, odd_documents

from quercus.llm import near_dedup as nd
from quercus.llm.shingles import groups, shingles, word_hashes


def brute_tokens(text, words=5):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).replace(" ", "_").split()
    w = [x.replace("_", " ") for x in w]
    out, seen = set(), {}
    if w:
        for i in range(max(len(w) - words, 0) + 1):
            s = tuple(w[i : i + words])
            seen[s] = seen.get(s, 0) + 1
            out.add((s, seen[s]))
    return out


def brute_classes(rows, threshold=nd.THRESHOLD):
    """Least id of the component of each (id, text)."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [brute_tokens(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (a and b and len(a & b) / len(a | b) >= threshold):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def near_copies(n, seed=1):
    """A text, copies of it with ever more words changed, texts that share a passage with it, copies of copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [" ".join(base)]
    for k in range(n):
        words = base[:]
        for _ in range(k % 8):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        rows.append(" ".join(words))
        if k % 5 == 0:
            rows.append(" ".join(base[:40] + [f"q{rng.randrange(10**6)}" for _ in range(80)]))
        if k % 7 == 0:
            rows.append(rows[-1] + " tail")
    return list(enumerate(rows))


def test_words_and_shingles():
    raw = [b"The  cat\tsat on THE mat", b"", b"cat", "é É the".encode()]
    row, word = word_hashes(raw)
    assert row.tolist() == [0] * 6 + [2] + [3] * 3
    assert word[0] == word[4] == word[9] and word[1] == word[6] and word[7] != word[8]
    row, shingle, count = shingles([b"a b c a b c a b c", b"a b", b"x", b"x "], 3)
    assert sorted(count[row == 0].tolist()) == [2, 2, 3]
    assert (row == 1).sum() == 1 and shingle[row == 2] == shingle[row == 3]


def test_groups_hold_every_text():
    given = ["a" * 3_000_000, "b", None, "c" * 5_000_000, "d"]
    assert [t for _, g in groups(given) for t in g] == [(t or "").encode() for t in given]


def test_signatures_estimate_the_weighted_similarity():
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(300)]
    docs = [" ".join(base + base[:k] * r) for k, r in ((0, 0), (50, 1), (100, 3), (300, 1), (20, 9))]
    row, shingle, weight = shingles([d.encode() for d in docs], 5)
    sig = nd.signatures(row, shingle, weight, len(docs), 4096)
    assert np.isfinite(sig).all()
    exact = [brute_tokens(d) for d in docs]
    for k in range(len(docs)):
        share = len(exact[0] & exact[k]) / len(exact[0] | exact[k])
        assert (sig[0] == sig[k]).mean() == pytest.approx(share, abs=0.035)


def test_signature_of_a_text_does_not_depend_on_its_batch():
    raw = [b"a b c d e f g", b"h i j k l m n o p " * 30, b"", b"q"]
    alone = [nd.signatures(*shingles([t], 5), 1, 180)[0] for t in raw]
    together = nd.signatures(*shingles(raw, 5), 4, 180)
    assert all(np.array_equal(a, b) for a, b in zip(alone, together))


@pytest.mark.parametrize("block,members", [(nd.BLOCK, nd.MEMBERS), (4, 7)])
def test_classes_equal_brute_force(spark, monkeypatch, block, members):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "MEMBERS", members)
    monkeypatch.setattr(nd, "UNIT", 16)
    rows = near_copies(60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: (r.class_id, r.is_first) for r in nd.classes(df).collect()}
    want = brute_classes(rows)
    assert {k: c for k, (c, _) in got.items()} == want
    assert all(first == (c == k) for k, (c, first) in got.items())


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    edges += [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.label for r in nd.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(got.get(x, x) == find(x) for x in parent)


def test_odd_rows(spark):
    given = odd_documents(spark)
    rows = nd.classes(given).collect()
    assert len(rows) == given.count()
    by = {r.id: r.class_id for r in rows}
    assert by[0] == by[1] == 0  # null is empty
    assert by[9] == by[10] == 9
    assert by[2] == 2 and by[4] == 4
    kept = nd.keep_one(given)
    assert kept.columns == given.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 9 in ids and 10 not in ids and 1 not in ids and None in ids


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "something else entirely is here now"), (2, "a b c d e f g"), (1, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert nd.classes(df).select("class_id").distinct().count() == 2
    assert nd.keep_one(df).count() == 2


def test_string_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("x", "a b c d e f"), ("y", "a b c d e f"), (None, "g h")], "doc_id string, text string")
    assert nd.classes(df).select("class_id").distinct().count() == 2
    assert nd.classes(no_documents(spark)).count() == 0
    assert nd.keep_one(no_documents(spark)).count() == 0


def test_documents_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    assert {r.id: r.class_id for r in nd.classes(df).collect()} == brute_classes(rows)


@pytest.mark.parametrize("key", [None, 7])
def test_repeated_rows_are_one_node(spark, monkeypatch, key):
    """Thousands of rows of one text and of a near copy, all with one id or none: one link, two nodes."""
    base = [f"w{i}" for i in range(200)]
    near = [*base[:-1], "other"]
    rows = [(key, " ".join(words)) for words in (base, near) for _ in range(1500)] + [(9, "far from all of these words here")]
    seen = {}

    def watched(pairs, texts, *rest):
        seen["texts"], out = texts.count(), links(pairs, texts, *rest)
        seen["links"] = out.count()
        return out

    links = nd.links
    monkeypatch.setattr(nd, "links", watched)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    found = nd.classes(df)
    assert found.count() == len(rows)
    assert found.filter("id IS DISTINCT FROM 9").select("class_id").distinct().count() == 1
    assert seen == {"texts": 2, "links": 1}
    assert nd.keep_one(df).count() == 2
