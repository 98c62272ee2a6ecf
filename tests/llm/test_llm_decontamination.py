import random
import re

import pytest
from llm_cases import no_documents, odd_documents

from quercus.llm import decontamination as dc


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(texts, items, window=dc.WINDOW):
    out = {}
    for doc, text in texts:
        words, hit, owners = brute_words(text), set(), set()
        for item, item_text in items:
            parts = brute_words(item_text)
            for i in range(max(len(parts) - window, 0) + 1 if parts else 0):
                part = parts[i : i + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        owners.add(str(item))
        out[doc] = (len(words), len(hit), sorted(owners))
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in df.collect()}


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["a", "É", "日本", "x1"]

    def say(n):
        return rng.choices(vocabulary, k=n)

    items = [(i, " ".join(say(rng.choice([1, 2, 4, 9, 10, 11, 25])))) for i in range(12)] + [(99, None), (98, "..."), (3, "W1 W2")]
    docs = []
    for d in range(40):
        words = say(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            item = brute_words(rng.choice(items)[1])
            at = rng.randrange(len(item) + 1)
            place = rng.randrange(len(words) + 1)
            words[place:place] = item[at : at + rng.randrange(8, 14)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words)))
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_brute_force(seed, monkeypatch):
    monkeypatch.setattr(dc, "LANE", 16)
    docs, items = planted(seed)
    got = dc.Windows([(str(i), t) for i, t in items], dc.WINDOW).search([t for _, t in docs])
    want = brute(docs, items)
    for (doc, _), n, spans, owners in zip(docs, got["n_words"], got["spans"], got["items"]):
        assert (n, sum(s["b"] - s["a"] for s in spans), sorted(owners)) == want[doc]


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 200])
def test_blocks_of_items_give_the_same(spark, block_bytes):
    docs, items = planted(9)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(dc.search(df, benchmark(spark, items), block_bytes=block_bytes)) == brute(docs, items)


def test_odd_rows(spark):
    given = odd_documents(spark)
    items = benchmark(spark, [(1, "two three four five six seven eight nine ten eleven"), (None, "two words"), (2, "")])
    rows = dc.search(given, items).collect()
    assert len(rows) == given.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_words == by[1].n_words == by[2].n_words == 0 and not by[0].contaminated
    assert by[9].n_hit == 10 and by[9]["items"] == ["1"] and by[5]["items"] == [""]
    kept = dc.keep_clean(given, items)
    assert kept.columns == given.columns and kept.count() == given.count() - 4


def test_empty_tables(spark):
    nothing = benchmark(spark, [])
    assert dc.search(no_documents(spark), nothing).count() == 0
    assert dc.search(odd_documents(spark), nothing).filter("contaminated").count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = found(dc.search(docs, items))
    assert got == want and any(n for _, n, _ in got.values())
