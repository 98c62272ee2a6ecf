import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import no_documents, odd_documents
from pyspark.sql import functions as F

from quercus.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def base(df):
    return {r.doc_id: tuple(r[c] for c in qr.BASE) for r in df.collect()}


def test_base_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert base(qr.base_counts(docs)) == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_windows_and_lines(spark):
    given = ["a b c a b c", "a a a a", "a b", "a b c", "x\nx\n \n \nx", "a\x0bb\x0c#\r\n#", "日本 # 語 z", "a b c d a b c d a b"]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").selectExpr("*", "'e' AS lang", "'s' AS source")
    assert base(qr.base_counts(df)) == {i: brute(t) for i, t in enumerate(given)}


def test_odd_rows(spark):
    given = odd_documents(spark)
    rows = qr.judge(given).collect()
    assert len(rows) == given.count()
    want = {r.doc_id: brute(r.text) for r in given.select("doc_id", "text").collect()}
    for r in rows:
        assert tuple(r[c] for c in qr.BASE) == want[r.doc_id]
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_empty_table(spark):
    assert qr.judge(no_documents(spark)).count() == 0


def test_distances_equal_mahalanobis(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3
    names = ", ".join(f"{s} double" for s in qr.STATISTICS)
    rows = spark.createDataFrame([("p", *map(float, r)) for r in x], f"_pool string, {names}")
    start = qr.first_estimate(rows)
    once = qr.concentrated(rows, start).first()
    m = np.array([once[f"m_{i}"] for i in range(5)])
    low = np.array([[once[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    got = sorted(r._d for r in qr.distance(rows, qr.concentrated(rows, start)).collect())
    y = np.linalg.solve(low, (x - m).T)
    assert np.allclose(got, sorted((y**2).sum(axis=0)))
    # the factor is that of the covariance of the nearest part, with the floors on its diagonal
    first = start.first()
    d0 = sum(((x[:, i] - first[f"m_{i}"]) / first[f"l_{i}_{i}"]) ** 2 for i in range(5))
    bins = np.floor(np.log(d0 + 1e-9) * qr.LOG_BIN)
    near = x[bins <= np.sort(bins)[int(np.ceil(qr.SUPPORT * len(x))) - 1]]
    cov = np.cov(near.T, bias=True) * qr.CONSISTENCY + np.diag([f**2 for f in qr.FLOORS.values()])
    assert np.allclose(m, near.mean(axis=0)) and np.allclose(low @ low.T, cov, rtol=1e-6, atol=1e-9)


def test_outliers_go_and_others_stay(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(200) + F.col("id") % 100), lambda i: F.concat(F.lit("w"), F.hash("id", i).cast("string")))
    plain = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    odd = plain.filter("doc_id < 8").select((F.col("doc_id") + 1000).alias("doc_id"), F.regexp_replace("text", " ", "%%% ").alias("text"))
    df = plain.unionByName(odd).selectExpr("*", "'en' AS lang", "'s' AS source")
    kept = {r.doc_id for r in qr.judge(df).filter("kept").collect()}
    assert kept == set(range(400))


@pytest.mark.parametrize("least", [1, 60, 10_000])
def test_small_groups_are_pooled(spark, least):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = qr.judge(docs, min_rows=least).collect()
    assert len(rows) == docs.count() and sum(r.kept for r in rows) > 0.5 * sum(not r.base_failed for r in rows)


def test_repeats_below_the_base_limit_go_alone(spark):
    def words(i, n):
        return [f"w{i}x{j}" for j in range(n)]

    def lines(i, unique, same):
        own = [" ".join(words(f"{i}l{j}", 20)) for j in range(unique)]
        return "\n".join(x for j in range(unique) for x in [own[j], *(["read more"] if j < same else [])])

    def repeats(i, times):
        return "\n".join(" ".join([*words(f"{i}r{j}", 10), *(["all", "rights", "reserved", "here"] if j < times else [])]) for j in range(20))

    rows = [(i, lines(i, 20 + i % 5, 0)) for i in range(300)]
    rows += [(1000 + k, lines(1000 + k, 20, 12 + 2 * k)) for k in range(5)]  # 34 to 47 % of the lines are repeats
    rows += [(2000, lines(2000, 20, 3)), (2001, repeats(2001, 2))]  # a few repeats
    rows += [(4000 + k, " ".join(words(4000 + k, 150)) + "\n" + " all rights reserved" * (23 + 4 * k)) for k in range(5)]  # 32 to 44 % of the words
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    got = {r.doc_id: r for r in qr.judge(df).collect()}
    assert all(got[i].kept for i in [*range(300), 2000, 2001])
    for i in [*range(1000, 1005), *range(4000, 4005)]:
        assert not got[i].base_failed and not got[i].kept, i
    assert all(got[i].n_dup_lines == 0 for i in range(4000, 4005))
