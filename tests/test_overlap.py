import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quercus.operators import overlap as ov

SCHEMA = "row_id bigint, prediction string, reference string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["the", "cat", "sat", "on", "a", "mat", "dog", "ran"]

    def text():
        return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 4)))

    return [(i, text(), text()) for i in range(60)] + [(90, "", "a b"), (91, "a b", ""), (92, "same words here now", "same words here now")]


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(5)


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def walk(a, b):
    t, i, j, out = table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_lcs_against_the_full_table():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        assert ov.lcs_length(a, b) == table(a, b)[-1][-1]
        assert ov.lcs_places(a, b) == walk(a, b)


def f1(hits, n, m):
    return 2 * hits / (n + m) if n + m else 0.0


def naive_lsum(pred, ref):
    p, r = [line.split() for line in pred.split("\n") if line.split()], [line.split() for line in ref.split("\n") if line.split()]
    left_p, left_r, hits = Counter(t for x in p for t in x), Counter(t for x in r for t in x), 0
    n, m = sum(left_p.values()), sum(left_r.values())
    for line in r:
        union = set().union(*[walk(line, q) for q in p]) if p else set()
        for i in sorted(union):
            if left_p[line[i]] > 0 and left_r[line[i]] > 0:
                hits += 1
                left_p[line[i]] -= 1
                left_r[line[i]] -= 1
    return f1(hits, n, m)


def test_rouge_l(df, texts):
    got = {r.row_id: r for r in ov.rouge_l(df).collect()}
    for i, p, r in texts:
        a, b = p.split(), r.split()
        assert got[i].rougeL == pytest.approx(f1(table(b, a)[-1][-1], len(a), len(b)))
        assert got[i].rougeLsum == pytest.approx(naive_lsum(p, r))


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def test_rouge_n(df, texts):
    got = {r.row_id: r for r in ov.rouge_n(df).collect()}
    assert len(got) == len(texts)
    for i, p, r in texts:
        for n in (1, 2):
            a, b = grams(p.split(), n), grams(r.split(), n)
            assert got[i][f"rouge{n}"] == pytest.approx(f1(sum((a & b).values()), sum(a.values()), sum(b.values())))


def test_rouge_tokens(spark):
    df = spark.createDataFrame([(1, "Don't stop-NOW été", "don t stop now t")], SCHEMA)
    assert ov.rouge_n(df).first().rouge1 == 1.0


def test_bleu(df, texts):
    match, total, pred_len, ref_len = Counter(), Counter(), 0, 0
    for _, p, r in texts:
        a, b = p.split(), r.split()
        pred_len, ref_len = pred_len + len(a), ref_len + len(b)
        for n in range(1, 5):
            match[n] += sum((grams(a, n) & grams(b, n)).values())
            total[n] += max(len(a) - n + 1, 0)
    brevity = 1 if pred_len >= ref_len else math.exp(1 - ref_len / pred_len)
    expected = brevity * math.exp(sum(math.log(match[n] / total[n]) for n in range(1, 5)) / 4)
    assert ov.corpus_bleu(df).first().bleu == pytest.approx(expected)


def naive_meteor(p, r):
    a, b = list(enumerate(p.lower().split())), list(enumerate(r.lower().split()))
    n, m, pairs = len(a), len(b), []
    for i in range(len(a))[::-1]:
        for j in range(len(b))[::-1]:
            if a[i][1] == b[j][1]:
                pairs.append((a[i][0], b[j][0]))
                a.pop(i)
                b.pop(j)
                break
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(x2 != x1 + 1 or y2 != y1 + 1 for (x1, y1), (x2, y2) in zip(pairs, pairs[1:]))
    precision, recall = len(pairs) / n, len(pairs) / m
    mean = precision * recall / (0.9 * precision + 0.1 * recall)
    return (1 - 0.5 * (chunks / len(pairs)) ** 3) * mean


def test_meteor(df, texts):
    got = {r.row_id: r.meteor for r in ov.meteor_exact(df).collect()}
    for i, p, r in texts:
        assert got[i] == pytest.approx(naive_meteor(p, r))


def test_report(df):
    r = ov.text_report(df).first()
    assert set(r.asDict()) == {"rouge1", "rouge2", "rougeL", "rougeLsum", "meteor", "bleu"}
    assert all(0 < v < 1 for v in r)


def test_walk_back_holds_few_rows():
    import tracemalloc

    rng = random.Random(9)
    a, b = ([rng.choice("abcdefgh") for _ in range(3000)] for _ in range(2))
    tracemalloc.start()
    places = ov.lcs_places(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(places) == ov.lcs_length(a, b)
    assert peak < 400_000  # all 3,000 rows of 3,000 bits would be 1.2 MB


def test_tasks_of_bounded_texts(spark):
    """Long texts go to more tasks than spark.sql.shuffle.partitions, few to as many; empty tables and nulls count nothing."""
    text = F.repeat(F.lit("ab "), 300_000)
    long = spark.range(20).select(F.col("id").alias("row_id"), text.alias("prediction"), text.alias("reference"))
    few = spark.createDataFrame([(1, None, "a b"), (2, "a", None)], SCHEMA)
    assert ov.text_tasks(few.limit(0)) == 0
    for df, tasks in ((long, 18), (few, 8)):
        for scored in (ov.rouge_n(df), ov.corpus_bleu(df), ov.meteor_exact(df)):
            plan = scored._jdf.queryExecution().executedPlan().toString()
            assert [int(n) for n in re.findall(r"hashpartitioning\(row_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)] == [tasks]


def test_bounded_texts_give_the_same_metrics(df, monkeypatch):
    want = [ov.text_report(df).first().asDict(), ov.meteor_exact(df).count()]
    monkeypatch.setattr(ov, "TASK_CHARS", 100)
    assert ov.text_tasks(df) > 20
    assert ov.text_report(df).first().asDict() == pytest.approx(want[0]) and ov.meteor_exact(df).count() == want[1]
