import hashlib
import math
import re

import pytest
from llm_cases import CLASH, LONG, no_documents, odd_documents
from pyspark.sql import functions as F

from quercus.llm import source_mixing as mix


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshare the excess by weight, round by round, until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_to, left = {}, set(names), share * sum(sizes.values())
    while open_to:
        unit = left / sum(weight[s] for s in open_to)
        above = {s for s in open_to if unit * weight[s] >= most * sizes[s]}
        if not above:
            return target | {s: unit * weight[s] for s in open_to}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_to -= above
    return target


def brute_code(doc_id, text, quality):
    h = int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{text}".encode()).hexdigest()[:13], 16)
    return math.floor((math.log(-math.log((h + 0.5) / 2**52)) - math.log(quality) + 40) / 64 * 2**48)


def plainness(text):
    solid = re.sub(r"[\x20\x09-\x0D]", "", text)
    marks = len(re.findall(r"[!-@\[-`{-~]", solid))
    return max(0.05, 1 - marks / len(solid)) if solid else 1.0


def brute(rows, **choices):
    """{(id, text, source): sorted taken words}, by sorting each source whole."""
    texts = [(d, t or "", s) for d, t, s in rows]
    size = {t: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t, _ in texts}
    sizes = {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + size[t]
    targets, out = brute_targets(sizes, **choices), {}
    for source, total in sizes.items():
        epochs = math.floor(targets[source] / total) if total else 0
        left = math.floor(targets[source] + 0.5) - epochs * total
        own = sorted((r for r in texts if r[2] == source), key=lambda r: brute_code(r[0], r[1], plainness(r[1])))
        for row in own:
            part = min(left, size[row[1]])
            left -= part
            out.setdefault(row, []).append(epochs * size[row[1]] + part)
    return {k: sorted(v) for k, v in out.items()}, targets, sizes


def check(df, **choices):
    rows = mix.plan(df, carry=df.columns, **choices).collect()
    given = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    want, targets, sizes = brute(given, **choices)
    got = {}
    for r in rows:
        got.setdefault((r._kept.doc_id, r._kept.text or "", r.source), []).append(r.taken)
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
    assert {k: sorted(v) for k, v in got.items()} == want
    taken = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    return rows


def test_equals_brute_force_on_odd_rows(spark):
    rows = check(odd_documents(spark))
    assert len(rows) == odd_documents(spark).count() and len(LONG) > 300_000
    assert all(r._kept[c] == "extra" for r in rows for c in CLASH)


def test_equals_brute_force_on_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_other_choices(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mix.plan(df, weights=(5, 1), share=0.4).collect()
    sizes = {r.source: r.source_size for r in mix.plan(df, carry=["source"]).select("source", "source_size").distinct().collect()}
    want = brute_targets(sizes, weights=(5, 1), share=0.4)
    assert all(r.target == pytest.approx(want[r.source]) for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(0.4 * sum(sizes.values()), abs=len(sizes))


def test_sources_beyond_their_limit():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 0, "d": 500}
    targets = brute_targets(sizes)
    assert targets["a"] == 20 and targets[None] == 0 and sum(targets.values()) == pytest.approx(1.5 * 2510)


def test_targets_are_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 0, "d": 500, "é": 3, "Z": 70}
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in mix.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_repeated_rows_share_what_is_left(spark):
    copies = spark.range(0, 3000, numPartitions=7).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("hot").alias("source"))
    others = spark.range(0, 500).select("id", F.lit("some other words").alias("text"), F.lit("cold").alias("source"))
    df = copies.union(others.withColumnRenamed("id", "doc_id"))
    rows = check(df)
    hot = [r.taken for r in rows if r.source == "hot"]
    assert len(hot) == 3000 and sum(t % 4 != 0 for t in hot) <= 1


def test_low_quality_is_drawn_less_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), "id").alias("text"), F.lit("s").alias("source"))
    weight = F.when(F.col("doc_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.1))
    rows = mix.plan(df, quality=weight, share=0.5).collect()
    good = sum(r.taken > 0 for r in rows if r._kept.doc_id % 2 == 0)
    poor = sum(r.taken > 0 for r in rows if r._kept.doc_id % 2 == 1)
    assert good + poor in range(1999, 2003) and good > 4 * poor


def test_reruns_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = {r._kept.doc_id: r.taken for r in mix.plan(df).collect()}
    b = {r._kept.doc_id: r.taken for r in mix.plan(df.repartition(13)).collect()}
    assert a == b


def test_mixture_tells_the_words_taken(spark):
    df = odd_documents(spark).filter("doc_id <> 8")
    taken = {}
    for r in mix.plan(df, carry=df.columns).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    told = mix.mixture(df).collect()
    for r in told:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.words
        assert r.text == r._row.text or r.text.split() == r._row.text.split()[: r.words]
    by_source = {}
    for r in told:
        by_source[r._row.source] = by_source.get(r._row.source, 0) + r.words
    assert by_source == {s: n for s, n in taken.items() if n}


def test_empty_table(spark):
    assert mix.plan(no_documents(spark)).count() == 0 and mix.mixture(no_documents(spark)).count() == 0


def test_no_python_worker(spark):
    plan = mix.plan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "Python" not in plan._jdf.queryExecution().toString()
