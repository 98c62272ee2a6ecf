import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from quercus.operators import sampling as sm


@pytest.mark.parametrize("n", [0, 1, 2, 7, 20, 997])
def test_split_sizes_are_exact(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    got = {r.split: r["count"] for r in sm.split_75_5_20(df, seed=3).groupBy("split").count().collect()}
    a, b = int(0.75 * n), int(0.80 * n)
    assert got == {k: v for k, v in {"train": a, "valid": b - a, "test": n - b}.items() if v}


def test_split_is_the_same_on_any_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    a, b = sm.split_75_5_20(df.repartition(3)), sm.split_75_5_20(df.repartition(11))
    assert same_rows(a, b)
    assert not same_rows(sm.split_75_5_20(df, seed=1), b)


def rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.array(F.concat(F.lit("q"), "id"), F.concat(F.lit("p"), "id")).alias("inputs"),
        F.concat(F.lit("t"), "id").alias("target"),
    )


@pytest.mark.parametrize("n, shots, batch", [(300, 3, 50), (40, 5, 1000), (3, 5, 1000), (1, 2, 10)])
def test_few_shot(spark, n, shots, batch):
    got = sm.few_shot_examples(rows(spark, n), shots, seed=1, batch=batch).collect()
    assert len(got) == n
    for r in got:
        ids = [e.id for e in r.examples]
        assert len(ids) == len(set(ids)) and r.row_id not in ids
        assert len(ids) == min(shots, n - 1) or (batch < n and len(ids) <= shots)
        assert all(e.target == f"t{e.id}" and e.question in (f"q{e.id}", f"p{e.id}") for e in r.examples)


def test_pick_one(spark):
    df = rows(spark, 200).select("row_id", sm.pick_one(F.col("inputs"), 1, F.col("row_id")).alias("x"))
    firsts = df.filter(F.startswith("x", F.lit("q"))).count()
    assert 60 < firsts < 140


@pytest.mark.parametrize("limit, result, skipped", [(0, None, True), (1, None, True), (2, "ok1", False), (5, "ok1", False), (-1, "ok1", False)])
def test_attempts(spark, limit, result, skipped):
    df = spark.createDataFrame([(1, 0, "bad"), (1, 2, "ok2"), (1, 1, "ok1")], "g int, attempt int, answer string")
    r = sm.first_acceptable_attempt(df, "g", F.startswith("answer", F.lit("ok")), limit).first()
    assert (r.result, r.is_skipped) == (result, skipped)


def test_too_long(spark):
    df = spark.createDataFrame([(150,), (4096,), (4097,)], "n int")
    got = [(r.is_skipped, r.is_prompt_too_long) for r in sm.mark_too_long(df, F.col("n"), 4096).orderBy("n").collect()]
    assert got == [(False, False), (False, False), (True, True)]


def test_prompt_modes(spark):
    from quercus.operators import prompts as pr

    df = spark.createDataFrame([("q", "c", "d")], "query string, context string, description string")
    made = pr.prepare_prompts(df, F.lit("two words"), "auto", prefix="x_").first()
    assert (made.x_prompt, made.x_num_tokens, made.x_result, made.x_is_skipped) == ("two words", 2, None, None)
    kept = pr.prepare_prompts(df.withColumn("x_prompt", F.lit("old")), F.lit("new"), "auto", prefix="x_").first()
    assert (kept.x_prompt, kept.x_num_tokens) == ("old", 1)
    assert pr.prepare_prompts(df.withColumn("x_prompt", F.lit("old")), F.lit("new"), "YES", prefix="x_").first().x_prompt == "new"
    with pytest.raises(ValueError):
        pr.prepare_prompts(df, F.lit("new"), "no")
    with pytest.raises(ValueError):
        pr.prepare_prompts(df.drop("context"), F.lit("new"))


@pytest.mark.parametrize("tokens, fine, expected", [(3, True, (["A"], False, False)), (3, False, (None, True, False)), (9, True, (None, True, True))])
def test_generation_result(spark, tokens, fine, expected):
    from quercus.operators import prompts as pr

    df = spark.createDataFrame([(tokens,)], "basic_num_tokens bigint")
    r = pr.generation_result(df, F.array(F.lit("A")), F.lit("full"), F.lit(fine), 8).first()
    assert (r.basic_result, r.basic_is_skipped, r.basic_is_prompt_too_long) == expected
