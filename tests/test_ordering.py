import numpy as np
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from quercus.operators import answers, corpus, experiments, ordering
from quercus.operators.ordering import by_group, global_position, quantiles_by, rank_within, running_total, value_frequencies
from quercus.sources import tables


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; one key is null."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40)
    return spark.range(3000).select(key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(100000)).alias("o"), "id").groupBy("k", "o").agg(F.min("id").alias("id"))


@pytest.mark.parametrize("hot_rows", [100, 60, 1])
def test_hot_groups_rank_like_small_ones(skewed, hot_rows):
    plain = rank_within(skewed, ["k"], [F.desc("o")], hot_rows=None)
    hot = rank_within(skewed, ["k"], [F.desc("o")], hot_rows=hot_rows)
    assert same_rows(plain, hot)


def test_hot_running_totals(skewed):
    plain = running_total(skewed, ["k"], ["o"], F.col("id"), hot_rows=None)
    hot = running_total(skewed, ["k"], ["o"], F.col("id"), hot_rows=50)
    assert same_rows(plain, hot)


@pytest.mark.parametrize("most", [0, 3])
def test_many_hot_groups_are_sorted_with_all_rows(skewed, monkeypatch, most):
    plain = running_total(skewed, ["k"], ["o"], F.col("id"), hot_rows=None)
    monkeypatch.setattr(ordering, "HOT_KEYS", most)
    hot = running_total(skewed, ["k"], ["o"], F.col("id"), hot_rows=4)
    assert same_rows(plain, hot)
    assert "LeftAnti" not in hot._jdf.queryExecution().optimizedPlan().toString()  # keys are not sent to all tasks


def test_groups_over_many_slices(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3900, F.lit("a")).alias("k"), F.lit(None).cast("int").alias("j"), "id")
    got = running_total(df, ["k", "j"], ["id"], F.col("id"), hot_rows=10)
    assert same_rows(running_total(df, ["k", "j"], ["id"], F.col("id"), hot_rows=None), got)


def test_rows_of_a_task_are_bounded(spark):
    df = spark.range(10_000).select((F.col("id") % 5000).alias("k"))
    dealt = by_group(df, ["k"], 10_000, 100).groupBy("k", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    sizes = dealt.groupBy("p").agg(F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    assert len(sizes) == 100 and max(r.n for r in sizes) < 200 and all(r.least == 2 for r in sizes)


def test_answer_cells_grow_in_tasks_not_in_rows(spark, monkeypatch):
    """Window, explosion and all sums per answer run in the same tasks."""
    monkeypatch.setattr(tables, "by_group", lambda df, keys, rows: by_group(df, keys, rows, 2000))
    cells = tables.cells(spark, "/root/testdata/sf0.01", None)
    for df in (cells, answers.answer_values(cells), answers.members(answers.answer_values(cells))):
        found = df.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("qid").alias("n")).collect()
        assert len(found) == 30 and max(r.n for r in found) < 1000


def test_hot_orders_are_looked_for_in_a_fixed_number_of_classes(spark, monkeypatch):
    """The counts that a task holds do not grow with the orders; all lines are counted, and a hot order is never missed."""
    asked = []

    def ask(df, keys, rows):
        asked.append(df.groupBy(*keys).count())
        return ordering.hot_groups(df, keys, rows)

    monkeypatch.setattr(tables, "hot_groups", ask)
    assert tables.answer_bound(spark, "/root/testdata/sf0.1") is None
    counts = asked[0].agg(F.count("*").alias("n"), F.sum("count").alias("lines")).first()
    assert counts.n <= 65_536 and counts.lines == tables.table(spark, "/root/testdata/sf0.1", "lineitem").count()
    largest = tables.table(spark, "/root/testdata/sf0.01", "lineitem").groupBy("l_orderkey").count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(tables, "HOT_ROWS", 2 * (largest - 1))
    assert tables.answer_bound(spark, "/root/testdata/sf0.01") == 2 * (largest - 1)


def test_global_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    rows = global_position(df, ["x"]).orderBy("x").collect()
    assert [r.position for r in rows] == list(range(1000))


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_quantiles_are_numpys(spark, hot_rows):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400)) for v in rng.integers(0, 60, n)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = quantiles_by(value_frequencies(df, ["g"], "v"), ["g"], "v", {"q1": 0.25, "q9": 0.9}, hot_rows).collect()
    assert len(got) == 4
    for r in got:
        values = [v for g, v in rows if g == r.g]
        assert [r.q1, r.q9] == pytest.approx(np.quantile(values, [0.25, 0.9]))


def test_box_stats(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 100)] + [("a", None)], "g string, score double")
    r = experiments.box_stats(df, ["g"]).first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.n_outliers, r.n) == (2.25, 3.5, 4.75, 1.0, 5.0, 1, 6)


def test_dedup_keeps_the_first_and_numbers(spark):
    df = spark.createDataFrame([(5, "a", None), (2, "b", 1), (9, "a", None), (1, "b", 1), (7, "c", 0)], "row_id bigint, t string, n int")
    got = corpus.dedup_keep_first(df, renumber="position").orderBy("position").collect()
    assert [(r.row_id, r.t, r.position) for r in got] == [(1, "b", 0), (5, "a", 1), (7, "c", 2)]
    r = corpus.duplicate_ratio(df).first()
    assert (r.n_rows, r.n_duplicates, r.ratio) == (5, 2, 0.4)


def test_outliers(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([0, 0, 0, 10, 11, 12, 13, 60])], "row_id bigint, t string")
    assert [r.row_id for r in corpus.iqr_outliers(df, "t", only_filled=True).collect()] == [7]
    assert corpus.iqr_outliers(df, "t").count() == 1


def test_ranges(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert sorted(r.row_id for r in corpus.rows_range(df, 7, 100).collect()) == [7, 8, 9]
    assert corpus.rows_range(df, 2, 3).count() == 3 and corpus.rows_range(df, 2, -1).count() == 8
    with pytest.raises(ValueError):
        corpus.rows_range(df, -1, 3)
    targets = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "ord int, row_id bigint")
    assert [r.row_id for r in corpus.rows_targeted(df, targets).orderBy("ord").collect()] == [5, 2, 5]


def test_overwrite_takes_nulls(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "row_id bigint, t string, u string")
    new = spark.createDataFrame([(2, None)], "row_id bigint, t string")
    got = corpus.overwrite_from(old, new, ["t"]).orderBy("row_id").collect()
    assert [(r.t, r.u) for r in got] == [("a", "x"), (None, "y")]


def test_describe_strings_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "t string")
    r = corpus.describe_strings(df, ["t"]).first()
    assert (r["column"], r["count"], r.unique, r.top, r.freq) == ("t", 4, 2, "a", 2)


def test_metric_names_and_labels(spark, one):
    assert experiments.metric_name("eval/gnv_dice_coeff") == "gnv dice coeff"
    values = {"optimizer": F.lit("adamw_torch"), "lr": F.lit("1e-05"), "skip": F.lit("x")}
    names = {"optimizer": "opt", "lr": "lr", "skip": "no"}
    assert one(experiments.run_label(values, names)) == "optawtor-lr1e05"
    assert one(experiments.run_label(values, names, letters_only=True)) == "optawtor-lre"


def test_parameter_grid(spark):
    lists = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("b"))
    assert len(set(map(tuple, experiments.parameter_grid(lists, ["a", "b"]).collect()))) == 6


def test_scratch_is_dropped(spark):
    from quercus.session import drop_scratch, settle

    table = settle(spark.range(5), "scratch")
    assert table.count() == 5
    assert drop_scratch(spark) >= 1 and drop_scratch(spark) == 0
    assert spark.range(0).count() == 0
