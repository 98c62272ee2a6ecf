import pytest
from pyspark.sql import functions as F

from quercus.operators import labels as lb, steps as sp

LABELS = [
    ("Q1", "entity", "fr", "rouge"), ("Q1", "entity", "en", " red "), ("Q2", "entity", "fr", "bleu"), ("Q2", "entity", "de", "blau"),
    ("P3", "property", "en", "part of"), ("P31", "property", "en", "instance of"), ("Q40", "entity", "en", "Red"),
    ("L5", "lexeme", "en", "go"),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(LABELS, "id string, kind string, lang string, label string")


def test_label_lookup(spark, dictionary):
    ids = spark.createDataFrame([("Q1",), ("Q2",), ("Q9",), ("Q8",), ("Q1",)], "id string")
    redirects = spark.createDataFrame([("Q8", "P3")], "id string, target string")
    got = {r.id: r.label for r in lb.label_lookup(ids, dictionary, redirects).collect()}
    assert got == {"Q1": "red", "Q2": "blau", "Q9": "Q9", "Q8": "part of"}


def test_whole_ids_are_labelled(spark, dictionary):
    df = spark.createDataFrame([(1, "?a wdt:P31/wdt:P3 wd:Q1, wd:Q12 :L5 Q1"), (2, "plain")], "row_id bigint, query string")
    got = {r.row_id: r.query_templated for r in lb.label_query(df, dictionary).collect()}
    assert got == {
        1: "?a wdt:[property:instance of]/wdt:[property:part of] wd:[entity:red], wd:[entity:Q12] :[lexeme:go] Q1",
        2: "plain",
    }


def test_first_hit_then_other_kind_then_itself(spark, dictionary):
    wanted = spark.createDataFrame([("RED", "entity"), ("red", "property"), ("part of", "entity"), ("none", "entity")], "label string, kind string")
    got = {(r.label, r.kind): (r.id, r.matched) for r in lb.link_take_first(wanted, dictionary).collect()}
    assert got == {
        ("RED", "entity"): ("Q1", " red "), ("red", "property"): ("Q1", " red "),
        ("part of", "entity"): ("P3", "part of"), ("none", "entity"): ("none", "none"),
    }


def test_template_steps(spark, dictionary):
    answers = [(1, "[query]SELECT wd:[entity:red] wdt:[property:part of] [entity:odd][/query]"), (2, "no tags"), (3, "[query]SELECT 1[/query]")]
    df = spark.createDataFrame(answers, "row_id bigint, answer string")
    got = {r.row_id: r for r in sp.run_steps(df, sp.template_steps("answer", dictionary)).collect()}
    assert got[1].output == "SELECT wd:Q1 wdt:P3 odd" and got[3].output == "SELECT 1"
    assert (got[1].status, got[1].has_error, got[1].last_executed_step, got[1].to_be_executed_step) == ("", False, "fill", "")
    assert (got[2].has_error, got[2].last_executed_step, got[2].to_be_executed_step, got[2].translated_prompt, got[2].output) == (
        True, "", "translate", "", None,
    )
    assert [x.label for x in got[1].linked_entities] == ["red", "odd"]
    assert got[2].status.startswith("Unexpected err.msg=")


def test_label_then_fill_gives_the_query_back(spark, dictionary):
    df = spark.createDataFrame([(1, "SELECT ?a { ?a wdt:P31 wd:Q2 . ?a wdt:P3 wd:Q1 }")], "row_id bigint, query string")
    labelled = lb.label_query(df, dictionary.filter("id <> 'Q40'"))
    linked = lb.link_placeholders(lb.with_placeholders(labelled, "query_templated"), dictionary.filter("id <> 'Q40'"))
    from quercus.functions.text import fill_placeholders

    out = linked.select(fill_placeholders(F.col("query_templated"), F.col("linked_entities"), F.col("linked_properties")).alias("x"))
    assert out.first().x == df.first().query


def test_bookkeeping(spark):
    def step(name, fails):
        return sp.Step(name, lambda d: d.withColumn(name, F.lit(name)).withColumn("error", F.when(F.lit(fails), F.lit("bad"))), [name])

    df = spark.range(1)
    done = sp.run_steps(df, [step("a", False), step("b", False)]).first()
    assert (done.a, done.b, done.status, done.has_error, done.last_executed_step, done.to_be_executed_step) == ("a", "b", "", False, "b", "")
    stopped = sp.run_steps(df, [step("a", False), step("b", True), step("c", False)]).first()
    assert (stopped.a, stopped.b, stopped.c) == ("a", None, None)
    assert (stopped.status, stopped.has_error, stopped.last_executed_step, stopped.to_be_executed_step) == ("bad", True, "a", "b")
    empty = sp.run_steps(df, []).first()
    assert (empty.status, empty.has_error, empty.to_be_executed_step) == ("", False, "")
    with pytest.raises(TypeError):
        sp.run_steps(df, ["a"])


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_lookup_by_shuffle_and_by_broadcast(spark, dictionary, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Q1").otherwise("Q7").alias("x"))
        got = lb.lookup(rows, F.col("x"), lb.best_labels(dictionary), "id")
        assert got.count() == 100 and got.filter("label = 'red'").count() == 34 and got.columns == ["row_id", "x", "label"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_step_that_raises_stops_its_row_only(spark):
    def half(row):
        if row["n"] == 3:
            raise ValueError("three")
        return {"half": 10 // row["n"], "told": f"n={row['n']}"} if row["n"] != 5 else {"half": "five"}

    def twice(row):
        if row["half"] is None:
            raise AssertionError("a failed row came through")
        return {"twice": 2 * row["half"]}

    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 3, 0, 5])], "row_id bigint, n bigint")
    steps = [
        sp.row_step("half", half, "half bigint, told string", ["n"], {"told": F.lit("none")}),
        sp.row_step("twice", twice, "twice bigint", ["half"]),
    ]
    got = {r.n: r for r in sp.run_steps(df, steps).collect()}
    assert (got[1].twice, got[2].twice, got[2].told) == (20, 10, "n=2")
    assert got[1].status == "" and not got[1].has_error and got[1].last_executed_step == "twice"
    assert got[3].status == "Unexpected err=ValueError('three'), type(err)=<class 'ValueError'>"
    assert got[0].status.startswith("Unexpected err=ZeroDivisionError(") and got[5].status.startswith("Unexpected err=")
    for n in (0, 3, 5):
        r = got[n]
        assert r.has_error and r.half is None and r.twice is None and r.told == "none"
        assert (r.last_executed_step, r.to_be_executed_step) == ("", "half")
