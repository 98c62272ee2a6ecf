import json

from pyspark.sql import functions as F

from quercus.functions import responses as rs, status as st
from quercus.operators import answers as ops, experiments, labels, overlap, sampling, steps
from quercus.sources import readers


def cell_rows(spark, rows):
    return spark.createDataFrame(rows, "qid bigint, side string, row_no int, col_pos int, col string, kind string, value string")


def test_answers_without_gold_count_as_zero(spark):
    rows = [(1, "gold", 1, 0, "a", "uri", "x")] + [(q, "pred", 1, 0, "b", "uri", "x") for q in (1, 2, 3)]
    cells = cell_rows(spark, rows)
    evaluated = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid bigint")
    for scored in (ops.nested_value_metrics, ops.cross_metrics, ops.id_column_metrics):
        assert {r.qid: r.jaccard for r in scored(cells).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
        assert scored(cells, evaluated=evaluated).agg(F.avg("jaccard")).first()[0] == 0.25
    dice = ops.column_pair_score(cells, F.least, lambda s, g, p: 2.0 * s / (g + p))
    assert {r.qid: r.score for r in dice.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_integers_of_any_length(spark):
    cases = {"0" * 3 + "12": "12", "-007": "-7", "+5": "5", "-0": "0", "9" * 42: "9" * 42, "5.7": "5.7", "1e3": "1e3", "": "", " 8 ": "8"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    cell = F.create_map(
        F.lit("type"), F.lit("literal"), F.lit("datatype"), F.lit("http://www.w3.org/2001/XMLSchema#integer"), F.lit("value"), F.col("v")
    )
    assert {r.v: r.x for r in df.select("v", rs.cell_value(cell).alias("x")).collect()} == cases


def test_a_tail_makes_a_response_unreadable(one):
    row = "[{'a': {'type': 'uri', 'value': 'x'}}]"
    assert len(one(rs.parse_execution(F.col("e")), e=row)) == 1
    assert len(one(rs.parse_execution(F.col("e")), e=f" {row} \n".strip())) == 1
    assert one(rs.parse_execution(F.col("e")), e="[]") == []
    for tail in (" trailing", "; " + row, row, "}", ", 1"):
        assert one(rs.parse_execution(F.col("e")), e=row + tail) is None


def test_a_timeout_anywhere_in_a_long_trace(one):
    text = "exception: x\n" + "a" * 50_000 + "java.util.concurrent.TimeoutException" + "b" * 50_000
    assert one(st.error_type(F.col("e")), e=text) == "server timeout"


def test_ragged_columnar_json(spark, tmp_path):
    lines = [{"a": {"0": "x", "1": "y"}, "b": {"1": "z"}}, {"a": {"5": "w"}}, {"b": {"7": None, "8": "q"}, "a": {"8": "r", "7": "s"}}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, lines)))
    want = {("0", "x", None), ("1", "y", "z"), ("5", "w", None), ("7", "s", None), ("8", "r", "q")}
    for df in (readers.load_columnar_json(spark, str(tmp_path)), readers.load_dataset(spark, str(tmp_path / "t.json"))):
        assert {(r["index"], r.a, r.b) for r in df.collect()} == want


def test_positions_not_keys_align(spark):
    predictions = spark.createDataFrame([(0, "p0"), (2, "p2"), (3, "p3"), (9, "p9")], "row_id bigint, answer string")
    targets = spark.createDataFrame([(2, "t2"), (0, "t0"), (1, "t1")], "row_id bigint, target string")
    got = sorted(map(tuple, overlap.align_by_position(predictions, targets).select("row_id", "answer", "target").collect()))
    assert got == [(0, "p0", "t0"), (2, "p2", "t1"), (3, "p3", "t2")]


def test_rouge_l_of_null_texts_and_text_keys(spark):
    df = spark.createDataFrame([("a", None, "x y"), ("b", "x y", "x y"), ("c", None, None)], "row_id string, prediction string, reference string")
    assert {r.row_id: r.rougeL for r in overlap.rouge_l(df).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_one_odd_row_does_not_end_the_job(spark):
    lists = spark.createDataFrame([(1, []), (2, ["x"]), (3, None)], "row_id bigint, items array<string>")
    picked = {r.row_id: r.p for r in lists.select("row_id", sampling.pick_one(F.col("items"), 1, F.col("row_id")).alias("p")).collect()}
    assert picked == {1: None, 2: "x", 3: None}
    states = spark.createDataFrame([("crashed",), ("Finished",), ("FAILED",), (None,)], "state string")
    assert [r.is_success for r in experiments.recode_and_fill(states).collect()] == [None, True, False, None]
    dictionary = spark.createDataFrame([("entity", "X", "a"), ("entity", "Q" + "9" * 30, "a"), ("entity", "Q3", "a")], "kind string, id string, label string")
    assert labels.first_hits(dictionary).first().hit.id == "Q3"
    runs = spark.createDataFrame([("M_rv99999999999-gc1-ctx1024-q4bit",)], "run_name string")
    assert experiments.parse_run_name_regex(runs).count() == 1 and experiments.parse_run_name_regex(runs).collect()


def test_a_callers_row_function(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 6)], "row_id bigint, text string, other int")
    out = steps.apply_rows(df, lambda row: {"n": len((row["text"] or "").split()), "sum": float(row["other"])}, "n int, sum double", ["text", "other"])
    assert sorted(map(tuple, out.collect())) == [(1, 2, 5.0), (2, 0, 6.0)]
    assert steps.apply_rows(df.limit(0), lambda row: {"n": 1}, "n int", ["text"]).count() == 0
