"""Answer metrics against a plain reading of their definitions."""

import random
import re
from collections import defaultdict

import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from quercus.fixed_values import ANSWER_METRICS
from quercus.operators import answers as ops
from quercus.plans import QUERIES

CELLS = "qid bigint, side string, row_no int, col_pos int, col string, kind string, value string"
IRI = "http://www.wikidata.org/entity/Q"


def make_cells(tables):
    rows = []
    for qid, sides in tables.items():
        for side, columns in sides.items():
            for pos, (col, values) in enumerate(columns.items()):
                rows += [(qid, side, i, pos, col, "literal", v) for i, v in enumerate(values)]
    return rows


def naive(gold, pred, k=5):
    relevant = {v for v in gold if v is not None}
    run = sorted({v for v in pred if v is not None}, reverse=True)
    hits = [i + 1 for i, v in enumerate(run) if v in relevant]
    common, n, m = len(hits), len(relevant), len(run)
    first = [1 / r for r in hits if r <= k]
    return {
        "map": sum((i + 1) / r for i, r in enumerate(hits)) / n if n else 0.0,
        "precision": len(first) / k, "recall": 1.0 if first else 0.0, "rr": max(first, default=0.0),
        "overlap": common / min(n, m) if min(n, m) else 0.0,
        "jaccard": common / (n + m - common) if n + m else 0.0,
        "dice_coeff": 2 * common / (n + m) if n + m else 0.0,
    }


def best(gold, pred):
    out = dict.fromkeys(ANSWER_METRICS, 0.0)
    for g in gold.values():
        for p in pred.values():
            scores = naive([v for v in g if v != ""], [v for v in p if v != ""])
            out = {m: max(out[m], scores[m]) for m in out}
    return out


def naive_keys(columns):
    if len(columns) <= 1:
        return list(columns)
    entities = [c for c, v in columns.items() if all(isinstance(x, str) and x.lower().startswith("http://www.wikidata.org/") for x in v)]
    if entities:
        return entities
    ratio = {c: len(set(v)) / len(v) for c, v in columns.items()}
    tied = [c for c in columns if ratio[c] == max(ratio.values())]
    named = [c for c in tied if c.lower().startswith("id") or c.lower().endswith("id")]
    return named if len(tied) > 1 and named else tied


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    out = {}
    for qid in range(60):
        sides = {}
        for side in ("gold", "pred"):
            if side == "pred" and qid % 9 == 0:
                continue
            n = rng.randint(1, 12)
            columns = {}
            for name in rng.sample(["a", "id b", "c", "Did"], rng.randint(1, 3)):
                style = rng.choice(["iri", "text", "blank"])
                pool = [f"{IRI}{i}" for i in range(9)] if style == "iri" else [f"v{i}" for i in range(9)]
                pool += ["", None] if style == "blank" else []
                columns[name] = [rng.choice(pool) for _ in range(n)]
            sides[side] = columns
        out[qid] = sides
    return out


@pytest.fixture(scope="module")
def cells(spark, tables):
    return spark.createDataFrame(make_cells(tables), CELLS).cache()


def check(df, expected):
    got = {r.qid: r for r in df.collect()}
    assert set(got) == set(expected)
    for qid, want in expected.items():
        for m in ANSWER_METRICS:
            assert got[qid][m] == pytest.approx(want[m]), (qid, m)


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_cross_metrics(cells, tables, hot_rows):
    check(ops.cross_metrics(cells, hot_rows=hot_rows), {q: best(t["gold"], t.get("pred", {})) for q, t in tables.items()})


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_nested_value_metrics(cells, tables, hot_rows):
    def flat(columns):
        return [v for c in columns.values() for v in c]

    check(
        ops.nested_value_metrics(cells, hot_rows=hot_rows),
        {q: naive(flat(t["gold"]), flat(t.get("pred", {}))) for q, t in tables.items()},
    )


def test_id_column_metrics(cells, tables):
    def keys(columns):
        return {c: columns[c] for c in naive_keys(columns)}

    check(ops.id_column_metrics(cells), {q: best(keys(t["gold"]), keys(t.get("pred", {}))) for q, t in tables.items()})


def test_key_columns(cells, tables):
    got = defaultdict(set)
    for r in ops.key_columns(cells).collect():
        got[r.qid, r.side].add(r.col)
    assert got == {(q, s): set(naive_keys(c)) for q, t in tables.items() for s, c in t.items()}


@pytest.mark.parametrize(
    "columns, keys",
    [
        ({"alone": ["a", "a"]}, ["alone"]),
        ({"u": ["a", "b"], "v": ["1", "1"]}, ["u"]),
        ({"u": ["a", "b"], "v": ["1", "2"]}, ["u", "v"]),
        ({"u id": ["a", "b"], "v": ["1", "2"]}, ["u id"]),
        ({"id u": ["a", "b"], "v": ["1", "2"]}, ["id u"]),
        ({"u": ["a", "b"], "e": [IRI + "1", IRI + "1"]}, ["e"]),
        ({"u": ["a", "b"], "e": [IRI + "1", None]}, ["u", "e"]),
    ],
)
def test_key_choice(spark, columns, keys):
    df = spark.createDataFrame(make_cells({1: {"gold": columns}}), CELLS)
    assert {r.col for r in ops.key_columns(df).collect()} == set(keys)


@pytest.mark.parametrize(
    "values, ratio", [(["1", "2", "3"], 1.0), ([None, None, None], 1 / 3), (["1", "1", "3", "3"], 0.5), (["1", None], 1.0)]
)
def test_unique_ratio(spark, values, ratio):
    df = spark.createDataFrame(make_cells({1: {"gold": {"c": values}}}), CELLS)
    assert ops.column_profile(df).first().unique_ratio == pytest.approx(ratio)


def test_order_of_set_metrics(cells):
    r = ops.nested_value_metrics(cells, ranked=False).filter("jaccard > dice_coeff + 1e-9 OR dice_coeff > overlap + 1e-9")
    assert r.isEmpty()


def test_partitioning_changes_nothing(cells):
    a = ops.cross_metrics(cells.repartition(1))
    b = ops.cross_metrics(cells.repartition(13, "value"))
    assert same_rows(a, b)


def test_pairs_and_components(spark):
    tables = {1: {"gold": {"a": ["x", "y", ""], "b": ["z"]}, "pred": {"c": ["x", "x"], "d": [""]}}}
    pairs = ops.column_pair_join(spark.createDataFrame(make_cells(tables), CELLS))
    got = {(r.gcol, r.pcol): (r.n_gold, r.n_pred, r.n_common) for r in pairs.collect()}
    assert got == {("a", "c"): (2, 1, 1), ("a", "d"): (2, 0, 0), ("b", "c"): (1, 1, 0), ("b", "d"): (1, 0, 0)}
    r = ops.best_column_pair_components(pairs, [ops.set_jaccard, ops.set_overlap, ops.set_dice]).first()
    assert (r.score_0, r.score_1) == (0.5, 1.0) and not hasattr(r, "score_2")
    assert ops.best_column_pair(pairs, ops.set_overlap, maximise=False).first().score == 0.0


def test_relevance_and_run_lists(spark):
    df = spark.createDataFrame(make_cells({1: {"gold": {"c": ["a", None, "c"]}, "pred": {"c": ["b", "b", "d"]}}}), CELLS)
    assert sorted((r.qid, r.doc_id, r.relevance) for r in ops.to_qrels(df).collect()) == [(1, "a", 1), (1, "c", 1)]
    assert [(r.doc_id, r["rank"]) for r in ops.rank_run(ops.to_runs(df), ["qid"]).orderBy("rank").collect()] == [("d", 1), ("b", 2)]


def test_report_of_empty_texts_is_zero(spark, cells):
    texts = spark.createDataFrame([(1, "", "x")], "row_id bigint, prediction string, reference string")
    logs = [texts.agg(F.count(F.lit(1)).alias("timeout_count"))]
    r = ops.final_report(cells, texts, [texts.agg(F.lit(1.0).alias("bleu"))], logs).first()
    assert r.bleu == 0.0 and r.cross_map == 0.0 and r.timeout_count == 1
    full = ops.final_report(cells, texts.withColumn("prediction", F.lit("a")), [texts.agg(F.lit(1.0).alias("bleu"))], logs).first()
    assert full.bleu == 1.0 and full.cross_map > 0 and full.gnv_overlap > 0


def test_merge_gold(spark):
    pred = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "qid bigint, p array<string>")
    gold = spark.createDataFrame([(1, ["g"], "s")], "qid bigint, g array<string>, t string")
    got = {r.qid: (r.g, r.t) for r in ops.merge_gold(pred, gold).collect()}
    assert got == {1: (["g"], "s"), 2: ([], None)}


def test_answers_of_many_columns(spark):
    """Numbers in both words of a side, column 63 and 64 among them."""
    rng = random.Random(3)

    def side(name, n):
        return {f"{name}{i}": [f"v{rng.randint(0, 40)}" for _ in range(4)] for i in range(n)}

    tables = {1: {"gold": side("g", 70), "pred": side("p", 66)}, 2: {"gold": side("g", 1), "pred": side("p", 128)}}
    df = spark.createDataFrame(make_cells(tables), CELLS)
    check(ops.cross_metrics(df, hot_rows=None), {q: best(t["gold"], t["pred"]) for q, t in tables.items()})
    got = {(r.qid, r.gcol, r.pcol): r.n_common for r in ops.column_pair_join(df).collect()}
    assert got == {
        (q, g, p): len(set(a) & set(b)) for q, t in tables.items() for g, a in t["gold"].items() for p, b in t["pred"].items()
    }


def test_a_column_without_room_is_an_error(spark):
    df = spark.createDataFrame([(1, "gold", 1, 128, "c", "literal", "x")], CELLS)
    with pytest.raises(Exception, match="no room in 2 words for column 128"):
        ops.answer_values(df).collect()
    assert ops.answer_values(df, words=3).first().gold_2 == 1


def test_cells_dealt_by_answer_are_not_shuffled_again(spark, tables):
    """Profiles and column pairs stay in the tasks that the answers were dealt to, also without broadcasts."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = spark.createDataFrame(make_cells(tables), CELLS).repartition(7, "qid")
        pairs = ops.column_pair_join(cells)
        for df in (ops.column_profile(cells), ops.entity_columns(cells), ops.key_columns(cells), pairs, ops.best_column_pair(pairs, ops.set_jaccard)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_profile_of_odd_columns(spark):
    """Columns beyond the words, columns of one number, cells of no answer and of other sides."""
    rows = [
        (1, "gold", 1, 300, "far", "literal", "x"), (1, "gold", 2, 300, "far", "literal", None), (1, "gold", 3, 300, "far", "literal", ""),
        (1, "gold", 4, 300, "far", "literal", "x"), (1, "pred", 1, 0, "e", "uri", IRI + "1"), (1, "pred", 1, 0, "f", "literal", "y"),
        (None, "gold", 1, 0, "e", "uri", IRI + "1"), (1, "other", 1, 0, "e", "uri", IRI + "1"),
    ]
    got = {(r.qid, r.side, r.number, r.col): r[4:] for r in ops.column_profile(spark.createDataFrame(rows, CELLS)).collect()}
    assert got == {
        (1, "gold", 300, "far"): (4, 3, 1, False, 0.75), (1, "pred", 0, "e"): (1, 1, 1, True, 1.0), (1, "pred", 0, "f"): (1, 1, 1, False, 1.0),
    }


def test_metrics_and_runs_are_not_shuffled_again(spark, tables):
    """Runs, hits, sizes and the best of an answer stay in the tasks that its cells were dealt to."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = spark.createDataFrame(make_cells(tables), CELLS).repartition(7, "qid")
        metrics = [ops.nested_value_metrics(cells, ranked=ranked, hot_rows=None) for ranked in (False, True)]
        for df in (*metrics, ops.cross_metrics(cells, hot_rows=None), ops.rank_run(ops.to_runs(cells, per_column=True), ["qid", "col"], None)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_report_is_the_same_with_and_without_hot_answers(spark, cells, hot_rows):
    """The cells dealt by answer, or written and spread by value, give the means of the views by themselves."""
    texts = spark.createDataFrame([(1, "a", "x")], "row_id bigint, prediction string, reference string")
    r = ops.final_report(cells.repartition(7, "qid"), texts, [texts.agg(F.lit(1.0).alias("bleu"))], [], hot_rows=hot_rows).first()
    for name, view in (("gnv", ops.nested_value_metrics), ("cross", ops.cross_metrics), ("id", ops.id_column_metrics)):
        want = view(cells, hot_rows=None).agg(*[F.avg(m).alias(m) for m in ANSWER_METRICS]).first()
        for m in ANSWER_METRICS:
            assert r[f"{name}_{m}"] == pytest.approx(want[m]), (name, m)


@pytest.mark.parametrize("name", ["final_report", "final_report_by_line"])
def test_report_deals_its_cells_once(spark, tmp_path, monkeypatch, name):
    """No view of the report writes or shuffles cells: order lines and texts are each dealt out once, also without broadcasts."""
    lines = [(q, i, i % 5, (q + i) % 4, 1.5 * i, "ANR"[i % 3]) for q in range(40) for i in range(q % 6)]
    lines = spark.createDataFrame(
        lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_extendedprice double, l_returnflag string"
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    talk = [(c, t, f"one two {c} three {t}\nfour") for c in range(5) for t in range(4)]
    spark.createDataFrame(talk, "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    events = [(i, i, ["view", "click", "error", "signup"][i % 4]) for i in range(12)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(ops, "settle", lambda df, label: pytest.fail(f"{label} are written"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = QUERIES[name](spark, str(tmp_path))
        assert report.count() == 1 and report.collect()[0].cross_map > 0
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert set(re.findall(r"Exchange (\w+)[^\n]*ENSURE_REQUIREMENTS", plan)) == {"SinglePartition"}
    for key in ("l_orderkey", "row_id"):
        dealt = re.findall(rf"ReusedExchange \[{key}[^\n]*REPARTITION_BY_NUM, \[plan_id=(\d+)\]", plan)
        assert len(dealt) > 1 and len(set(dealt)) == 1
