import json

import pandas as pd
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from quercus.sources import readers, sinks
from quercus.streaming.status_stream import stream_status


def test_load_dataset(spark, tmp_path):
    with pytest.raises(TypeError):
        readers.load_dataset(spark, 5)
    with pytest.raises(FileNotFoundError):
        readers.load_dataset(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        readers.load_dataset(spark, str(tmp_path / "a.txt"))
    path = sinks.sink_parquet_gzip(spark.range(3), str(tmp_path / "t.parquet.gzip"))
    assert readers.load_dataset(spark, path).count() == 3
    (tmp_path / "rows.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.load_dataset(spark, tmp_path / "rows.json").count() == 2


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b, c"):
        readers.require_columns(spark.range(1), ["id", "b", "c"])


def test_columnar_json_of_pandas(spark, tmp_path):
    frame = pd.DataFrame({"a": ["x", "y\nz", None], "b": [1, 2, 3]}, index=[4, 5, 9])
    (tmp_path / "one.json").write_text(frame.to_json())
    (tmp_path / "two.json").write_text(frame.rename(index=lambda i: i + 10).to_json())
    got = {(r["index"], r.a, r.b) for r in readers.load_columnar_json(spark, str(tmp_path)).collect()}
    assert got == {(str(i + d), a, str(b)) for d in (0, 10) for i, (a, b) in zip([4, 5, 9], [("x", 1), ("y\nz", 2), (None, 3)])}
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / "x.json").write_text(json.dumps(json.loads(frame.to_json()), indent=2))
    assert readers.load_columnar_json(spark, str(tmp_path / "wide"), multi_line=True).count() == 3


def test_columnar_json_round_trip(spark, tmp_path):
    df = spark.range(2500).select("id", F.concat(F.lit("v"), "id").alias("t"))
    path = sinks.write_columnar_json(df, "id", str(tmp_path / "c"), rows_per_object=100)
    back = readers.load_columnar_json(spark, path, ["t"], index="id")
    assert same_rows(back.select(F.col("id").cast("bigint"), "t"), df)


def test_stacked_files_unite_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"bleu": 0.5, "model": "m"}')
    (tmp_path / "b.json").write_text('{\n "bleu": 0.25,\n "extra": 1}')
    got = {(r.bleu, r.model, r.extra) for r in readers.stack_eval_files(spark, str(tmp_path)).collect()}
    assert got == {(0.5, "m", None), (0.25, None, 1)}
    (tmp_path / "empty").mkdir()
    assert readers.stack_eval_files(spark, str(tmp_path / "empty")) is None


def test_eval_tree_of_plain_files(spark, tmp_path):
    folder = tmp_path / "deep" / "llama3_on_mistral"
    folder.mkdir(parents=True)
    (folder / "eval_of_run_templated_to_query_raw.json").write_text('{"metrics": {"bleu": 0.5}, "other": 1}')
    r = readers.load_eval_tree(spark, str(tmp_path)).first()
    assert (r.bleu, r.input, r.target, r.model, r.dataset) == (0.5, "labeled", "basic", "Llama 3", "Mistral")


def test_gold_bundle(spark, tmp_path):
    rows = [(1, False, "[{'a': {'value': 'x'}}]"), (2, True, "exception: x"), (3, False, "timeout"), (4, False, "[]"), (5, False, "[{'a"), (6, False, "exception: y")]
    df = spark.createDataFrame(rows, "row_id bigint, has_error boolean, execution string")
    path = sinks.sink_gold_bundle(df, str(tmp_path / "gold"))
    sizes = {s: sinks.read_gold_bundle(spark, path, s).count() for s in ("all", "timeout", "fail", "empty", "to_eval", "eval")}
    assert sizes == {"all": 6, "timeout": 1, "fail": 1, "empty": 1, "to_eval": 2, "eval": 1}


def test_resume(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert sinks.resume_unprocessed(df, df.filter("row_id < 7")).count() == 3


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = spark.createDataFrame([(1, "timeout"), (2, "exception: query is empty")], "row_id bigint, execution string")
    first.write.parquet(source)
    stream_status(spark, source, first.schema, target, mark).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    second = spark.createDataFrame([(3, "[]")], first.schema)
    second.write.mode("append").parquet(source)
    stream_status(spark, source, first.schema, target, mark).awaitTermination()
    got = {r.row_id: (r.status, r.error_type, r.error_classes) for r in spark.read.parquet(target).collect()}
    assert got == {1: ("timeout", None, None), 2: ("fail", "empty query", "empty query"), 3: ("empty", None, None)}


def test_finished_stages_are_skipped(spark, tmp_path):
    from quercus.sources.stages import Stage, run_stages

    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)

    def even(df, rest):
        return df.filter(F.col("id") % 2 == rest)

    def doubled(df):
        return df.select((F.col("id") * 2).alias("id"))

    def run(rest=0):
        df, written = run_stages(spark, spark.read.parquet(source), [source], [Stage("even", even, {"rest": rest}), Stage("doubled", doubled)], str(tmp_path / "out"))
        return sorted(r.id for r in df.collect()), written

    assert run() == ([0, 4, 8, 12, 16], ["even", "doubled"])
    assert run() == ([0, 4, 8, 12, 16], [])
    assert run(1) == ([2, 6, 10, 14, 18], ["even", "doubled"])
    spark.range(10, 12).write.mode("append").parquet(source)
    assert run() == ([0, 4, 8, 12, 16, 20], ["even", "doubled"])
