"""Sources, sinks and the stream. What is written goes to a new path in the shared folder."""

from pyspark.sql import functions as F

from quercus.functions.status import execution_status
from quercus.operators import sampling
from quercus.plans.corpus import SPLIT_SQL
from quercus.plans.executions import CLASS, KIND, STATUS
from quercus.plans.registry import query, rounded
from quercus.session import fresh_path
from quercus.sources import readers, sinks, stages
from quercus.sources.tables import answers, documents, executions, runs
from quercus.streaming.status_stream import stream_status as run_stream


@query("SELECT CAST(run_id AS VARCHAR) AS run_id, run_name, state, CAST(memory_bytes AS VARCHAR) AS memory_bytes, CAST(CAST(round(eval_bleu * 1000000) AS BIGINT) AS VARCHAR) AS bleu_millionths FROM runs", ["runs"])
def load_columnar_json(spark, sf):
    """With a column that has nulls, which the objects leave out."""
    millionths = F.round(F.col("eval_bleu") * 1000000).cast("bigint").alias("bleu_millionths")
    df = runs(spark, sf).select("run_id", "run_name", "state", "memory_bytes", millionths)
    path = sinks.write_columnar_json(df, "run_id", fresh_path(spark, "columnar"))
    return readers.load_columnar_json(spark, path, ["run_name", "state", "memory_bytes", "bleu_millionths"], index="run_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def load_columnar_objects(spark, sf):
    """Objects of whole texts, cut by byte ranges and not by lines."""
    df = documents(spark, sf).select(F.col("row_id").alias("doc_id"), "text", "lang", "n_chars")
    path = sinks.write_columnar_json(df, "doc_id", fresh_path(spark, "columnar-objects"))
    return readers.load_columnar_objects(spark, path, ["text", "lang", "n_chars"], index="doc_id")


RUN_SCHEMA = "run_id BIGINT, run_name STRING, state STRING, model STRING, eval_bleu DOUBLE, eval_rouge2 DOUBLE, memory_bytes BIGINT"


@query("SELECT * FROM runs", ["runs"])
def load_run_csv(spark, sf):
    path = fresh_path(spark, "runs-csv")
    runs(spark, sf).write.option("header", True).csv(path)
    return readers.load_run_csv(spark, path, RUN_SCHEMA)


def model_means(spark, sf):
    return runs(spark, sf).groupBy("model").agg(
        F.round(F.avg("eval_bleu"), 9).alias("bleu"), F.round(F.avg("eval_rouge2"), 9).alias("rouge2"), F.count(F.lit(1)).alias("n_runs")
    )


@query("SELECT model AS model_name, round(avg(eval_bleu), 9) AS bleu, round(avg(eval_rouge2), 9) AS rouge2, count(*) AS n_runs FROM runs GROUP BY model", ["runs"])
def stack_eval_files(spark, sf):
    """One file per model, holding one object."""
    path = fresh_path(spark, "evals")
    named = model_means(spark, sf).withColumn("model_name", F.col("model"))
    named.repartition("model").write.partitionBy("model").json(path)
    return readers.stack_eval_files(spark, path, "model_name STRING, bleu DOUBLE, rouge2 DOUBLE, n_runs BIGINT")


@query(
    """SELECT round(avg(eval_bleu), 9) AS bleu, count(*) AS n_runs, CASE WHEN run_id % 2 = 0 THEN 'labeled' ELSE 'basic' END AS input,
 CASE WHEN run_id % 3 = 0 THEN 'labeled' ELSE 'basic' END AS target, CASE WHEN state = 'failed' THEN 'Mistral' ELSE 'Llama 3' END AS model,
 CASE WHEN run_id % 4 = 0 THEN 'Llama 3' ELSE 'Mistral' END AS dataset FROM runs GROUP BY ALL""",
    ["runs"],
)
def load_eval_tree(spark, sf):
    """Metrics per configuration, written as a tree whose names carry the configuration."""
    key = F.col("run_id")
    named = runs(spark, sf).select(
        "eval_bleu",
        F.concat(
            F.when(F.col("state") == "failed", F.lit("mistral")).otherwise("llama3"), F.lit("_on_"),
            F.when(key % 4 == 0, F.lit("llama3")).otherwise("mistral"),
        ).alias("folder"),
        F.concat(
            F.lit("eval_of_run_"), F.when(key % 2 == 0, F.lit("templated")).otherwise("basic"), F.lit("_to_query_"),
            F.when(key % 3 == 0, F.lit("template")).otherwise("raw"), F.lit(".json"),
        ).alias("file"),
    )
    metrics = named.groupBy("folder", "file").agg(F.round(F.avg("eval_bleu"), 9).alias("bleu"), F.count(F.lit(1)).alias("n_runs"))
    path = fresh_path(spark, "eval-tree")
    metrics.select("folder", "file", F.struct("bleu", "n_runs").alias("metrics")).repartition("folder", "file").write.partitionBy(
        "folder", "file"
    ).json(path)
    return readers.load_eval_tree(spark, path, "bleu DOUBLE, n_runs BIGINT")


@query("SELECT * FROM executions", ["executions"])
def sink_parquet_gzip(spark, sf):
    return readers.load_dataset(spark, sinks.sink_parquet_gzip(executions(spark, sf), fresh_path(spark, "executions") + ".parquet.gzip"))


EXPORTED = """SELECT 'dataset' AS part, row_id, conv_id, attempt, answer, target, is_skipped, status, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS BIGINT) AS n_skipped
 FROM answers WHERE row_id >= 1000
UNION ALL SELECT 'summary', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'table', count(*) FILTER (is_skipped) FROM answers"""


def both_parts(rows, total):
    shown = total.select(F.lit("summary").alias("part"), F.col("PROVIDER").alias("provider"), F.col("NUMBER_OF_SKIPPED_ROWS").alias("n_skipped"))
    return rows.select(F.lit("dataset").alias("part"), "*").unionByName(shown, allowMissingColumns=True)


@query(EXPORTED, ["answers"])
def sink_dataset_and_summary(spark, sf):
    df = answers(spark, sf)
    data, summary = sinks.sink_dataset_and_summary(df, fresh_path(spark, "export"), {"PROVIDER": "table"}, offset=1000)
    rows = spark.read.json(data, schema=df.schema)
    return both_parts(rows, spark.read.json(summary, schema="PROVIDER string, NUMBER_OF_SKIPPED_ROWS bigint"))


@query(EXPORTED, ["answers"])
def sink_dataset_with_summary(spark, sf):
    df = answers(spark, sf)
    path = sinks.sink_dataset_with_summary(df, fresh_path(spark, "export-one"), {"PROVIDER": "table"}, offset=1000)
    written = spark.read.schema("content string, part string").json(path)
    rows = written.filter("part = 'dataset'").select(F.from_json("content", df.schema).alias("r")).select("r.*")
    kind = "PROVIDER string, NUMBER_OF_SKIPPED_ROWS bigint"
    return both_parts(rows, written.filter("part = 'summary'").select(F.from_json("content", kind).alias("r")).select("r.*"))


@query(
    f"SELECT CASE WHEN has_error THEN 'generation_failed' ELSE {STATUS} END AS status, NOT has_error AND {STATUS} = 'to_eval' AS is_parsed, row_id, execution FROM executions",
    ["executions"],
)
def gold_bundle(spark, sf):
    path = sinks.sink_gold_bundle(executions(spark, sf), fresh_path(spark, "gold"))
    return sinks.read_gold_bundle(spark, path).select("status", "is_parsed", "row_id", "execution")


@query(SPLIT_SQL)
def sink_splits(spark, sf):
    path = sinks.sink_splits(sampling.split_75_5_20(documents(spark, sf)), fresh_path(spark, "splits"))
    return spark.read.parquet(path).select("row_id", "text", "lang", "source", "n_chars", "split")


@query("SELECT row_id, execution FROM executions WHERE row_id % 3 <> 0", ["executions"])
def resume_unprocessed(spark, sf):
    df = executions(spark, sf).select("row_id", "execution")
    done = sinks.sink_parquet_gzip(df.filter("row_id % 3 = 0").select("row_id"), fresh_path(spark, "done"))
    return sinks.resume_unprocessed(df, spark.read.parquet(done))


@query(
    f"SELECT row_id, {STATUS} AS status, CASE WHEN {STATUS} = 'fail' THEN {KIND.format(e='execution')} END AS error_type, "
    f"CASE WHEN {STATUS} = 'fail' THEN {CLASS.format(e='execution')} END AS error_classes FROM executions",
    ["executions"],
)
def stream_status(spark, sf):
    source, target = fresh_path(spark, "log"), fresh_path(spark, "classified")
    df = executions(spark, sf)
    df.write.parquet(source)
    run_stream(spark, source, df.schema, target, fresh_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(target).select("row_id", "status", "error_type", "error_classes")


def finished(df, state):
    return df.filter(F.col("state") == state).select("run_id", "model", "memory_bytes")


def memory_by_model(df):
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("memory_bytes").alias("memory_bytes"))


@query(
    "SELECT model, count(*) AS n_runs, CAST(sum(memory_bytes) AS BIGINT) AS memory_bytes, 'finished,memory' AS first_written, 'memory' AS after_a_cut, '' AS again FROM runs WHERE state = 'finished' GROUP BY model",
    ["runs"],
)
def resume_stages(spark, sf):
    """Two stages run three times: whole, after the last one was cut off before its commit, and once more."""
    folder, path = fresh_path(spark, "ledger"), f"{sf}/part.parquet"
    steps = [stages.Stage("finished", finished, {"state": "finished"}), stages.Stage("memory", memory_by_model)]

    def run():
        return stages.run_stages(spark, runs(spark, sf), [path], steps, folder)

    first = run()[1]
    mark, system = stages._file_system(spark, folder)
    for one in system.listStatus(mark):
        if one.getPath().getName().startswith("memory-"):
            system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one.getPath(), stages.COMMITTED), False)
    cut = run()[1]
    df, again = run()
    names = {"first_written": first, "after_a_cut": cut, "again": again}
    return df.select("*", *[F.lit(",".join(v)).alias(k) for k, v in names.items()])
