"""Projections over corpus tables."""

from pyspark.sql import functions as F

from quercus.operators import columns as ops
from quercus.plans.corpus import QUESTIONS, questions
from quercus.plans.registry import query
from quercus.sources.tables import executions, queries, table


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_metadata(spark, sf):
    return ops.flatten_json(table(spark, sf, "events").select("event_id", "event_type", "props"), "props", "k bigint")


@query(
    "SELECT q.row_id, description AS basic_input, context AS templated_input, query AS target_raw, query AS target_template, execution AS gold_execution, query AS gold_executed_query "
    "FROM queries q JOIN executions e USING (row_id)",
    ["queries", "executions"],
)
def finetune_projection(spark, sf):
    df = queries(spark, sf).join(executions(spark, sf), "row_id").select(
        "row_id", F.col("description").alias("basic_result"), F.col("context").alias("templated_result"), "query",
        F.col("query").alias("query_templated"), "execution", F.col("query").alias("executed_query"),
    )
    return ops.finetune_projection(df)


@query(f"SELECT row_id, inputs[1] AS input FROM {QUESTIONS}")
def first_of_list(spark, sf):
    return ops.first_of_list(questions(spark, sf), "inputs").select("row_id", F.col("inputs").alias("input"))
