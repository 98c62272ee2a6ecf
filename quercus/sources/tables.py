"""The given tables, and the same rows put into the shapes that the operators read.

Each function builds one derived table with DataFrame code; ``VIEW_SQL`` holds the same table as
SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quercus.operators.ordering import HOT_ROWS, by_group, hot_groups, rank_within

ENTITY = "http://www.wikidata.org/entity/"

#: Classes that orders are dealt to by hash, to look for hot ones.
ORDER_CLASSES = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")


def queries(spark, sf_dir):
    """Query texts with ids, some declared prefixes, COUNT, LIMIT and comments."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = F.concat(
        F.when(key % 4 == 1, F.lit(f"PREFIX wd: <{ENTITY}>\n")).otherwise(""),
        F.when(key % 5 == 0, F.lit("SELECT (COUNT(?x) AS ?n) WHERE {\n")).otherwise("SELECT ?x WHERE {\n"),
        F.lit("?x wdt:P"), (key % 2000).cast("string"),
        F.lit(" wd:Q"), (F.col("o_custkey") % 100).cast("string"),
        F.when(key % 3 == 0, F.lit(" . # note")).otherwise(""),
        F.lit("\n}"),
        F.when(key % 5 == 1, F.lit("\nLIMIT 5")).otherwise(""),
    )
    return o.select(
        key.alias("row_id"),
        text.alias("query"),
        F.col("o_orderpriority").alias("description"),
        F.when(key % 6 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("context"),
    )


def label_dict(spark, sf_dir):
    """id -> label by language; some entities have no English label, some none at all."""
    s = table(spark, sf_dir, "supplier")
    p = table(spark, sf_dir, "part")
    entity_id = F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("id")

    def entity(rows, lang, label):
        return rows.select(entity_id, F.lit("entity").alias("kind"), F.lit(lang).alias("lang"), label.alias("label"))

    english = entity(s.filter(F.col("s_suppkey") % 7 != 0), "en", F.col("s_name"))
    french = entity(s.filter(F.col("s_suppkey") % 14 != 0), "fr", F.concat(F.lit("fournisseur "), F.col("s_name")))
    properties = p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
        F.lit("property").alias("kind"), F.lit("en").alias("lang"), F.col("p_name").alias("label"),
    )
    return english.unionByName(french).unionByName(properties)


def _caused(status: str, *causes: str) -> str:
    return f"exception: {status}" + "".join(f"\nCaused by: {c}" for c in causes)


#: One text for every error type and class, some with several classes, decoys or none.
FAILURES = [
    _caused("400 Client Error", "first", "MalformedQueryException: Lexical error"),
    _caused("400 Client Error", "ast.ParseException: Encountered LIMIT"),
    _caused("500 Server Error", "java.lang.StackOverflowError"),
    "exception: query is empty",
    "exception: body\njava.util.concurrent.TimeoutException" + "\n\tat some.place" * 800,
    "exception: other",
    _caused("400 Client Error", "QueryParseException: undefined prefix"),
    _caused("400 Client Error", "ast.ParseException: Encountered FILTER"),
    _caused("400 Client Error", "VisitorException: Non-aggregate variable in select expression"),
    _caused("400 Client Error", "MalformedQueryException: Multiple prefix declarations for prefix"),
    _caused("500 Server Error", "StackOverflowError", "GeoSpatialSearchException: Input could not be resolved as point"),
    _caused("500 Server Error", "QueryTimeout: The estimated execution time"),
    _caused("500 Server Error", "MemoryManagerOutOfMemory"),
    _caused("500 Server Error", "java.lang.NullPointerException at StackOverflowError"),
    "exception: module 'requests.exceptions' has no attribute 'JSONDecodeError'",
    "exception: module 'requests.exceptions' is not known",
    "exception: (Connection broken: InvalidChunkLength(got length b'', 0 bytes read))",
    "exception: 500 Server Error: the response has an Invalid chunk length: 12",
    _caused("429 Client Error", "too many requests"),
    _caused("400 Client Error", "ast.ParseException: undefined prefix near limit"),
    _caused("400 Client Error"),
    "exception: " + "x" * 120 + " exception: query is empty",
]


def executions(spark, sf_dir):
    """One stored execution per query: all statuses, several error classes."""
    e = table(spark, sf_dir, "events")
    key, kind = F.col("event_id"), F.col("event_type")
    failure = F.lit(FAILURES[0])
    for rest, text in enumerate(FAILURES):
        failure = F.when(key % len(FAILURES) == rest, F.lit(text)).otherwise(failure)
    answer = F.concat(
        F.lit("[{'id': {'type': 'uri', 'value': '" + ENTITY + "Q"), F.col("user_id").cast("string"),
        F.lit("'}, 'n': {'type': 'literal', 'datatype': 'http://www.w3.org/2001/XMLSchema#integer', 'value': '"),
        (key % 10).cast("string"), F.lit("'}}]"),
    )
    return e.select(
        key.alias("row_id"),
        ((kind == "signup") & (key % 3 == 0)).alias("has_error"),
        F.when(kind == "view", F.lit("[]")).when(kind == "click", F.lit("timeout"))
        .when(kind == "error", failure).otherwise(answer).alias("execution"),
    )


def answer_bound(spark, sf_dir) -> int | None:
    """``hot_rows`` for answers made of order lines: None if no order comes near the limit.

    A column of an answer has at most as many values as its order has lines, a side at most twice
    as many; so one look at the line counts settles the question for every operator on the cells.
    Lines are counted by class of orders, so a task holds a fixed number of counts. No order has more
    lines than its class; where a class comes near the limit, the operators ask by order.
    """
    order_class = F.pmod(F.xxhash64("l_orderkey"), F.lit(ORDER_CLASSES)).alias("order_class")
    lines = table(spark, sf_dir, "lineitem").select(order_class)
    return None if hot_groups(lines, ["order_class"], HOT_ROWS // 2).isEmpty() else HOT_ROWS


def cells(spark, sf_dir, hot_rows: int | None = HOT_ROWS):
    """Gold and predicted answer tables as long cells; predictions miss rows and differ in some, and
    every eleventh answer has no gold.

    Lines are numbered by all columns that are read, so that whoever works the cells out again finds the same ones.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    rows = rank_within(
        by_group(lines, ["l_orderkey"], lines.count()),
        ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"], "row_no", hot_rows,
    )
    turn = F.col("l_orderkey") + F.col("row_no")
    predicted = turn % 5 != 0
    golden = F.col("l_orderkey") % 11 != 0

    def iri(number):
        return F.concat(F.lit(ENTITY + "Q"), number.cast("string"))

    def cell(present, side, pos, col, kind, value):
        return F.when(
            present,
            F.struct(
                F.lit(side).alias("side"), F.lit(pos).alias("col_pos"), F.lit(col).alias("col"),
                F.lit(kind).alias("kind"), value.alias("value"),
            ),
        )

    supplier, flag = F.col("l_suppkey"), F.col("l_returnflag")
    made = F.array_compact(
        F.array(
            cell(golden, "gold", 0, "item", "uri", iri(supplier)),
            cell(golden, "gold", 1, "flag", "literal", flag),
            cell(predicted, "pred", 0, "x", "uri", iri(F.when(turn % 3 == 0, supplier + 1).otherwise(supplier))),
            cell(predicted, "pred", 1, "y", "literal", F.when(F.col("row_no") % 4 == 0, F.lit("")).otherwise(flag)),
        )
    )
    return rows.select(
        F.col("l_orderkey").alias("qid"), F.col("row_no").cast("int").alias("row_no"), F.explode(made).alias("c")
    ).select("qid", "c.side", "row_no", "c.col_pos", "c.col", "c.kind", "c.value")


def answers(spark, sf_dir):
    """Generated answers, tagged or not, with attempt numbers and a reference text."""
    c = table(spark, sf_dir, "conversations")
    turn, text = F.col("turn"), F.col("text")
    body = F.concat(F.lit("SELECT ?x WHERE { "), text, F.lit(" }"))
    return c.select(
        (F.col("conv_id") * 1000 + turn).alias("row_id"),
        "conv_id",
        turn.cast("int").alias("attempt"),
        F.when(turn % 4 == 3, text)
        .otherwise(F.concat(F.lit("Sure [query]"), body, F.lit("[/query] done"))).alias("answer"),
        body.alias("target"),
        (turn % 4 == 3).alias("is_skipped"),
        F.when(turn % 4 == 3, F.lit("Unexpected err.msg=\"The LLM result doesn't match desired format.\""))
        .when(turn % 4 == 2, F.lit("Unexpected err")).otherwise("").alias("status"),
    )


def runs(spark, sf_dir):
    """Experiment runs: packed run name, state, metrics, some of them null."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        key.alias("run_id"),
        F.concat(
            F.lit("M_rv"), (size * 8).cast("string"), F.lit("-gc"), (key % 2).cast("string"),
            F.lit("-ctx"), ((key % 3 + 1) * 1024).cast("string"), F.lit("-q4bit-"), F.lower("p_type"),
        ).alias("run_name"),
        F.when(key % 5 == 0, F.lit("failed")).otherwise("finished").alias("state"),
        F.col("p_brand").alias("model"),
        F.when(key % 9 != 0, F.col("p_retailprice") / 2000.0).alias("eval_bleu"),
        ((size % 10) / 10.0).alias("eval_rouge2"),
        (key * 1048576).alias("memory_bytes"),
    )


def _sql_text(text: str) -> str:
    return "replace('" + text.replace("'", "''").replace("\n", "~~") + "', '~~', chr(10))"


FAILURE_SQL = (
    f"CASE CAST(event_id % {len(FAILURES)} AS INT) "
    + " ".join(f"WHEN {i} THEN {_sql_text(t)}" for i, t in enumerate(FAILURES)) + " END"
)

VIEW_SQL = {
    "queries": """SELECT o_orderkey AS row_id,
  concat(CASE WHEN o_orderkey % 4 = 1 THEN concat('PREFIX wd: <http://www.wikidata.org/entity/>', chr(10)) ELSE '' END,
    CASE WHEN o_orderkey % 5 = 0 THEN 'SELECT (COUNT(?x) AS ?n) WHERE {' ELSE 'SELECT ?x WHERE {' END, chr(10),
    '?x wdt:P', CAST(o_orderkey % 2000 AS VARCHAR), ' wd:Q', CAST(o_custkey % 100 AS VARCHAR),
    CASE WHEN o_orderkey % 3 = 0 THEN ' . # note' ELSE '' END, chr(10), '}',
    CASE WHEN o_orderkey % 5 = 1 THEN concat(chr(10), 'LIMIT 5') ELSE '' END) AS query,
  o_orderpriority AS description,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderstatus END AS context
FROM orders""",
    "label_dict": """SELECT concat('Q', CAST(s_suppkey AS VARCHAR)) AS id, 'entity' AS kind, 'en' AS lang, s_name AS label
FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL
SELECT concat('Q', CAST(s_suppkey AS VARCHAR)), 'entity', 'fr', concat('fournisseur ', s_name) FROM supplier WHERE s_suppkey % 14 <> 0
UNION ALL
SELECT concat('P', CAST(p_partkey AS VARCHAR)), 'property', 'en', p_name FROM part""",
    "executions": """SELECT event_id AS row_id, (event_type = 'signup' AND event_id % 3 = 0) AS has_error,
  CASE event_type WHEN 'view' THEN '[]' WHEN 'click' THEN 'timeout'
    WHEN 'error' THEN @FAILURE@
    ELSE concat('[{''id'': {''type'': ''uri'', ''value'': ''http://www.wikidata.org/entity/Q', CAST(user_id AS VARCHAR),
      '''}, ''n'': {''type'': ''literal'', ''datatype'': ''http://www.w3.org/2001/XMLSchema#integer'', ''value'': ''', CAST(event_id % 10 AS VARCHAR), '''}}]') END AS execution
FROM events""".replace("@FAILURE@", FAILURE_SQL),
    "numbered_lines": """SELECT l_orderkey, l_suppkey, l_returnflag,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS row_no FROM lineitem""",
    "cells": """SELECT l_orderkey AS qid, 'gold' AS side, row_no, 0 AS col_pos, 'item' AS col, 'uri' AS kind,
  concat('http://www.wikidata.org/entity/Q', CAST(l_suppkey AS VARCHAR)) AS value FROM numbered_lines WHERE l_orderkey % 11 <> 0
UNION ALL
SELECT l_orderkey, 'gold', row_no, 1, 'flag', 'literal', l_returnflag FROM numbered_lines WHERE l_orderkey % 11 <> 0
UNION ALL
SELECT l_orderkey, 'pred', row_no, 0, 'x', 'uri', concat('http://www.wikidata.org/entity/Q',
  CAST(CASE WHEN (l_orderkey + row_no) % 3 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS VARCHAR)) FROM numbered_lines WHERE (l_orderkey + row_no) % 5 <> 0
UNION ALL
SELECT l_orderkey, 'pred', row_no, 1, 'y', 'literal', CASE WHEN row_no % 4 = 0 THEN '' ELSE l_returnflag END FROM numbered_lines WHERE (l_orderkey + row_no) % 5 <> 0""",
    "answers": """SELECT conv_id * 1000 + turn AS row_id, conv_id, CAST(turn AS INT) AS attempt,
  CASE WHEN turn % 4 = 3 THEN text ELSE concat('Sure [query]SELECT ?x WHERE { ', text, ' }[/query] done') END AS answer,
  concat('SELECT ?x WHERE { ', text, ' }') AS target, (turn % 4 = 3) AS is_skipped,
  CASE WHEN turn % 4 = 3 THEN 'Unexpected err.msg="The LLM result doesn''t match desired format."' WHEN turn % 4 = 2 THEN 'Unexpected err' ELSE '' END AS status
FROM conversations""",
    "runs": """SELECT p_partkey AS run_id,
  concat('M_rv', CAST(p_size * 8 AS VARCHAR), '-gc', CAST(p_partkey % 2 AS VARCHAR), '-ctx', CAST((p_partkey % 3 + 1) * 1024 AS VARCHAR), '-q4bit-', lower(p_type)) AS run_name,
  CASE WHEN p_partkey % 5 = 0 THEN 'failed' ELSE 'finished' END AS state, p_brand AS model,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice / 2000e0 END AS eval_bleu,
  (p_size % 10) / 10e0 AS eval_rouge2, p_partkey * 1048576 AS memory_bytes
FROM part""",
}
