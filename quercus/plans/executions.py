"""Execution statuses, error taxonomy, re-execution studies."""

from pyspark.sql import functions as F

from quercus.fixed_values import ERROR_INDEX
from quercus.functions import status as st
from quercus.operators import corpus, executions as ops
from quercus.plans.registry import query, rounded
from quercus.sources.tables import answers, executions, queries, table
from quercus.functions import text as tx

KEPT = "SELECT * FROM executions WHERE NOT coalesce(has_error, false)"
STATUS = (
    "CASE WHEN execution IS NULL THEN 'missing' WHEN execution = 'timeout' THEN 'timeout' WHEN starts_with(execution, 'exception') THEN 'fail' "
    "WHEN starts_with(execution, '[]') THEN 'empty' ELSE 'to_eval' END"
)
CODE = "regexp_extract(substr({e}, 1, 20), 'exception: ([0-9]+)', 1)"
REQUESTS = "contains(substr({e}, 1, 50), 'exception: module ''requests.exceptions''')"
LATER = (
    "contains({e}, 'java.util.concurrent.TimeoutException') THEN 'server timeout' "
    "WHEN contains(substr({e}, 1, 100), 'exception: query is empty') THEN 'empty query' END"
)
TYPE = f"CASE WHEN {CODE} <> '' THEN {CODE} WHEN {REQUESTS} THEN 'requests' WHEN {LATER}"
KIND = (
    f"CASE WHEN {CODE} <> '' THEN {CODE} WHEN {REQUESTS} THEN 'requests' "
    f"WHEN contains(substr({{e}}, 1, 100), 'Connection broken: InvalidChunkLength') THEN 'invalid JSON' WHEN {LATER}"
)
CAUSE = "coalesce(list_extract(regexp_extract_all({e}, 'Caused by: .+'), -1), '')"


def _quoted(name):
    return "'" + name.replace("'", "''") + "'"


def _listed(*tests):
    return "[" + ", ".join(f"CASE WHEN {test} THEN {_quoted(name)} END" for test, name in tests) + "]"


def _in_cause(text):
    return f"contains({CAUSE}, '{text}')"


CLIENT = _listed(
    (_in_cause("undefined prefix"), "undefined prefix"),
    (_in_cause("ast.ParseException") + f" AND regexp_matches({CAUSE}, 'limit|LIMIT')", "parse exception due to limit"),
    (_in_cause("ast.ParseException") + f" AND NOT regexp_matches({CAUSE}, 'limit|LIMIT')", "parse exception"),
    (_in_cause("Lexical error"), "lexical error"),
    (_in_cause("Non-aggregate variable in select expression"), "non-aggregate variable in select expression"),
    (_in_cause("Multiple prefix declarations for prefix"), "Prefix duplicates"),
)
SERVER = _listed(
    (_in_cause("StackOverflowError"), "stack overflow"),
    (_in_cause("Input could not be resolved as point"), "GeoSpatialSearchException: input could not be resolved as point"),
    (_in_cause("The estimated execution time"), "estimated time to execute too long"),
    (_in_cause("MemoryManagerOutOfMemory"), "Out of memory"),
    (_in_cause("java.lang.NullPointerException"), "NullPointerException"),
    ("contains({e}, 'exception: 500 Server Error: the response has an Invalid chunk length')", "Invalid JSON"),
)
MODULE = _listed(
    ("contains(substr({e}, 1, 100), 'exception: module ''requests.exceptions'' has no attribute ''JSONDecodeError''')", "no attribute 'JSONDecodeError'")
)
#: The classes of a failure as a list, by its kind.
CLASSES = (
    f"list_filter(CASE {KIND} WHEN '400' THEN {CLIENT} WHEN '500' THEN {SERVER} WHEN 'requests' THEN {MODULE} WHEN 'invalid JSON' THEN ['Invalid JSON'] "
    "WHEN 'server timeout' THEN ['server timeout'] WHEN 'empty query' THEN ['empty query'] END, lambda x: x IS NOT NULL)"
)
CLASS = f"array_to_string({CLASSES}, ', ')"
INDEX = "CASE {c} " + " ".join(f"WHEN {_quoted(name)} THEN {n}" for name, n in ERROR_INDEX.items()) + " END"
AGAIN_SQL = f"""again AS (SELECT row_id, CASE WHEN row_id % 4 = 0 THEN '[]' WHEN row_id % 4 = 1 THEN 'exception: query is empty' ELSE execution END AS execution
 FROM executions WHERE starts_with(execution, 'exception') OR execution = 'timeout')"""


def again(spark, sf):
    """A second execution of the error rows: some are fixed, some fail differently."""
    key = F.col("row_id")
    return ops.select_errors(executions(spark, sf)).select(
        "row_id",
        F.when(key % 4 == 0, F.lit("[]")).when(key % 4 == 1, F.lit("exception: query is empty")).otherwise(F.col("execution")).alias("execution"),
    )


def dataset(key):
    return F.when(key % 3 == 0, F.lit("original")).otherwise(F.lit("final"))


@query(KEPT, ["executions"])
def drop_failed_generation(spark, sf):
    return corpus.drop_failed_generation(executions(spark, sf))


@query(f"SELECT row_id, {STATUS} AS status, CASE WHEN execution IS NULL THEN 'missing' WHEN execution = 'timeout' THEN 'timeout' "
       "WHEN starts_with(execution, 'exception') THEN 'fail' WHEN length(execution) = 0 THEN 'empty' ELSE 'to_eval' END AS status_by_length "
       f"FROM ({KEPT})", ["executions"])
def execution_status(spark, sf):
    df = ops.with_status(executions(spark, sf))
    return df.select("row_id", "status", st.execution_status_by_length(F.col("execution")).alias("status_by_length"))


@query(f"SELECT row_id, execution FROM executions WHERE {STATUS} = 'to_eval'", ["executions"])
def keep_working(spark, sf):
    return ops.keep_working(executions(spark, sf)).select("row_id", "execution")


@query("SELECT row_id, execution FROM executions WHERE execution LIKE 'exception%' OR execution LIKE 'timeout%'", ["executions"])
def select_errors(spark, sf):
    return ops.select_errors(executions(spark, sf)).select("row_id", "execution")


@query("SELECT row_id, starts_with(execution, '[{''') OR starts_with(execution, '[]') OR starts_with(execution, '{') AS ok FROM executions", ["executions"])
def execution_looks_correct(spark, sf):
    return executions(spark, sf).select("row_id", st.execution_looks_correct(F.col("execution")).alias("ok"))


@query(
    f"WITH s AS (SELECT unnest(['timeout', 'fail', 'empty', 'to_eval', 'missing']) AS status), c AS (SELECT {STATUS} AS status, count(*) AS n FROM executions GROUP BY 1) "
    "SELECT status, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100e0 / (SELECT sum(n) FROM c), 9) AS share FROM s LEFT JOIN c USING (status)",
    ["executions"],
)
def status_counts(spark, sf):
    return rounded(ops.status_counts(executions(spark, sf)), "share")


@query(
    f"WITH s AS (SELECT unnest(['timeout', 'fail', 'empty', 'to_eval', 'missing']) AS status), d AS (SELECT unnest(['original', 'final']) AS dataset), "
    f"c AS (SELECT CASE WHEN row_id % 3 = 0 THEN 'original' ELSE 'final' END AS dataset, {STATUS} AS status, count(*) AS n FROM executions GROUP BY ALL) "
    "SELECT dataset, status, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100e0 / sum(coalesce(n, 0)) OVER (PARTITION BY dataset), 9) AS share "
    "FROM s CROSS JOIN d LEFT JOIN c USING (status, dataset)",
    ["executions"],
)
def status_counts_by_dataset(spark, sf):
    counts = ops.status_counts_by(executions(spark, sf), dataset(F.col("row_id")))
    return rounded(ops.share_of_total(counts, "n", ["dataset"]), "share")


@query(f"SELECT {TYPE.format(e='execution')} AS error_type, count(*) AS n FROM executions WHERE {STATUS} = 'fail' AND error_type IS NOT NULL GROUP BY 1", ["executions"])
def value_counts(spark, sf):
    df = executions(spark, sf).filter(st.execution_status(F.col("execution")) == "fail")
    return corpus.value_counts(df, st.error_type(F.col("execution")), "error_type")


@query(f"SELECT {CLASS.format(e='execution')} AS classes, count(*) AS n FROM executions WHERE {STATUS} = 'fail' AND classes IS NOT NULL GROUP BY 1", ["executions"])
def value_counts_classes(spark, sf):
    df = executions(spark, sf).filter(st.execution_status(F.col("execution")) == "fail")
    return corpus.value_counts(df, F.array_join(st.error_classes(F.col("execution")), ", "), "classes")


@query(f"SELECT error_type, n, round(n * 100e0 / sum(n) OVER (), 9) AS share FROM (SELECT {TYPE.format(e='execution')} AS error_type, count(*) AS n "
       f"FROM executions WHERE {STATUS} = 'fail' GROUP BY 1)", ["executions"])
def share_of_total(spark, sf):
    df = executions(spark, sf).filter(st.execution_status(F.col("execution")) == "fail")
    counts = df.groupBy(st.error_type(F.col("execution")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(ops.share_of_total(counts), "share")


@query(f"SELECT {TYPE.format(e='execution')} AS error_type, count(*) AS n, arg_min(substr(execution, 1, 256), row_id) AS example "
       f"FROM executions WHERE {STATUS} = 'fail' GROUP BY 1", ["executions"])
def error_class_examples(spark, sf):
    return ops.error_class_examples(executions(spark, sf))


@query("SELECT count(*) FILTER (execution LIKE 'exception:%') AS exception_count, count(*) FILTER (execution LIKE 'timeout%') AS timeout_count FROM executions", ["executions"])
def exception_timeout_counts(spark, sf):
    return ops.exception_timeout_counts(executions(spark, sf))


@query("SELECT row_id, CASE WHEN execution LIKE 'exception:%' OR execution LIKE 'timeout%' THEN NULL ELSE execution END AS execution FROM executions", ["executions"])
def null_out_failures(spark, sf):
    return ops.null_out_failures(executions(spark, sf)).select("row_id", "execution")


@query("SELECT round(avg(CASE WHEN execution LIKE 'exception:%' OR execution LIKE 'timeout%' THEN 0 ELSE 1 END), 9) AS correct_syntax FROM executions", ["executions"])
def correct_syntax(spark, sf):
    return rounded(ops.correct_syntax(executions(spark, sf)), "correct_syntax")


@query("SELECT CASE WHEN status = '' THEN 'no' WHEN status LIKE 'Unexpected err.msg=\"The LLM result doesn''t match desired format.\"%' THEN 'NoSparqlMatch' "
       "ELSE 'other' END AS kind, count(*) AS n FROM answers GROUP BY 1", ["answers"])
def generation_error_mix(spark, sf):
    return corpus.value_counts(answers(spark, sf), tx.generation_error(F.col("status")), "kind")


@query(f"SELECT row_id, {TYPE.format(e='execution')} AS error_type FROM executions", ["executions"])
def error_type(spark, sf):
    return executions(spark, sf).select("row_id", st.error_type(F.col("execution")).alias("error_type"))


@query(f"SELECT row_id, {CLASS.format(e='execution')} AS classes FROM executions", ["executions"])
def error_classes(spark, sf):
    return executions(spark, sf).select("row_id", F.array_join(st.error_classes(F.col("execution")), ", ").alias("classes"))


@query(
    f"SELECT row_id, {INDEX.format(c=CLASSES.format(e='execution') + '[1]')} AS idx FROM executions",
    ["executions"],
)
def error_index(spark, sf):
    return executions(spark, sf).select("row_id", st.error_index(st.error_classes(F.col("execution"))).alias("idx"))


@query(
    f"SELECT classes[1] AS error_class, max(place) AS idx FROM (SELECT classes, row_number() OVER (ORDER BY classes) - 1 AS place FROM "
    f"(SELECT DISTINCT {CLASSES.format(e='execution')} AS classes FROM executions WHERE {STATUS} = 'fail') WHERE len(classes) > 0) GROUP BY 1",
    ["executions"],
)
def generated_error_index(spark, sf):
    return ops.generated_error_index(executions(spark, sf))


@query(
    """SELECT event_id AS row_id, CASE WHEN event_id % 11 = 0 THEN 'exception: query is empty' WHEN event_type = 'click' THEN 'timeout'
 WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'exception: 500 Server Error: the response has an Invalid chunk length: ' || props
 WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'exception: ' || props
 WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'exception: too many retry-after'
 WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'timeout'
 WHEN event_type = 'signup' THEN 'exception: ' || props || chr(10) || props ELSE props END AS execution FROM events"""
)
def normalise_response(spark, sf):
    e = table(spark, sf, "events")
    key, kind, props = F.col("event_id"), F.col("event_type"), F.col("props")
    text = F.when(key % 11 == 0, F.lit("  ")).otherwise(F.lit("SELECT ?x"))
    code = F.when((kind == "view") & (key % 2 == 0), 429).when(kind == "signup", 500).otherwise(200)
    body = F.when((kind == "signup") & (key % 2 == 0), F.concat(props, F.lit(" java.util.concurrent.TimeoutException"))).otherwise(props)
    failure = F.when(kind == "click", F.lit("timeout")).when((kind == "error") & (key % 3 == 0), F.lit("chunk")).when(
        (kind == "error") & (key % 3 == 1), F.lit("other")
    )
    return e.select(key.alias("row_id"), st.normalise_response(text, code, body, failure, props).alias("execution"))


@query(
    f"""WITH {AGAIN_SQL}, r AS (SELECT {TYPE.format(e='o.execution')} AS ot, {CLASSES.format(e='o.execution')} AS oc, {TYPE.format(e='a.execution')} AS nt,
 {CLASSES.format(e='a.execution')} AS nc FROM executions o JOIN again a USING (row_id) WHERE starts_with(o.execution, 'exception'))
SELECT count(*) AS n_failed, count(*) FILTER (nt IS NOT NULL) AS n_still_failing, count(*) FILTER (oc[1] = 'parse exception due to limit') AS n_limit_before,
 count(*) FILTER (nc[1] = 'parse exception due to limit') AS n_limit_after, count(*) FILTER (oc[1] = 'parse exception due to limit' AND nt IS NULL) AS n_limit_fixed,
 count(*) FILTER (oc[1] = 'parse exception due to limit' AND ot = nt) AS n_limit_same_type,
 count(*) FILTER (oc[1] = 'parse exception due to limit' AND ot <> nt) AS n_limit_other_type,
 count(*) FILTER (ot = nt) AS n_same_type, count(*) FILTER (ot = nt AND oc = nc) AS n_same_class FROM r""",
    ["executions"],
)
def reexecution_compare(spark, sf):
    return ops.reexecution_compare(executions(spark, sf), again(spark, sf))


@query(f"WITH {AGAIN_SQL} SELECT e.row_id, coalesce(a.execution, e.execution) AS execution FROM executions e LEFT JOIN again a USING (row_id)", ["executions"])
def merge_reexecuted(spark, sf):
    return ops.merge_reexecuted(executions(spark, sf).select("row_id", "execution"), again(spark, sf))


@query(
    """SELECT can_limit, CASE WHEN NOT can_limit THEN has_count END AS has_count, count(*) AS n FROM (
 SELECT contains(query, 'COUNT(') AS has_count, NOT contains(query, 'COUNT(') AND NOT contains(query, 'LIMIT 5') AS can_limit
 FROM queries JOIN executions USING (row_id) WHERE execution = 'timeout') GROUP BY ALL""",
    ["queries", "executions"],
)
def timeout_limit_study(spark, sf):
    return ops.timeout_limit_study(queries(spark, sf), executions(spark, sf))


@query(
    f"""WITH c AS (SELECT CASE WHEN row_id % 3 = 0 THEN 'original' ELSE 'final' END AS dataset, {TYPE.format(e='execution')} AS t FROM executions WHERE {STATUS} = 'fail')
SELECT dataset, 'Client-side' AS side, count(*) FILTER (t = '400') AS n FROM c GROUP BY 1 UNION ALL
SELECT dataset, 'Server-side', count(*) FILTER (t = '500') FROM c GROUP BY 1""",
    ["executions"],
)
def error_side_counts(spark, sf):
    return ops.error_side_counts(executions(spark, sf), dataset(F.col("row_id")))


@query(
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fp,
 count(*) FILTER (quality <> 1 AND toxic = 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn, count(*) AS total FROM labels)
SELECT tp, fp, fn, tn, round((tp + tn) / total::DOUBLE, 9) AS accuracy, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall,
 round(2e0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c"""
)
def binary_classifier_report(spark, sf):
    df = ops.binary_classifier_report(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return rounded(df, "accuracy", "precision", "recall", "f1")
