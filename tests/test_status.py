import pytest
from pyspark.sql import functions as F

from quercus.functions import status as st
from quercus.operators import executions as ops

C = F.col


@pytest.mark.parametrize(
    "text, status",
    [("timeout", "timeout"), ("timeout x", "to_eval"), ("exception: a", "fail"), ("[]", "empty"), ("[{'a': 1}]", "to_eval"), (None, "missing"), ("", "to_eval")],
)
def test_status(one, text, status):
    assert one(st.execution_status(C("e")), e=text) == status


CAUSE = "exception: 400 Client Error\nCaused by: a.MalformedQueryException: undefined prefix\nCaused by: "


@pytest.mark.parametrize(
    "text, kind, classes",
    [
        (CAUSE + "ast.ParseException: no limit here", "400", ["parse exception due to limit"]),
        (CAUSE + "ast.ParseException: undefined prefix", "400", ["undefined prefix", "parse exception"]),
        (CAUSE + "Lexical error\nat x", "400", ["lexical error"]),
        (CAUSE + "Non-aggregate variable in select expression", "400", ["non-aggregate variable in select expression"]),
        (CAUSE + "Multiple prefix declarations for prefix 'a'", "400", ["Prefix duplicates"]),
        ("exception: 400 no cause", "400", []),
        ("exception: 500 Server Error: the response has an Invalid chunk length: x", "500", ["Invalid JSON"]),
        ("exception: 500 e\nCaused by: MemoryManagerOutOfMemory", "500", ["Out of memory"]),
        ("exception: 500 e\nCaused by: The estimated execution time 9", "500", ["estimated time to execute too long"]),
        ("exception: 500 e\nCaused by: java.lang.NullPointerException", "500", ["NullPointerException"]),
        ("exception: module 'requests.exceptions' has no attribute 'JSONDecodeError'", "requests", ["no attribute 'JSONDecodeError'"]),
        ("exception: body java.util.concurrent.TimeoutException", "server timeout", ["server timeout"]),
        ("exception: query is empty", "empty query", ["empty query"]),
        ("exception: other", None, None), (None, None, None), ("exception:        12", None, None),
    ],
)
def test_taxonomy(one, text, kind, classes):
    assert one(st.error_type(C("e")), e=text) == kind
    assert one(st.error_classes(C("e")), e=text) == classes


def test_type_windows(one):
    far = "exception: " + "x" * 200 + " exception: query is empty"
    assert one(st.error_type(C("e")), e=far) is None
    late = "exception: java.util.concurrent.TimeoutException" + "x" * 10000
    assert one(st.error_type(C("e")), e=late) == "server timeout"  # anywhere in the text
    chunk = "exception: Connection broken: InvalidChunkLength"
    assert one(st.error_type(C("e")), e=chunk) is None
    assert one(st.error_type(C("e"), invalid_json=True), e=chunk) == "invalid JSON"
    assert one(st.error_classes(C("e")), e=chunk) == ["Invalid JSON"]


def test_index(one):
    assert one(st.error_index(C("c")), c=["Prefix duplicates", "lexical error"]) == 5
    assert one(st.error_index(C("c")), c=[]) is None


@pytest.mark.parametrize(
    "query, code, body, failure, message, expected",
    [
        (" ", 200, "b", None, "m", "exception: query is empty"),
        ("q", 200, "b", None, "m", "b"),
        ("q", 429, "b", None, "m", "exception: too many retry-after"),
        ("q", 400, "b", None, "m", "exception: m\nb"),
        ("q", 500, "x java.util.concurrent.TimeoutException y", None, "m", "timeout"),
        ("q", None, None, "timeout", "m", "timeout"),
        ("q", None, None, "chunk", "m", "exception: 500 Server Error: the response has an Invalid chunk length: m"),
        ("q", None, None, "other", "m", "exception: m"),
    ],
)
def test_normalise_response(spark, query, code, body, failure, message, expected):
    df = spark.createDataFrame([(query, code, body, failure, message)], "q string, c int, b string, f string, m string")
    assert df.select(st.normalise_response(C("q"), C("c"), C("b"), C("f"), C("m")).alias("x")).first().x == expected


def test_counts_keep_empty_statuses(spark):
    df = spark.createDataFrame([("timeout",), ("timeout",), ("[]",), (None,)], "execution string")
    got = {r.status: (r.n, r.share) for r in ops.status_counts(df).collect()}
    assert got == {"timeout": (2, 50.0), "fail": (0, 0.0), "empty": (1, 25.0), "to_eval": (0, 0.0), "missing": (1, 25.0)}


def test_failed_generation_is_dropped_before_the_statuses(spark):
    rows = [(False, "[{}]"), (True, "exception: query is empty"), (False, "exception: x"), (False, "timeout"), (None, "[]")]
    df = spark.createDataFrame(rows, "has_error boolean, execution string")
    assert sorted(r.status for r in ops.with_status(df).collect()) == ["empty", "fail", "timeout", "to_eval"]
    assert ops.with_status(df.drop("has_error")).count() == 5


def test_generated_index_takes_the_later_list(spark):
    rows = [(CAUSE + "Lexical error",), (CAUSE + "undefined prefix",), (CAUSE + "undefined prefix ast.ParseException",)]
    got = {r.error_class: r.idx for r in ops.generated_error_index(spark.createDataFrame(rows, "execution string")).collect()}
    assert got == {"lexical error": 0, "undefined prefix": 2}
