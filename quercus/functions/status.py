"""Execution statuses and the error taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quercus.fixed_values import (
    EMPTY_QUERY_TEXT,
    ERROR_INDEX,
    INVALID_CHUNK_TEXT,
    TOO_MANY_RETRIES_TEXT,
)
from quercus.functions.text import is_blank, let


def execution_status(execution: Column) -> Column:
    return (
        F.when(execution.isNull(), F.lit("missing"))
        .when(execution == "timeout", F.lit("timeout"))
        .when(F.startswith(execution, F.lit("exception")), F.lit("fail"))
        .when(F.startswith(execution, F.lit("[]")), F.lit("empty"))
        .otherwise(F.lit("to_eval"))
    )


def execution_status_by_length(execution: Column) -> Column:
    """The variant that calls only zero-length text empty."""
    return (
        F.when(execution.isNull(), F.lit("missing"))
        .when(execution == "timeout", F.lit("timeout"))
        .when(F.startswith(execution, F.lit("exception")), F.lit("fail"))
        .when(F.length(execution) == 0, F.lit("empty"))
        .otherwise(F.lit("to_eval"))
    )


def needs_rerun(execution: Column) -> Column:
    return F.coalesce(execution.rlike(r"\A(?:exception|timeout)"), F.lit(False))


def execution_looks_correct(execution: Column) -> Column:
    return F.coalesce(execution.rlike(r"\A(?:\[\{'|\[\]|\{)"), F.lit(False))


def error_type(execution: Column, invalid_json: bool = False) -> Column:
    """HTTP code or kind of the failure.

    The code, the kinds of client failure and the empty query are told by how the text starts, so a
    trace that quotes one of them later is not mistaken; a server timeout may stand anywhere in it.
    """
    code = F.regexp_extract(F.substring(execution, 1, 20), "exception: ([0-9]+)", 1)
    chain = F.when(code != "", code).when(
        F.contains(F.substring(execution, 1, 50), F.lit("exception: module 'requests.exceptions'")), F.lit("requests")
    )
    if invalid_json:
        chain = chain.when(
            F.contains(F.substring(execution, 1, 100), F.lit("Connection broken: InvalidChunkLength")),
            F.lit("invalid JSON"),
        )
    return chain.when(
        execution.rlike("java.util.concurrent.TimeoutException"), F.lit("server timeout")
    ).when(F.contains(F.substring(execution, 1, 100), F.lit(EMPTY_QUERY_TEXT)), F.lit("empty query"))


def last_cause(execution: Column) -> Column:
    return F.coalesce(
        F.try_element_at(F.regexp_extract_all(execution, F.lit(r"(?d)Caused by: .+"), 0), F.lit(-1)), F.lit("")
    )


def error_classes(execution: Column, kind: Column | None = None) -> Column:
    """Classes of a failure as an array; null where no error type is known."""
    kind = error_type(execution, invalid_json=True) if kind is None else kind

    def found(*tests):
        return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in tests]))

    def client(cause):
        parse = cause.rlike("ast.ParseException")
        limit = cause.rlike("limit|LIMIT")
        aggregate = "non-aggregate variable in select expression"
        return found(
            (F.contains(cause, F.lit("undefined prefix")), "undefined prefix"),
            (parse & limit, "parse exception due to limit"),
            (parse & ~limit, "parse exception"),
            (F.contains(cause, F.lit("Lexical error")), "lexical error"),
            (F.contains(cause, F.lit("Non-aggregate variable in select expression")), aggregate),
            (F.contains(cause, F.lit("Multiple prefix declarations for prefix")), "Prefix duplicates"),
        )

    def server(cause):
        point = "GeoSpatialSearchException: input could not be resolved as point"
        return found(
            (F.contains(cause, F.lit("StackOverflowError")), "stack overflow"),
            (F.contains(cause, F.lit("Input could not be resolved as point")), point),
            (F.contains(cause, F.lit("The estimated execution time")), "estimated time to execute too long"),
            (F.contains(cause, F.lit("MemoryManagerOutOfMemory")), "Out of memory"),
            (cause.rlike("java.lang.NullPointerException"), "NullPointerException"),
            (F.contains(execution, F.lit(INVALID_CHUNK_TEXT[:-2])), "Invalid JSON"),
        )

    json_missing = F.contains(
        F.substring(execution, 1, 100),
        F.lit("exception: module 'requests.exceptions' has no attribute 'JSONDecodeError'"),
    )

    def by_kind(k):
        return (
            F.when(k == "400", let(last_cause(execution), client))
            .when(k == "500", let(last_cause(execution), server))
            .when(k == "requests", found((json_missing, "no attribute 'JSONDecodeError'")))
            .when(k == "invalid JSON", F.array(F.lit("Invalid JSON")))
            .when(k.isin("server timeout", "empty query"), F.array(k))
        )

    return let(kind, by_kind)


def error_index(classes: Column) -> Column:
    """Number of the first class, from the fixed table."""
    first = F.get(classes, 0)
    numbers = F.create_map(*[F.lit(x) for pair in ERROR_INDEX.items() for x in pair])
    return F.try_element_at(numbers, first)


def normalise_response(query: Column, status_code: Column, body: Column, failure: Column, message: Column) -> Column:
    """The one ``execution`` text for a raw response.

    ``failure`` is null, ``timeout``, ``chunk`` or ``other``; ``message`` is the client's own text.
    """
    http_error = status_code >= 400
    return (
        F.when(is_blank(query), F.lit(EMPTY_QUERY_TEXT))
        .when(failure == "timeout", F.lit("timeout"))
        .when(failure == "chunk", F.concat(F.lit(INVALID_CHUNK_TEXT), message))
        .when(failure == "other", F.concat(F.lit("exception: "), message))
        .when(status_code == 429, F.lit(TOO_MANY_RETRIES_TEXT))
        .when(http_error & F.contains(body, F.lit("java.util.concurrent.TimeoutException")), F.lit("timeout"))
        .when(http_error, F.concat(F.lit("exception: "), message, F.lit("\n"), body))
        .otherwise(body)
    )
