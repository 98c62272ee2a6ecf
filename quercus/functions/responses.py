"""Semi-structured responses: stored text -> bindings -> typed values."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quercus.fixed_values import ENTITY_IRI_START, XSD_INTEGER

BINDINGS = "array<map<string,map<string,string>>>"
#: Key of the element that is put behind a response to see that it ended.
END_MARK = "~end of the response~"


@F.pandas_udf(T.StringType())
def literal_to_json(texts: pd.Series) -> pd.Series:
    """Python literal text as JSON text; null where it is not a literal."""

    def convert(text):
        if text is None:
            return None
        try:
            return json.dumps(ast.literal_eval(text))
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None

    return texts.map(convert)


def parse_execution(execution: Column) -> Column:
    """Stored response -> bindings; null if it cannot be read.

    The JSON reader takes single quotes. It stops at the end of the first value, so the text is read as the first of
    two elements, the second being a mark that no response holds: a tail, be it a value, a field or a bracket, makes
    the array unreadable, longer, or hides the mark. What it cannot read although it starts like a list (escapes such
    as \\xa0, None, a tail) goes to the Python literal reader, which refuses a tail; all other rows send it null.
    """
    whole = F.from_json(
        F.concat(F.lit("["), execution, F.lit(',[{"' + END_MARK + '":{}}]]')), f"array<{BINDINGS}>", {"allowSingleQuotes": "true"}
    )
    marked = F.coalesce(F.map_contains_key(F.get(F.get(whole, 1), 0), F.lit(END_MARK)), F.lit(False))
    direct = F.when((F.size(whole) == 2) & marked, F.get(whole, 0))
    hard = direct.isNull() & F.startswith(execution, F.lit("["))
    return F.coalesce(direct, F.from_json(literal_to_json(F.when(hard, execution)), BINDINGS))


def nested_values(bindings: Column) -> Column:
    """Every text under a key that contains ``value``, in order; null gives an empty list."""
    per_row = F.transform(
        bindings,
        lambda row: F.flatten(
            F.transform(
                F.map_values(row),
                lambda cell: F.map_values(F.map_filter(cell, lambda k, v: F.contains(k, F.lit("value")) & v.isNotNull())),
            )
        ),
    )
    return F.coalesce(F.flatten(per_row), F.array().cast("array<string>"))


def _walk(node, found):
    if isinstance(node, dict):
        for key, child in node.items():
            if isinstance(child, dict):
                _walk(child, found)
            elif isinstance(child, str) and "value" in key:
                found.append(child)
    elif isinstance(node, list):
        for child in node:
            _walk(child, found)
    elif node is not None:
        raise TypeError(f"expected an object or a list, found {type(node).__name__}")
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_values_any_depth(texts: pd.Series) -> pd.Series:
    """The same for JSON text of any depth."""
    return texts.map(lambda text: _walk(json.loads(text) if text is not None else None, []))


def response_columns(bindings: Column) -> Column:
    """Column names: the keys of the first row only; null for an empty response."""
    return F.map_keys(F.get(bindings, 0))


def cell_value(cell: Column) -> Column:
    """Text of a cell; an integer literal, however long, is written in its canonical form, and one
    that is no integer keeps its text."""
    value = F.try_element_at(cell, F.lit("value"))
    is_integer = (F.try_element_at(cell, F.lit("type")) == "literal") & (
        F.try_element_at(cell, F.lit("datatype")) == XSD_INTEGER
    )
    digits = F.regexp_extract(value, r"\A\s*[+-]?0*([0-9]+)\s*\z", 1)
    negative = value.rlike(r"\A\s*-") & (digits != "0")
    canonical = F.when(digits != "", F.concat(F.when(negative, F.lit("-")).otherwise(""), digits)).otherwise(value)
    return F.when(is_integer, canonical).otherwise(value)


def cell_kind(cell: Column) -> Column:
    kind = F.try_element_at(cell, F.lit("type"))
    is_integer = (kind == "literal") & (F.try_element_at(cell, F.lit("datatype")) == XSD_INTEGER)
    return F.when(is_integer, F.lit("integer")).otherwise(kind)


def is_entity_iri(value: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(value), F.lit(ENTITY_IRI_START)), F.lit(False))
