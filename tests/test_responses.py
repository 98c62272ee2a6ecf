import json

import pytest
from pyspark.sql import functions as F

from quercus.functions import responses as rs
from quercus.operators import answers as ops

C = F.col
INT = "http://www.w3.org/2001/XMLSchema#integer"


@pytest.mark.parametrize(
    "text",
    [
        "[{'a': {'type': 'uri', 'value': 'x'}}]",
        '[{"a": {"type": "uri", "value": "it\'s"}}]',
        "[{'a': {'type': 'literal', 'value': \"it's\"}},\n {'b': {'type': 'literal', 'value': 'l\\nm'}}]",
        "[{'a': {'type': 'literal', 'value': 'caf\\xe9'}}]",
        "[{'a': {'type': 'literal', 'value': None}}]",
    ],
)
def test_stored_literals(one, text):
    import ast

    assert one(rs.parse_execution(C("e")), e=text) == ast.literal_eval(text)


@pytest.mark.parametrize(
    "text",
    [
        "[{'a': ", "nonsense", None, "[], 'x': 3", "[{'a': {'value': 'x'}}], 'tail': 5", "[] []", "[]]", "[],[]],[",
        "[], 'r': []", "[{'a': {'value': 'x'}}] tail", '[{"a": {"value": "x"}}], "_end": 1', "{}", "[{'a': {'value': 'x'}}",
    ],
)
def test_unreadable_is_null(one, text):
    assert one(rs.parse_execution(C("e")), e=text) is None


def test_empty_response(one):
    assert one(rs.parse_execution(C("e")), e="[]") == []
    assert one(rs.response_columns(rs.parse_execution(C("e"))), e="[]") is None


@pytest.mark.parametrize(
    "tree, values",
    [
        ({"c": "no", "value": "1", "child": {"x": "no", "value": "2", "child": {"value": "3"}}}, ["1", "2", "3"]),
        ([{"a": {"b": {"value": "1"}}}, {"value": "2", "k": {"myvalues": "3"}}, {"v": "no"}], ["1", "2", "3"]),
        ({}, []), ([], []), (None, []), ({"value": 5}, []),
    ],
)
def test_nested_values_any_depth(one, tree, values):
    assert one(rs.nested_values_any_depth(C("t")), t=json.dumps(tree)) == values


def test_nested_values_rejects_bare_texts(one):
    with pytest.raises(Exception, match="TypeError"):
        one(rs.nested_values_any_depth(C("t")), t='["a", "b"]')


def test_nested_values_of_bindings(one):
    text = "[{'a': {'type': 'uri', 'value': 'x', 'xvalue': 'z'}, 'b': {'value': 'y'}}, {'a': {'type': 'w'}}]"
    assert one(rs.nested_values(rs.parse_execution(C("e"))), e=text) == ["x", "z", "y"]
    assert one(rs.nested_values(rs.parse_execution(C("e"))), e="bad") == []


def test_cells_take_columns_of_the_first_row(spark):
    text = (
        "[{'n': {'type': 'literal', 'datatype': '" + INT + "', 'value': '007'}, 'u': {'type': 'uri', 'value': 'x'}},"
        " {'u': {'type': 'bnode', 'value': 'y'}, 'later': {'type': 'uri', 'value': 'z'}}]"
    )
    df = spark.createDataFrame([(1, text)], "row_id bigint, e string").select("row_id", rs.parse_execution(C("e")).alias("b"))
    got = {(r.row_no, r.col_pos, r.col, r.kind, r.value) for r in ops.response_cells(df, "b").collect()}
    assert got == {(1, 0, "n", "integer", "7"), (1, 1, "u", "uri", "x"), (2, 0, "n", None, None), (2, 1, "u", "bnode", "y")}


def test_entity_iri(one):
    x = rs.is_entity_iri(C("v"))
    assert [one(x, v=v) for v in ("http://www.wikidata.org/entity/Q1", "HTTP://www.Wikidata.org/x", "Q1", None)] == [True, True, False, False]
