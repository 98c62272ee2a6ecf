"""User steps run in order over a table; the first failure of a row stops that row only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from quercus.fixed_values import NO_MATCH_STATUS
from quercus.functions.text import fill_placeholders, query_in_answer
from quercus.operators.labels import link_placeholders, with_placeholders


@dataclass(frozen=True)
class Step:
    """``run`` adds the output columns, and a text column ``error`` that is null where all is well.

    ``on_error`` gives an output's value in the failing row; without it the value is null.
    """

    name: str
    run: Callable[[DataFrame], DataFrame]
    outputs: list[str]
    on_error: dict[str, Column] = field(default_factory=dict)


def run_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    """The four bookkeeping columns are status, has_error, last_executed_step, to_be_executed_step."""
    for step in steps:
        if not isinstance(step, Step):
            raise TypeError("a step must be a Step")
    out = df.withColumns({"status": F.lit(""), "has_error": F.lit(False), "last_executed_step": F.lit("")})
    for step in steps:
        out = step.run(out)
        error = F.col("error") if "error" in out.columns else F.lit(None).cast("string")
        was_ok = ~F.col("has_error")
        ok = was_ok & error.isNull()
        guarded = {
            c: F.when(ok, F.col(c)).otherwise(F.when(was_ok, step.on_error[c]) if c in step.on_error else F.lit(None))
            for c in step.outputs
        }
        out = out.withColumns(
            {
                **guarded,
                "status": F.when(was_ok & error.isNotNull(), error).otherwise(F.col("status")),
                "last_executed_step": F.when(ok, F.lit(step.name)).otherwise(F.col("last_executed_step")),
                "has_error": ~ok,
            }
        ).drop("error")
    after = F.lit("")
    for before, step in zip([""] + [s.name for s in steps], steps):
        after = F.when(F.col("has_error") & (F.col("last_executed_step") == before), F.lit(step.name)).otherwise(after)
    return out.withColumn("to_be_executed_step", after)


def translate_step(answer: str, start: str = "[query]", end: str = "[/query]") -> Step:
    def run(df):
        query = query_in_answer(F.col(answer), start, end)
        stored = F.concat(F.lit(NO_MATCH_STATUS + ": err.sparql='"), F.col(answer), F.lit("'"))
        return df.withColumn("translated_prompt", query).withColumn(
            "error", F.when(F.col("translated_prompt").isNull(), stored)
        )

    return Step("translate", run, ["translated_prompt"], {"translated_prompt": F.lit("")})


def extract_step() -> Step:
    return Step("extract", lambda df: with_placeholders(df, "translated_prompt"), ["extracted_entities", "extracted_properties"])


def link_step(dictionary: DataFrame, key: str = "row_id") -> Step:
    return Step("link", lambda df: link_placeholders(df, dictionary, key), ["linked_entities", "linked_properties"])


def fill_step(out: str = "output") -> Step:
    def run(df):
        return df.withColumn(
            out, fill_placeholders(F.col("translated_prompt"), F.col("linked_entities"), F.col("linked_properties"))
        )

    return Step("fill", run, [out])


def template_steps(answer: str, dictionary: DataFrame, key: str = "row_id") -> list[Step]:
    """Answer with labels -> query with ids."""
    return [translate_step(answer), extract_step(), link_step(dictionary, key), fill_step()]


def row_step(
    name: str, function: Callable[[dict], dict], schema: str, columns: list[str], on_error: dict[str, Column] | None = None
) -> Step:
    """A caller's Python function as a step: what it raises becomes the status of its row and stops that row only.

    ``function`` takes the named columns of a row as a dict and returns a dict with the fields of ``schema``; a missing
    field is null, and a value that doesn't fit its field counts as raised. Rows that failed before don't reach it.
    """
    fields = T.StructType.fromDDL(schema).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def attempt(row: dict) -> tuple[list, str | None]:
        if row["_skip"]:
            return [None] * len(fields), None
        try:
            made = function({c: row[c] for c in columns})
            # one by one, so that a value of another kind is found in its own row
            return [pa.scalar(made.get(f.name), kind).as_py() for f, kind in zip(fields, kinds)], None
        except Exception as err:
            return [None] * len(fields), f"Unexpected {err=}, {type(err)=}"

    def run(df: DataFrame) -> DataFrame:
        @F.arrow_udf(T.StructType([*fields, T.StructField("error", T.StringType())]))
        def call(rows: pa.Array) -> pa.Array:
            tried = [attempt(row) for row in rows.to_pylist()]
            made = [pa.array([values[i] for values, _ in tried], kind) for i, kind in enumerate(kinds)]
            errors = pa.array([error for _, error in tried], pa.string())
            return pa.StructArray.from_arrays([*made, errors], names=[*[f.name for f in fields], "error"])

        given = F.struct(F.col("has_error").alias("_skip"), *[F.col(c) for c in columns])
        called = df.withColumn("_made", call.asNondeterministic()(given))
        outputs = {f.name: F.col("_made")[f.name] for f in fields}
        return called.withColumns({**outputs, "error": F.col("_made")["error"]}).drop("_made")

    return Step(name, run, [f.name for f in fields], on_error or {})


def ensure_output_column(df: DataFrame, name: str = "output", kind: str = "string") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def apply_rows(
    df: DataFrame, function: Callable[[dict], dict], schema: str, columns: list[str], key: str = "row_id"
) -> DataFrame:
    """A caller's Python function over every row, its results beside the key.

    ``function`` takes the named columns of a row as a dict and returns a dict with the fields of
    ``schema``. Only the key and these columns reach Python, in Arrow batches, where the rows are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([function(row) for row in batch[columns].to_dict("records")], index=batch.index)
            made.insert(0, key, batch[key])
            if len(batch):
                yield made

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"`{key}` {kind}, {schema}")
