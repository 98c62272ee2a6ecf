"""Column reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fine-tuning column -> corpus column.
FINETUNE_COLUMNS = {
    "basic_input": "basic_result",
    "templated_input": "templated_result",
    "target_raw": "query",
    "target_template": "query_templated",
    "gold_execution": "execution",
    "gold_executed_query": "executed_query",
}


def flatten_struct(df: DataFrame, column: str) -> DataFrame:
    """A struct column replaced by its fields."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def flatten_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column replaced by the fields of ``schema``."""
    return flatten_struct(df.withColumn(column, F.from_json(column, schema)), column)


def finetune_projection(df: DataFrame, key: str = "row_id") -> DataFrame:
    return df.select(key, *[F.col(old).alias(new) for new, old in FINETUNE_COLUMNS.items()])


def first_of_list(df: DataFrame, column: str) -> DataFrame:
    """First element of a list column (null for an empty list); a scalar column stays."""
    if df.schema[column].dataType.typeName() != "array":
        return df
    return df.withColumn(column, F.get(F.col(column), 0))
