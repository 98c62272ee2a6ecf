"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quercus.session import settle

#: Rows per Arrow batch: documents of a hundred kilobytes still make batches of some hundred megabytes at most.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than the default, since a row here is a whole document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``_row``, so that none can clash with a column that an operator adds."""
    return F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("_row")


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows, chosen by a hash of the key; all rows if there are no more.

    The share is worked out from the row count, so the choice depends on the data alone.
    """
    total = df.count()
    if total <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * most / total))




__all__ = ["ARROW_ROWS", "bounded_batches", "bounded_sample", "crc_mod", "settle", "whole_row"]
