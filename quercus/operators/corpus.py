"""Corpus cleaning: duplicates, missing values, lengths, outliers, row ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quercus.operators.ordering import as_scalar, global_position, quantiles_by, value_frequencies


def drop_failed_generation(df: DataFrame) -> DataFrame:
    if "has_error" not in df.columns:
        return df
    return df.filter(~F.coalesce(F.col("has_error"), F.lit(False)))


def row_digest(columns: list[str]) -> list[Column]:
    """128 bits that stand for the columns, nulls told apart from values; whole texts need not travel as keys."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"_d{seed}") for seed in (1, 2)]


def dedup_keep_first(df: DataFrame, key: str = "row_id", renumber: str | None = None) -> DataFrame:
    """Later identical rows dropped; the key is unique. The smallest key per distinct row is found by
    partial aggregation over digests, so a row copied a billion times costs one row per input
    partition, and a text moves once at most, with its own key."""
    columns = [c for c in df.columns if c != key]
    first = df.select(key, *row_digest(columns)).groupBy("_d1", "_d2").agg(F.min(key).alias(key))
    kept = df.join(first.select(key), key, "left_semi").select(*df.columns)
    return kept if renumber is None else global_position(kept, [key], renumber)


def duplicate_ratio(df: DataFrame, key: str = "row_id") -> DataFrame:
    columns = [c for c in df.columns if c != key]
    copies = df.select(*row_digest(columns)).groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates")).select(
        "n_rows", "n_duplicates", (F.col("n_duplicates") / F.col("n_rows")).alias("ratio")
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Nulls per column and empty texts per text column, one row per column."""
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    counts = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(c).isNull()).alias("n_null"),
                (F.count_if(F.col(c) == "") if c in texts else F.lit(0).cast("bigint")).alias("n_empty"),
            ).alias(c)
            for c in df.columns
        ]
    )
    return counts.select(F.inline(F.array(*[F.col(c) for c in df.columns])))


def describe_lengths(df: DataFrame, text: str, only_filled: bool = False) -> DataFrame:
    lengths = df.select(F.length(text).alias("len"))
    if only_filled:
        lengths = lengths.filter(F.col("len") > 0)
    # at most as many distinct lengths as the longest text has characters, so no hot-group question
    counts = value_frequencies(lengths, [], "len")
    quarts = quantiles_by(counts, [], "len", {"q1": 0.25, "median": 0.5, "q3": 0.75}, hot_rows=None)
    stats = lengths.agg(
        F.count("len").alias("n"), F.avg("len").alias("mean"), F.stddev_samp("len").alias("std"),
        F.min("len").alias("min"), F.max("len").alias("max"),
    )
    return stats.withColumn("_q", as_scalar(quarts)).select(*stats.columns, "_q.q1", "_q.median", "_q.q3")


def describe_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct, most frequent value (ties: the smallest) and its frequency, per column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    marked = long.filter(F.col("value").isNotNull()).withColumn("_digest", F.md5("value"))
    # the texts themselves stay where they are: digests are counted, and only texts of the leading ones are compared
    freq = marked.groupBy("column", "_digest").agg(F.count(F.lit(1)).alias("n"))
    totals = freq.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq")
    )
    leading = freq.join(totals.select(F.col("column").alias("_c"), "freq"), (F.col("column") == F.col("_c")) & (F.col("n") == F.col("freq")))
    leading = leading.select(F.col("column").alias("_c"), F.col("_digest").alias("_d"))
    winners = marked.join(leading, (F.col("column") == F.col("_c")) & (F.col("_digest") == F.col("_d")), "left_semi")
    top = winners.groupBy("column").agg(F.min("value").alias("top"))
    return totals.join(top, "column").select("column", "count", "unique", "top", "freq")


def length_fences(df: DataFrame, text: str, only_filled: bool = False, threshold: float = 1.5) -> DataFrame:
    lengths = df.select(F.length(text).alias("len"))
    if only_filled:
        lengths = lengths.filter(F.col("len") > 0)
    q = quantiles_by(value_frequencies(lengths, [], "len"), [], "len", {"q1": 0.25, "q3": 0.75}, hot_rows=None)
    reach = (F.col("q3") - F.col("q1")) * threshold
    return q.select((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def iqr_outliers(df: DataFrame, text: str, only_filled: bool = False, threshold: float = 1.5) -> DataFrame:
    """Rows whose text length lies outside the fences, which are a scalar subquery."""
    fences = as_scalar(length_fences(df, text, only_filled, threshold))
    size = F.length(text)
    outside = (size < fences["low"]) | (size > fences["high"])
    if only_filled:
        outside = outside & (size > 0)
    return df.filter(outside)


def rows_range(df: DataFrame, start: int, count: int = 0, key: str = "row_id") -> DataFrame:
    """Rows whose number, the ``key``, is in [start, start + count); a count of zero or less means to the end.

    Rows keep their number through cleaning; ``global_position`` numbers what is left anew.
    """
    if start < 0:
        raise ValueError("start must be positive or zero")
    kept = df.filter(F.col(key) >= start)
    return kept if count <= 0 else kept.filter(F.col(key) < start + count)


def rows_targeted(df: DataFrame, targets: DataFrame, key: str = "row_id", order: str = "ord") -> DataFrame:
    """Rows at the listed positions, with the list's order number; a position may be listed twice."""
    return targets.select(order, key).join(df, key)


def rows_skipped(df: DataFrame, flag: str = "is_skipped") -> DataFrame:
    return df.filter(F.col(flag))


def value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return (
        df.select(value.alias(name)).filter(F.col(name).isNotNull()).groupBy(name)
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)
    )


def sort_by_length(df: DataFrame, text: str, key: str = "row_id") -> DataFrame:
    return df.withColumn("len", F.length(text)).orderBy("len", key)


def top_k_longest(df: DataFrame, text: str, k: int, key: str = "row_id") -> DataFrame:
    return df.withColumn("len", F.length(text)).orderBy(F.desc("len"), key).limit(k)


def rows_except(df: DataFrame, handled: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(handled.select(key), key, "left_anti")


def overwrite_from(df: DataFrame, newer: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """Take ``columns`` from ``newer`` wherever it has the key, even if the new value is null."""
    fresh = newer.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    joined = df.join(fresh, F.col(key) == F.col("_key"), "left")
    return joined.select(
        *[
            F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )
