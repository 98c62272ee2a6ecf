"""Execution-log analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quercus.fixed_values import STATUSES
from quercus.functions.status import error_classes, error_type, execution_status, needs_rerun
from quercus.functions.text import can_add_limit, has_count_call
from quercus.operators.corpus import drop_failed_generation

SIDES = {"400": "Client-side", "500": "Server-side"}


def with_status(df: DataFrame, execution: str = "execution") -> DataFrame:
    return drop_failed_generation(df).withColumn("status", execution_status(F.col(execution)))


def keep_working(df: DataFrame, execution: str = "execution") -> DataFrame:
    return df.filter(execution_status(F.col(execution)) == "to_eval")


def select_errors(df: DataFrame, execution: str = "execution") -> DataFrame:
    return df.filter(needs_rerun(F.col(execution)))


def status_counts(df: DataFrame, execution: str = "execution") -> DataFrame:
    """Rows per status, zero rows kept, and their share of all rows in percent."""
    found = df.groupBy(execution_status(F.col(execution)).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = every.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return share_of_total(counted, "n")


def status_counts_by(df: DataFrame, dataset: Column, execution: str = "execution") -> DataFrame:
    """The same in long form for several data sets; one pass, one row per (data set, status)."""
    flags = [F.count_if(execution_status(F.col(execution)) == s).alias(s) for s in STATUSES]
    wide = df.groupBy(dataset.alias("dataset")).agg(*flags)
    return wide.unpivot(["dataset"], STATUSES, "status", "n")


def share_of_total(counts: DataFrame, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Percentage of the (small) table of counts, over all of it or per ``by``."""
    whole = F.sum(n).over(Window.partitionBy(*(by or [F.lit(1)])))
    return counts.withColumn("share", F.when(whole > 0, F.col(n) * 100.0 / whole).otherwise(0.0))


def error_class_examples(df: DataFrame, key: str = "row_id", execution: str = "execution") -> DataFrame:
    """Per error type (null too): how many, and the first row's text cut to 256 characters."""
    failed = df.filter(execution_status(F.col(execution)) == "fail")
    return failed.groupBy(error_type(F.col(execution)).alias("error_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.substring(execution, 1, 256), F.col(key)).alias("example"),
    )


def exception_timeout_counts(df: DataFrame, execution: str = "execution") -> DataFrame:
    e = F.col(execution)
    return df.agg(
        F.count_if(F.startswith(e, F.lit("exception:"))).alias("exception_count"),
        F.count_if(F.startswith(e, F.lit("timeout"))).alias("timeout_count"),
    )


def null_out_failures(df: DataFrame, execution: str = "execution") -> DataFrame:
    e = F.col(execution)
    failed = F.startswith(e, F.lit("exception:")) | F.startswith(e, F.lit("timeout"))
    return df.withColumn(execution, F.when(~failed, e))


def correct_syntax(df: DataFrame, execution: str = "execution") -> DataFrame:
    """Share of rows that still have an execution; an empty list counts as correct."""
    return null_out_failures(df, execution).agg(F.avg(F.col(execution).isNotNull().cast("int")).alias("correct_syntax"))


def reexecution_rows(df: DataFrame, again: DataFrame, key: str = "row_id") -> DataFrame:
    """Failed rows beside their second execution, with types and classes of both."""
    before = df.filter(execution_status(F.col("execution")) == "fail").select(
        key, error_type(F.col("execution")).alias("old_type"), error_classes(F.col("execution")).alias("old_classes")
    )
    after = again.select(
        key, error_type(F.col("execution")).alias("new_type"), error_classes(F.col("execution")).alias("new_classes")
    )
    return before.join(after, key)


def reexecution_compare(df: DataFrame, again: DataFrame, key: str = "row_id") -> DataFrame:
    """What a second execution of the failed rows changed, as one row of counts."""
    rows = reexecution_rows(df, again, key)
    old, new = F.col("old_type"), F.col("new_type")
    limit = F.get("old_classes", 0) == "parse exception due to limit"
    new_limit = F.get("new_classes", 0) == "parse exception due to limit"
    still = new.isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n_failed"),
        F.count_if(still).alias("n_still_failing"),
        F.count_if(limit).alias("n_limit_before"),
        F.count_if(new_limit).alias("n_limit_after"),
        F.count_if(limit & new.isNull()).alias("n_limit_fixed"),
        F.count_if(limit & (old == new)).alias("n_limit_same_type"),
        F.count_if(limit & still & (old != new)).alias("n_limit_other_type"),
        F.count_if(still & (old == new)).alias("n_same_type"),
        F.count_if(still & (old == new) & (F.col("old_classes") == F.col("new_classes"))).alias("n_same_class"),
    )


def merge_reexecuted(df: DataFrame, again: DataFrame, key: str = "row_id") -> DataFrame:
    """New executions written over the error rows only."""
    fresh = again.select(F.col(key).alias("_key"), F.col("execution").alias("_new"))
    joined = df.join(fresh, F.col(key) == F.col("_key"), "left")
    use = needs_rerun(F.col("execution")) & F.col("_key").isNotNull()
    return joined.withColumn("execution", F.when(use, F.col("_new")).otherwise(F.col("execution"))).select(*df.columns)


def timeout_limit_study(queries: DataFrame, executions: DataFrame, key: str = "row_id") -> DataFrame:
    """Timeouts by: can a LIMIT be added, and if not, does the query count."""
    timeouts = executions.filter(F.col("execution") == "timeout").select(key)
    can = can_add_limit(F.col("query"))
    rows = queries.join(timeouts, key).select(
        can.alias("can_limit"), F.when(~can, has_count_call(F.col("query"))).alias("has_count")
    )
    return rows.groupBy("can_limit", "has_count").agg(F.count(F.lit(1)).alias("n"))


def error_side_counts(df: DataFrame, dataset: Column, execution: str = "execution") -> DataFrame:
    kind = error_type(F.col(execution))
    counted = (
        df.filter(execution_status(F.col(execution)) == "fail")
        .groupBy(dataset.alias("dataset")).agg(*[F.count_if(kind == code).alias(side) for code, side in SIDES.items()])
    )
    return counted.unpivot(["dataset"], list(SIDES.values()), "side", "n")


def generated_error_index(df: DataFrame, execution: str = "execution") -> DataFrame:
    """First class -> number, from the sorted class lists that occur; a later list wins.

    The table of distinct class lists is as small as the taxonomy, so one window may order it.
    """
    lists = (
        df.filter(execution_status(F.col(execution)) == "fail")
        .select(error_classes(F.col(execution)).alias("classes"))
        .filter(F.size("classes") > 0).distinct()
    )
    placed = lists.withColumn("place", F.row_number().over(Window.orderBy("classes")) - 1)
    return placed.groupBy(F.get("classes", 0).alias("error_class")).agg(F.max("place").cast("bigint").alias("idx"))


def binary_classifier_report(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    counts = df.agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"),
        F.count(F.lit(1)).alias("total"),
    )

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = counts.select(
        "tp", "fp", "fn", "tn", ratio(tp + tn, F.col("total")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", ratio(2 * p * r, p + r))
