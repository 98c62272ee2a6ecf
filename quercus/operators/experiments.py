"""Experiment tables: run names, recoding, unpivoting, rates, box statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quercus.fixed_values import OPTIMIZER_ALIASES
from quercus.functions.text import template_for_model  # noqa: F401  (re-exported for run tables)
from quercus.operators.ordering import HOT_ROWS, quantiles_by, value_frequencies
from quercus.session import settle

# Patterns of a run name.
RUN_NAME = {"gradient_checkpointing": r"-gc(\d)-", "context_length": r"-ctx(\d+)-", "lora_rvalue": r"_rv(\d+)-"}


def parse_run_name_split(df: DataFrame, name: str, r_at: int, input_at: int, target_at: int) -> DataFrame:
    """Hyper-parameters by place: the part after ``_``, cut at ``-`` (places count from 0)."""
    parts = F.split(F.get(F.split(name, "_"), 1), "-")

    def labeled(at):
        return F.replace(F.get(parts, at), F.lit("template"), F.lit("labeled"))

    df = df.withColumn("rvalue", F.replace(F.get(parts, r_at), F.lit("rv"), F.lit("")))
    df = df.withColumn("input", labeled(input_at)).withColumn("target", labeled(target_at))
    return df.withColumn("input-target", F.concat_ws(" ", "input", "target"))


def parse_quantization(df: DataFrame, name: str, r_at: int, q_at: int) -> DataFrame:
    parts = F.split(F.get(F.split(name, "_"), 1), "-")
    return df.withColumn("rvalue", F.substr(F.get(parts, r_at), F.lit(3))).withColumn(
        "quantization", F.substr(F.get(parts, q_at), F.lit(2))
    )


def parse_run_name_regex(df: DataFrame, name: str = "run_name") -> DataFrame:
    found = {c: F.nullif(F.regexp_extract(name, p, 1), F.lit("")).try_cast("int") for c, p in RUN_NAME.items()}
    found["gradient_checkpointing"] = found["gradient_checkpointing"] != 0
    return df.withColumns(found)


def recode_and_fill(
    df: DataFrame, state: str = "state", out: str = "is_success", fill: dict[str, float] | None = None
) -> DataFrame:
    """``failed``/``finished`` in any case -> boolean; any other state -> null; nulls of numeric columns -> a constant."""
    low = F.lower(state)
    text = F.replace(F.replace(low, F.lit("failed"), F.lit("0")), F.lit("finished"), F.lit("1"))
    df = df.withColumn(state, text.try_cast("int") != 0).withColumnRenamed(state, out)
    return df.fillna(fill) if fill else df


def metric_name(column: str) -> str:
    return column.removeprefix("eval/").removeprefix("train/").replace("_", " ")


def rename_metric_columns(df: DataFrame, long_names: dict[str, str] | None = None) -> DataFrame:
    """Drop ``eval/`` and ``train/``, underscores to spaces; long metric names to short ones."""
    long_names = long_names or {}
    return df.toDF(*[metric_name(long_names.get(c, c)) for c in df.columns])


def prune_columns(df: DataFrame, drop: list[str], metric: str) -> DataFrame:
    return df.filter(F.col(metric).isNotNull()).drop(*drop)


def coalesce_metric_pairs(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    return df.withColumns({new: F.coalesce(F.col(new), F.col(old)) for new, old in pairs.items()})


def bytes_to_gib(size: Column) -> Column:
    return size / float(1024**3)


def tag_constant(df: DataFrame, **tags) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def run_label(values: dict[str, Column], abbreviations: dict[str, str], letters_only: bool = False) -> Column:
    """``abbreviation + value`` joined by ``-``; parameters abbreviated ``no`` are left out."""
    keep = r"(?U)[^\p{IsAlphabetic}]" if letters_only else r"(?U)[^\p{IsAlphabetic}\p{IsDigit}]"

    def shown(value):
        text = value.cast("string")
        alias = reduce(lambda c, kv: F.when(text == kv[0], F.lit(kv[1])).otherwise(c), OPTIMIZER_ALIASES.items(), text)
        return F.regexp_replace(alias, keep, "")

    return F.concat_ws("-", *[F.concat(F.lit(abbreviations[k]), shown(v)) for k, v in values.items() if abbreviations[k] != "no"])


def parameter_grid(lists: DataFrame, names: list[str]) -> DataFrame:
    """All combinations of the parameter lists held in the array columns of a one-row table."""
    return reduce(lambda df, name: df.withColumn(name, F.explode(name)), names, lists.select(*names))


def success_rate_by_pair(df: DataFrame, a: str, b: str, flag: str = "is_success") -> DataFrame:
    return df.groupBy(a, b).agg((F.avg(F.col(flag).cast("int")) * 100).alias("success_rate"))


def pivot_rate(df: DataFrame, a: str, b: str, levels: list, flag: str = "is_success") -> DataFrame:
    """Rates as a matrix; the column levels are given, so no extra pass looks for them."""
    return df.groupBy(a).pivot(b, levels).agg(F.avg(F.col(flag).cast("int")) * 100)


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "score")


def metric_family(long: DataFrame, names: list[str]) -> DataFrame:
    return long.filter(F.col("metric").isin(names))


def box_stats(long: DataFrame, keys: list[str], value: str = "score", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Median, quartiles, whiskers (furthest values within 1.5 IQR) and outlier count per group.

    The long table is read once, into counts of its distinct values; those are written and used for
    the size question, the quartiles and the whiskers.
    """
    counts = settle(value_frequencies(long, keys, value), "frequencies")
    quarts = quantiles_by(counts, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, hot_rows)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return counts.join(quarts, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("bigint").alias("n_outliers"),
        F.sum("n").alias("n"),
    )


def mean_sd_by_group(long: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def linear_fit_by_group(long: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return long.groupBy(*keys).agg(F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"))


def success_failed_counts(df: DataFrame, factors: list[str], flag: str = "is_success") -> DataFrame:
    return df.groupBy(*factors).agg(
        F.count_if(~F.col(flag)).alias("n_failed"), F.count_if(F.col(flag)).alias("n_success")
    )


def union_runs(*tables: DataFrame) -> DataFrame:
    """Stack tables with differing columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def split_success(df: DataFrame, flag: str = "is_success") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(flag)), df.filter(~F.col(flag))
