"""Sinks. Each writes from the executors and returns the path or paths it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quercus.functions.responses import parse_execution
from quercus.functions.status import execution_status


def sink_parquet_gzip(df: DataFrame, path: str) -> str:
    df.write.option("compression", "gzip").parquet(path)
    return path


def run_summary(df: DataFrame, settings: dict[str, str], skipped: str = "is_skipped") -> DataFrame:
    """One row: the run's settings and the number of skipped rows."""
    return df.agg(F.count_if(F.col(skipped)).alias("NUMBER_OF_SKIPPED_ROWS")).select(
        *[F.lit(v).alias(k) for k, v in settings.items()], "NUMBER_OF_SKIPPED_ROWS"
    )


def sink_dataset_and_summary(
    df: DataFrame, path: str, settings: dict[str, str], offset: int, last: int | None = None, key: str = "row_id"
) -> tuple[str, str]:
    """The slice [offset, last) as JSON rows, and the summary of the whole table beside it."""
    wanted = F.col(key) >= offset
    if last is not None:
        wanted = wanted & (F.col(key) < last)
    data, summary = f"{path}/dataset", f"{path}/summary"
    df.filter(wanted).write.json(data)
    run_summary(df, settings).write.json(summary)
    return data, summary


def sink_dataset_with_summary(df: DataFrame, path: str, settings: dict[str, str], offset: int, last: int | None = None,
                              key: str = "row_id") -> str:
    """The one-output form: rows and the summary in one JSON output, told apart by ``part``."""
    wanted = F.col(key) >= offset
    if last is not None:
        wanted = wanted & (F.col(key) < last)
    rows = df.filter(wanted).select(F.lit("dataset").alias("part"), F.to_json(F.struct("*")).alias("content"))
    total = run_summary(df, settings)
    summary = total.select(F.lit("summary").alias("part"), F.to_json(F.struct(*total.columns)).alias("content"))
    rows.unionByName(summary).write.partitionBy("part").json(path)
    return path


def sink_gold_bundle(df: DataFrame, path: str, execution: str = "execution") -> str:
    """All rows in one table, partitioned by status; ``is_parsed`` marks the evaluated subset."""
    if "has_error" in df.columns:
        df = df.withColumn("status", F.when(F.coalesce("has_error", F.lit(False)), "generation_failed").otherwise(
            execution_status(F.col(execution))))
    else:
        df = df.withColumn("status", execution_status(F.col(execution)))
    parsed = (F.col("status") == "to_eval") & parse_execution(F.col(execution)).isNotNull()
    df.withColumn("is_parsed", parsed).write.partitionBy("status").parquet(path)
    return path


def read_gold_bundle(spark: SparkSession, path: str, subset: str = "all") -> DataFrame:
    """``all``, a status, or ``eval``; a status reads only its own folder."""
    df = spark.read.parquet(path)
    if subset == "all":
        return df
    if subset == "eval":
        return df.filter((F.col("status") == "to_eval") & F.col("is_parsed"))
    return df.filter(F.col("status") == subset)


def sink_splits(df: DataFrame, path: str, split: str = "split") -> str:
    df.write.partitionBy(split).parquet(path)
    return path


def write_columnar_json(df: DataFrame, key: str, path: str, rows_per_object: int = 1000) -> str:
    """``{column: {index: value}}`` objects of at most ``rows_per_object`` rows (``key`` is unique), one a line."""
    columns = [c for c in df.columns if c != key]

    def one(c: str) -> Column:
        entries = F.transform(F.col("_rows"), lambda r: F.struct(r[key].cast("string").alias("k"), r[c].cast("string").alias("v")))
        return F.map_from_entries(entries).alias(c)

    slices = df.groupBy(F.floor(F.col(key) / rows_per_object).alias("_slice")).agg(
        F.array_sort(F.collect_list(F.struct(key, *columns))).alias("_rows")
    )
    body = slices.select(F.to_json(F.struct(*[one(c) for c in columns]), {"ignoreNullFields": "false"}).alias("value"))
    body.write.text(path)
    return path


def resume_unprocessed(source: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``source`` that have no output yet."""
    return source.join(done.select(key), key, "left_anti")
