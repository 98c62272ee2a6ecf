"""A ledger of stages: what is already written for the same input, code and parameters is not worked out again."""

from __future__ import annotations

import hashlib
import inspect
import json
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Written by Spark's output commit as the last file of a table.
COMMITTED = "_SUCCESS"


@dataclass(frozen=True)
class Stage:
    """``run`` takes the output of the stage before and the parameters."""

    name: str
    run: Callable[..., DataFrame]
    parameters: dict = field(default_factory=dict)


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files below a path, whatever store it is in."""
    target, system = _file_system(spark, path)
    listed, files = system.listFiles(target, True), []
    while listed.hasNext():
        one = listed.next()
        files.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return _digest(sorted(files))


def code_of(function: Callable) -> str:
    try:
        return inspect.getsource(function)
    except (OSError, TypeError):
        return function.__code__.co_code.hex() if hasattr(function, "__code__") else repr(function)


def run_stages(
    spark: SparkSession, source: DataFrame, inputs: Sequence[str], stages: Sequence[Stage], folder: str
) -> tuple[DataFrame, list[str]]:
    """The last stage's table, and the names of the stages that had to be written.

    A stage is known by the files of ``inputs``, its code, its parameters and all of these of the stages before, so a
    change anywhere writes that stage and those after it anew. A folder without the mark of a finished write, as a
    stage that was cut off leaves it, is written over. The functions that a stage calls are not part of its code: name
    a version among its parameters where these change.
    """
    key, df, written = _digest([fingerprint(spark, path) for path in inputs]), source, []
    for stage in stages:
        key = _digest(key, stage.name, code_of(stage.run), stage.parameters)
        path = os.path.join(folder, f"{stage.name}-{key}")
        mark, system = _file_system(spark, os.path.join(path, COMMITTED))
        if not system.exists(mark):
            stage.run(df, **stage.parameters).write.mode("overwrite").parquet(path)
            written.append(stage.name)
        df = spark.read.parquet(path)
    return df, written
