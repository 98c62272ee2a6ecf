"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "quercus", **conf: str) -> SparkSession:
    """A session with adaptive execution on; extra settings override the defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local master may go without the setting: there one machine runs everything.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="quercus-")
    spark.sparkContext.setCheckpointDir(root)
    return root


_made: list[str] = []  # paths that this process has handed out


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder; the number of paths that were there.

    Results are lazy and read these tables: call it once they are written or no longer wanted.
    """
    jvm, dropped = spark.sparkContext._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        dropped += bool(system.delete(path, True))
    return dropped


def settle(df: DataFrame, label: str) -> DataFrame:
    """The table written once to the shared folder and read back.

    What reads it more than once no longer works out its lineage again, not even after an executor
    is lost; each reader still takes only the columns it needs.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
