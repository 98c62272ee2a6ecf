"""Resumable classification of an execution log.

The checkpoint remembers which files are done, so a crash loses nothing and a restart repeats
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quercus.functions.status import error_classes, error_type, execution_status


def classify(df: DataFrame, execution: str = "execution") -> DataFrame:
    e = F.col(execution)
    status = execution_status(e)
    failed = status == "fail"
    return df.withColumns(
        {
            "status": status,
            "error_type": F.when(failed, error_type(e, invalid_json=True)),
            "error_classes": F.when(failed, F.array_join(error_classes(e), ", ")),
        }
    )


def stream_status(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Classify every file of ``source`` that the checkpoint has not seen, then stop."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        classify(rows).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
