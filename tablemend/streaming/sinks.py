"""Idempotent file sinks for ``foreachBatch``.

Every micro-batch owns the folder ``batch_id=N`` of the target. A batch that is
run again after a failure overwrites its own folder and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All finished batches, or those before a given one; empty while there are none."""
    try:
        stored = spark.read.option("basePath", path).schema(f"{schema}, batch_id long").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], f"{schema}, batch_id long")
    return stored if before is None else stored.filter(F.col("batch_id") < before)
