"""Persisted tables, sinks and the ingestion log."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SHIPMENT_COLUMNS = [
    "shipment_id", "origin_hub", "destination_hub", "material_type", "weight_kg",
    "predicted_delay_hours", "status",
]

STORED_COLUMNS = [
    "vendor_id", "ingestion_log_id", "shipment_id", "external_id", "material_type", "weight_kg",
    "predicted_delay_hours", "status", "origin_hub", "destination_hub", "origin_lat", "origin_lng",
    "destination_lat", "destination_lng",
]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, name) if not name.endswith(".parquet") else name)


def write_shipments(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, no index column; one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def to_envelope(
    rows: DataFrame, files: DataFrame, block_rows: int = 50_000
) -> DataFrame:
    """JSON envelopes ``{status,data[],confidence,anomalies_repaired}`` per file.

    ``rows`` holds canonical columns with ``file_id`` and ``row_idx``; ``files``
    holds ``file_id, confidence, anomalies_repaired``. A file longer than
    ``block_rows`` is written as several numbered envelopes, so that no task
    ever holds a whole large file.
    """
    payload = F.struct(*SHIPMENT_COLUMNS)
    parts = (
        rows.withColumn("part", F.floor(F.col("row_idx") / block_rows))
        .groupBy("file_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", payload.alias("r")))).alias("rs"))
    )
    return parts.join(files, "file_id").select(
        "file_id",
        "part",
        F.to_json(
            F.struct(
                F.lit("reconstructed").alias("status"),
                F.transform("rs", lambda x: x["r"]).alias("data"),
                "confidence",
                "anomalies_repaired",
            )
        ).alias("envelope"),
    )


def log_events(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Append-only log: a ``processing`` event per file and one for its outcome.

    ``files``: id, filename, file_size_bytes, uploaded_at. ``outcomes``: id,
    rows_total, rows_repaired, reconstruction_confidence, error_message, processed_at.
    """
    opened = files.select(
        "id", "filename", "file_size_bytes", F.lit("processing").alias("status"),
        F.lit(None).cast("long").alias("rows_total"), F.lit(None).cast("long").alias("rows_repaired"),
        F.lit(None).cast("double").alias("reconstruction_confidence"),
        F.lit(None).cast("string").alias("error_message"),
        "uploaded_at", F.lit(None).cast("timestamp").alias("processed_at"), F.lit(0).alias("version"),
    )
    closed = files.join(outcomes, "id").select(
        "id", "filename", "file_size_bytes",
        F.when(F.col("error_message").isNull(), "success").otherwise("failed").alias("status"),
        F.col("rows_total").cast("long"), F.col("rows_repaired").cast("long"),
        "reconstruction_confidence", "error_message", "uploaded_at", "processed_at",
        F.lit(1).alias("version"),
    )
    return opened.unionByName(closed)


def latest_log(events: DataFrame) -> DataFrame:
    """State of each log entry: its newest version."""
    payload = [c for c in events.columns if c not in ("id", "version")]
    # max_by keeps a partial state per id, so an id with many versions is folded map-side
    newest = events.groupBy("id").agg(F.max_by(F.struct(*payload), "version").alias("s"))
    return newest.select("id", "s.*")


def log_status(logs: DataFrame, log_id) -> DataFrame:
    return logs.filter(F.col("id") == F.lit(log_id))


def quality_flags(checks: dict[str, Column]) -> Column:
    """Names of the violated checks as an array; a NULL check counts as passed."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()])
    )
