"""Streaming jobs over the given tables; results must equal their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablemend.session import ensure_checkpoint_dir
from tablemend.sources import dims
from tablemend.streaming import jobs as J
from tablemend.streaming.sinks import read_batches

from . import Query
from . import inputs as I
from .inputs import with_logistics as L
from .manifests import CANONICAL_SQL, LINES


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir):
    schema = I.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _logs_stream(spark, sf_dir):
    return _event_stream(spark, sf_dir).selectExpr(
        "event_id AS id",
        "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'processing' ELSE 'success' END AS status",
        "CAST(floor(value / 10) AS BIGINT) AS rows_repaired",
        "ts AS uploaded_at",
    )


def _metrics(spark, sf_dir):
    root = _scratch(spark, "metrics")
    J.drain(J.stream_metrics(_logs_stream(spark, sf_dir), f"{root}/store", f"{root}/state"))
    return J.read_metrics(spark, f"{root}/store")


def _dedup(spark, sf_dir):
    root = _scratch(spark, "dedup")
    users = _event_stream(spark, sf_dir).select("user_id", "ts")
    J.drain(
        J.stream_dedup(users, "user_id", "ts", "40 days", f"{root}/store", "user_id long, ts timestamp", f"{root}/state")
    )
    return read_batches(spark, f"{root}/store", "user_id long, ts timestamp").groupBy("user_id").agg(F.count("*").alias("n"))


def _ingest(spark, sf_dir):
    """Manifests are written as text files, one folder per file id, then ingested as a stream."""
    root = _scratch(spark, "ingest")
    lines = I.spark_view(spark, sf_dir, LINES)
    text = F.concat_ws(",", *[F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(7)])
    # one text file per manifest, its lines in order; nothing is gathered in memory
    lines.select("f", "row_idx", text.alias("value")).repartition("f").sortWithinPartitions("f", "row_idx").select(
        "f", "value"
    ).write.partitionBy("f").text(f"{root}/in")
    J.drain(
        J.stream_ingest(spark, f"{root}/in/*/", f"{root}/store", f"{root}/state", dims.dim_geo_hubs(spark), files_per_batch=16)
    )
    return read_batches(spark, f"{root}/store", J.STORED_SCHEMA).select(
        "shipment_id", "material_type", "weight_kg", "predicted_delay_hours", "status", "origin_hub", "origin_lat", "destination_lng"
    )


QUERIES: dict[str, Query] = {
    "stream_metrics": Query(
        _metrics,
        L(
            "SELECT CAST(uploaded_at AS DATE) AS date, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS ingested, "
            "CAST(sum(CASE WHEN status = 'success' THEN rows_repaired ELSE 0 END) AS BIGINT) AS repaired, "
            "CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM logs GROUP BY 1"
        ),
    ),
    "stream_dedup": Query(_dedup, "SELECT DISTINCT user_id, CAST(1 AS BIGINT) AS n FROM events"),
    "stream_ingest": Query(
        _ingest,
        "SELECT shipment_id, material_type, weight_kg, predicted_delay_hours, status, origin_hub, CAST(19.0760 AS DOUBLE) AS origin_lat, "
        f"CAST(77.1025 AS DOUBLE) AS destination_lng FROM ({CANONICAL_SQL})",
    ),
}
