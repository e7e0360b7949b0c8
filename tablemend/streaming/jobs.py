"""Manifest ingest, daily metrics and de-duplication as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.shipments import to_stored
from ..plans.manifest import manifest_report, process_manifest
from ..plans.reconstruct import confidences, reconstruct
from ..session import cut, drop_table
from ..sources.files import content_of, decision, line_columns, number_lines, readable, rows_from_lines, with_width
from ..sources.store import KeyedStore
from ..sources.tables import log_events
from .sinks import read_batches, write_batch

STORED_SCHEMA = (
    "vendor_id string, ingestion_log_id string, shipment_id string, external_id string, material_type string, "
    "weight_kg double, predicted_delay_hours double, status string, origin_hub string, destination_hub string, "
    "origin_lat double, origin_lng double, destination_lat double, destination_lng double"
)

METRIC_SCHEMA = "date date, ingested long, repaired long, failed long"


def manifest_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of new files below a folder; large files are read in splits. What is no manifest is told apart in the batch."""
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .load(path)
        .select(*line_columns())
    )


def unseen(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose id is not stored.

    The store is first reduced to the ids of this batch; it is the large side,
    and against a small batch it is scanned in place instead of shuffled.
    """
    ids = incoming.filter("shipment_id <> ''").select("shipment_id").distinct()
    known = existing.select("shipment_id").join(ids, "shipment_id", "left_semi").distinct()
    return incoming.filter("shipment_id <> ''").join(known, "shipment_id", "left_anti")


LOG_SCHEMA = (
    "id long, filename string, file_size_bytes long, status string, rows_total long, rows_repaired long, "
    "reconstruction_confidence double, error_message string, uploaded_at timestamp, processed_at timestamp, version int"
)


def file_sizes(raw: DataFrame) -> DataFrame:
    """Bytes of each file's lines."""
    size = F.sum(F.octet_length(F.array_join("cells", ",", "")) + 1)
    return raw.groupBy("file_id").agg(size.alias("file_size_bytes"))


def batch_log(raw: DataFrame, lost: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """Log events of a batch: every file was opened, and succeeded unless no shipment was found in it.

    ``lost`` holds ``file_id, file_size_bytes, error_message`` of files that were not processed: they failed.
    ``measured`` holds ``file_id, confidence`` of files whose tables were rebuilt.
    """
    seen = file_sizes(raw).withColumn("lost", F.lit(None).cast("string"))
    if lost is not None:
        seen = seen.unionByName(lost.withColumnRenamed("error_message", "lost"))
    none_found = F.when(F.coalesce("rows_out", F.lit(0)) == 0, "no shipment found")
    told = seen.join(manifest_report(raw, measured), "file_id", "left").select(
        F.xxhash64("file_id").alias("id"), F.regexp_extract("file_id", r"([^/]+)$", 1).alias("filename"),
        "file_size_bytes", F.coalesce("rows_out", F.lit(0)).alias("rows_total"),
        F.coalesce("anomalies_repaired", F.lit(0)).alias("rows_repaired"), F.current_timestamp().alias("at"),
        F.coalesce("lost", none_found).alias("error_message"),
        F.col("confidence").alias("reconstruction_confidence"),
    )
    opened = told.select("id", "filename", "file_size_bytes", F.col("at").alias("uploaded_at"))
    outcomes = told.select(
        "id", "rows_total", "rows_repaired", "reconstruction_confidence", "error_message", F.col("at").alias("processed_at")
    )
    return log_events(opened, outcomes)


def ingest_batch(
    hubs: DataFrame, store: str | KeyedStore, log: str | None = None, rebuild: bool = False
) -> Callable[[DataFrame, int], None]:
    """Batch function: admit files, clean, drop stored ids, enrich, append; with ``log``, events of each file go there.

    Files that are no manifests by name, or binary by content, become failed entries of the log; the others go on.
    With ``rebuild`` the log has the confidence of each file's reconstruction instead of the pass-through one.
    A ``KeyedStore`` numbers the rows in the order of files and lines, and reads only what may hold the batch's ids.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the source files are read once per batch
        read = cut(rows_from_lines(number_lines(batch)))
        fate = decision(F.col("file_id"), F.lit(0))
        seen = cut(content_of(read))
        raw = cut(with_width(readable(read.filter(fate == "admitted"), seen)))
        log_id = F.regexp_extract("file_id", r"([^/]+)$", 1)
        if isinstance(store, KeyedStore):
            order = ["file_id", "row_idx"]
            told = process_manifest(raw).filter("shipment_id <> ''")
            store.append(to_stored(told, hubs, log_id, keep=order), batch_id, order)
        else:
            fresh = unseen(process_manifest(raw), read_batches(spark, store, STORED_SCHEMA, before=batch_id))
            write_batch(to_stored(fresh, hubs, log_id), store, batch_id)
        if log is not None:
            error = F.when(fate != "admitted", fate).when(F.col("is_binary"), "binary content")
            lost = seen.select("file_id", error.alias("error_message")).filter("error_message IS NOT NULL")
            measured = confidences(reconstruct(raw)) if rebuild else None
            write_batch(batch_log(raw, lost.join(file_sizes(read), "file_id"), measured), log, batch_id)
        for table in (read, seen, raw):
            drop_table(table)

    return run


def stream_ingest(
    spark: SparkSession, path: str, store: str | KeyedStore, checkpoint: str, hubs: DataFrame, files_per_batch: int = 1000,
    log: str | None = None, rebuild: bool = False,
) -> DataStreamWriter:
    return (
        manifest_stream(spark, path, files_per_batch)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(ingest_batch(hubs, store, log, rebuild))
    )


def daily_metrics(logs: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Streaming form of the per-day ingestion counters."""
    success = F.col("status") == "success"
    return (
        logs.withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp"))
        .withWatermark("uploaded_at", watermark)
        .groupBy(F.window("uploaded_at", "1 day").alias("w"))
        .agg(
            F.sum(F.when(success, 1).otherwise(0)).alias("ingested"),
            F.sum(F.when(success, F.col("rows_repaired")).otherwise(0)).alias("repaired"),
            F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed"),
        )
        .select(F.to_date("w.start").alias("date"), "ingested", "repaired", "failed")
    )


def stream_metrics(logs: DataFrame, store: str, checkpoint: str, watermark: str = "2 days") -> DataStreamWriter:
    """Writes the days each batch touched; late rows inside the watermark update their day."""
    return (
        daily_metrics(logs, watermark)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: write_batch(df, store, batch_id))
    )


def read_metrics(spark: SparkSession, store: str) -> DataFrame:
    """Newest state of every day."""
    return (
        read_batches(spark, store, METRIC_SCHEMA)
        .groupBy("date")
        .agg(F.max_by(F.struct("ingested", "repaired", "failed"), "batch_id").alias("m"))
        .select("date", "m.*")
    )


def dedup_recent(df: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark; state is dropped behind it."""
    timed = df.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_dedup(
    df: DataFrame, key: str, event_time: str, delay: str, store: str | KeyedStore, schema: str, checkpoint: str
) -> DataStreamWriter:
    """De-duplicate recent rows in state and all older ones against the store, a ``KeyedStore`` by its index."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if isinstance(store, KeyedStore):
            store.append(batch, batch_id, [event_time, key])
            return
        existing = read_batches(batch.sparkSession, store, schema, before=batch_id)
        ids = batch.select(key).distinct()
        known = existing.select(key).join(ids, key, "left_semi").distinct()
        write_batch(batch.join(known, key, "left_anti"), store, batch_id)

    return (
        dedup_recent(df, key, event_time, delay)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(run)
    )


def drain(writer: DataStreamWriter) -> None:
    """Process everything that is there and stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
