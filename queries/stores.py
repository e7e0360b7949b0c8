"""Shipments served from a keyed store that two batches filled; each query builds its own from the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablemend.operators import shipments as S
from tablemend.session import cut, drop_table, ensure_checkpoint_dir
from tablemend.sources.store import KeyedStore

from . import Query
from . import inputs as I
from .inputs import with_logistics as L

SCHEMA = (
    "vendor_id long, ingestion_log_id long, shipment_id string, material_type string, weight_kg double, "
    "predicted_delay_hours double, status string, origin_hub string, destination_hub string, departure_date date, "
    "source_id long"
)
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]
# the given lines hold several of one order and number; the further columns tell them apart
ORDER = ["ingestion_log_id", "source_id", "departure_date", "weight_kg", "vendor_id", "material_type", "origin_hub", "status"]


def _store(spark, sf_dir) -> KeyedStore:
    """A third of the shipments, then all of them: the second batch brings what is not stored yet."""
    store = KeyedStore(f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", SCHEMA, segment_rows=1 << 16)
    rows = I.shipments(spark, sf_dir).withColumnRenamed("id", "source_id")
    rows = rows.withColumn("departure_date", F.to_date("departure_date")).withColumn("weight_kg", F.col("weight_kg").cast("double"))
    rows = rows.withColumns({"vendor_id": F.col("vendor_id").cast("long"), "ingestion_log_id": F.col("ingestion_log_id").cast("long")})
    # both batches read the joined table, which is made once
    rows = cut(rows)
    store.append(rows.filter("source_id % 3 = 0"), 0, ORDER, settled=True)
    store.append(rows, 1, ORDER, settled=True)
    drop_table(rows)
    return store


STORED = f"""
stored AS (SELECT CAST(row_number() OVER (ORDER BY source_id % 3 <> 0, {", ".join(ORDER)}) AS BIGINT) AS id, * FROM (
  SELECT CAST(vendor_id AS BIGINT) AS vendor_id, CAST(ingestion_log_id AS BIGINT) AS ingestion_log_id, shipment_id, material_type,
         CAST(weight_kg AS DOUBLE) AS weight_kg, predicted_delay_hours, status, origin_hub, destination_hub,
         CAST(departure_date AS DATE) AS departure_date, CAST(id AS BIGINT) AS source_id FROM shipments))
"""
ALL = ", ".join(["id", *COLUMNS])


def _stored(body: str) -> str:
    return L("SELECT 1").rsplit(" SELECT 1", 1)[0] + f", {STORED} {body}"


def _two_batches(spark, sf_dir):
    return _store(spark, sf_dir).rows(spark).select("id", *COLUMNS)


def _pages(spark, sf_dir):
    """A late page of everything, and one of the late shipments."""
    store = _store(spark, sf_dir)
    plain = store.page(spark, page=17, limit=200).withColumn("kind", F.lit("all"))
    late = store.page(spark, page=3, limit=200, where=F.col("status") == "high_delay").withColumn("kind", F.lit("late"))
    return plain.unionByName(late).select("kind", "id", *COLUMNS)


def _deleted(spark, sf_dir):
    """One number of each batch is deleted and its row looked up; then every page total and row is counted."""
    store = _store(spark, sf_dir)
    for number in (7, store.total(spark).first()[0]):
        store.delete(spark, number)
    return (
        store.rows(spark)
        .groupBy("batch_id")
        .agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum("source_id").alias("sources"))
        .join(store.fences(spark).groupBy("batch_id").agg(F.sum("n").alias("fenced")), "batch_id")
        .join(store.keys(spark).groupBy("batch_id").agg(F.sum("id").alias("indexed")), "batch_id")
    )


def _routes(spark, sf_dir):
    """Edges of the stored shipments, by lane."""
    edges = S.routes(_store(spark, sf_dir).rows(spark), I.hubs(spark, sf_dir))
    return edges.groupBy("from_hub", "to_hub", "status").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


QUERIES: dict[str, Query] = {
    "store_two_batches": Query(_two_batches, _stored(f"SELECT {ALL} FROM stored")),
    "store_pages": Query(
        _pages,
        _stored(
            f"SELECT * FROM (SELECT 'all' AS kind, {ALL} FROM stored ORDER BY id DESC LIMIT 200 OFFSET 3200) UNION ALL "
            f"SELECT * FROM (SELECT 'late' AS kind, {ALL} FROM stored WHERE status = 'high_delay' ORDER BY id DESC LIMIT 200 OFFSET 400)"
        ),
    ),
    "store_delete": Query(
        _deleted,
        _stored(
            "SELECT CAST(CASE WHEN source_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS batch_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, "
            "CAST(sum(source_id) AS BIGINT) AS sources, count(*) AS fenced, CAST(sum(id) AS BIGINT) AS indexed FROM stored "
            "WHERE id <> 7 AND id <> (SELECT count(*) FROM stored) GROUP BY 1"
        ),
    ),
    "store_routes": Query(
        _routes,
        _stored(
            "SELECT origin_hub AS from_hub, destination_hub AS to_hub, CASE WHEN lower(status) IN ('failed','delayed','high_delay') "
            "THEN 'high_delay' WHEN lower(status) = 'minor_delay' THEN 'minor_delay' ELSE 'on_time' END AS status, count(*) AS n, "
            "CAST(sum(id) AS BIGINT) AS ids FROM stored GROUP BY 1, 2, 3"
        ),
    ),
}
