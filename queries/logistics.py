"""Queries over shipments, vendors, hubs and ingestion logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.functions import values as V
from tablemend.operators import shipments as S
from tablemend.sources import files, tables

from . import Query
from . import inputs as I
from .inputs import with_logistics as L

AS_OF = "2024-01-31 00:00:00"

SHIPMENT_COLS = (
    "id, shipment_id, vendor_id, ingestion_log_id, material_type, weight_kg, predicted_delay_hours, "
    "status, origin_hub, destination_hub, departure_date"
)
RS_COLS = ", ".join("rs." + c.strip() for c in SHIPMENT_COLS.split(","))
VENDOR_CONSTS = (
    "'Tier 1' AS vendor_tier, 'Global' AS vendor_country, CAST(95.0 AS DOUBLE) AS vendor_reliability_score"
)
PAGE_ORDER = (
    "id DESC, shipment_id DESC, departure_date DESC, weight_kg DESC, vendor_id DESC, material_type DESC, "
    "origin_hub DESC"
)
RS_ORDER = ", ".join("rs." + c.strip() for c in PAGE_ORDER.split(","))

# numeric strings made dirty in a rule-based way: units, signs, blanks, commas
DIRTY_WEIGHT = """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE l_linenumber WHEN 1 THEN concat('-', CAST(l_quantity AS INT)) WHEN 2 THEN ''
            WHEN 3 THEN concat(' ', CAST(l_quantity AS INT), ' ') WHEN 4 THEN concat(CAST(l_quantity AS INT), ' kg')
            WHEN 5 THEN 'nan' WHEN 6 THEN concat(CAST(l_quantity AS INT), '.5') ELSE 'inf' END AS raw
FROM {lineitem}
"""
NUM_SQL = (
    r"CASE WHEN regexp_matches(trim(raw), '^[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?$') "
    r"THEN TRY_CAST(replace(trim(raw), '_', '') AS DOUBLE) END"
)

DIRTY_TEXT = """
SELECT c_custkey,
       CASE c_custkey % 5 WHEN 0 THEN concat(' ', c_mktsegment, ' ') WHEN 1 THEN '' WHEN 2 THEN 'NaN'
            WHEN 3 THEN lower(c_mktsegment) ELSE c_mktsegment END AS raw,
       CASE c_custkey % 9 WHEN 0 THEN 'ID' WHEN 1 THEN 'shipment_id' WHEN 2 THEN ' uid ' WHEN 3 THEN 'nan'
            WHEN 4 THEN '' ELSE c_name END AS raw_id
FROM {customer}
"""

# every status code that the canonical forms know, spread over events
STATUS_CASE = """
SELECT event_id, CAST(value AS DOUBLE) AS hours,
       CASE event_id % 11 WHEN 0 THEN 'Processing' WHEN 1 THEN 'repaired' WHEN 2 THEN 'delivered'
            WHEN 3 THEN 'SUCCESS' WHEN 4 THEN 'in_transit' WHEN 5 THEN 'failed' WHEN 6 THEN 'delayed'
            WHEN 7 THEN 'high_delay' WHEN 8 THEN 'minor_delay' WHEN 9 THEN 'queued' END AS status
FROM {events}
"""

# two thirds of the incoming shipments are stored already
EXISTING_SQL = "SELECT shipment_id FROM shipments WHERE id % 3 <> 0"

DIRTY_SHIPMENTS = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('SHP-', o_orderkey) END AS shipment_id,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('EXT-', o_custkey) WHEN o_orderkey % 3 = 1 THEN '' END AS external_id,
       CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN CAST(NULL AS VARCHAR(20)) ELSE o_orderpriority END AS material_type,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS DOUBLE) WHEN o_orderkey % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS weight_kg,
       CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_orderkey % 30 AS DOUBLE) END AS predicted_delay_hours,
       CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE n_name END AS origin_hub,
       CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS VARCHAR(20)) WHEN o_orderkey % 9 = 1 THEN 'NATION_99' ELSE n_name END AS destination_hub,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderstatus END AS status
FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
"""

DEFAULTS_SQL = """
SELECT id, shipment_id, coalesce(nullif(external_id, ''), shipment_id) AS external_id,
       coalesce(nullif(material_type, ''), 'General Cargo') AS material_type,
       coalesce(weight_kg, 250.0) AS weight_kg, coalesce(predicted_delay_hours, 0.0) AS predicted_delay_hours,
       coalesce(nullif(origin_hub, ''), '{o}') AS origin_hub,
       coalesce(nullif(destination_hub, ''), '{d}') AS destination_hub,
       coalesce(nullif(status, ''), 'processing') AS status
FROM ({src})
"""


def _routes(spark, sf_dir):
    rows = I.spark_view(spark, sf_dir, DIRTY_SHIPMENTS)
    return S.routes(rows, I.hubs(spark, sf_dir))


ROUTES_SQL = f"""
SELECT CAST(s.id AS VARCHAR) AS id,
       coalesce(nullif(s.origin_hub, ''), fo.code) AS from_hub,
       coalesce(nullif(s.destination_hub, ''), fd.code) AS to_hub,
       coalesce(ho.lat, 22.5937) AS from_lat, coalesce(ho.lng, 78.9629) AS from_lng,
       coalesce(hd.lat, 24.5937) AS to_lat, coalesce(hd.lng, 80.9629) AS to_lng,
       CASE WHEN lower(s.status) IN ('failed','delayed','high_delay') THEN 'high_delay'
            WHEN lower(s.status) = 'minor_delay' THEN 'minor_delay' ELSE 'on_time' END AS status,
       coalesce(nullif(s.shipment_id, ''), concat('SHP-', s.id)) AS shipment_id,
       'Default Vendor' AS vendor_name, coalesce(s.predicted_delay_hours, 0.0) AS predicted_delay_hours,
       'None' AS primary_delay_driver, CAST(4500.0 AS DOUBLE) AS freight_cost_usd,
       coalesce(nullif(s.material_type, ''), 'General Cargo') AS material_type
FROM ({I.duck(DIRTY_SHIPMENTS)}) s
LEFT JOIN hubs fo ON fo.position = s.id % 25 LEFT JOIN hubs fd ON fd.position = (s.id + 2) % 25
LEFT JOIN hubs ho ON ho.code = coalesce(nullif(s.origin_hub, ''), fo.code)
LEFT JOIN hubs hd ON hd.code = coalesce(nullif(s.destination_hub, ''), fd.code)
"""

ENDS_SQL = f"""
SELECT id, 'from' AS "end", from_lat AS lat, from_lng AS lng FROM ({ROUTES_SQL}) WHERE from_lat <> 0 AND from_lng <> 0
UNION ALL
SELECT id, 'to' AS "end", to_lat AS lat, to_lng AS lng FROM ({ROUTES_SQL}) WHERE to_lat <> 0 AND to_lng <> 0
"""


def _log_events(spark, sf_dir):
    e = I.logs(spark, sf_dir)
    opened = e.select("id", "filename", "file_size_bytes", "uploaded_at")
    closed = e.filter("status <> 'processing'").select(
        "id", "rows_total", "rows_repaired", "reconstruction_confidence",
        F.when(F.col("status") == "failed", F.lit("unreadable")).alias("error_message"),
        F.col("uploaded_at").alias("processed_at"),
    )
    return tables.log_events(opened, closed)


LATEST_LOG_SQL = """
SELECT id, filename, file_size_bytes,
       CASE WHEN status = 'processing' THEN 'processing' WHEN status = 'failed' THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN status <> 'processing' THEN rows_total END AS rows_total,
       CASE WHEN status <> 'processing' THEN rows_repaired END AS rows_repaired,
       CASE WHEN status <> 'processing' THEN reconstruction_confidence END AS reconstruction_confidence,
       CASE WHEN status = 'failed' THEN 'unreadable' END AS error_message, uploaded_at,
       CASE WHEN status <> 'processing' THEN uploaded_at END AS processed_at
FROM logs
"""


def _envelopes(spark, sf_dir):
    s = I.shipments(spark, sf_dir).withColumns(
        {
            "file_id": F.col("ingestion_log_id"),
            "row_idx": F.col("id"),
        }
    )
    per_file = s.select("file_id").distinct().withColumns(
        {"confidence": F.lit(0.88), "anomalies_repaired": F.lit(1)}
    )
    out = tables.to_envelope(s, per_file)
    parsed = F.from_json(
        "envelope",
        "status string, data array<struct<shipment_id:string,weight_kg:double>>, confidence double, anomalies_repaired int",
    )
    return out.withColumn("e", parsed).select(
        "file_id",
        F.col("e.status").alias("status"),
        F.size("e.data").cast("long").alias("n_rows"),
        F.round(F.aggregate("e.data", F.lit(0.0), lambda a, d: a + d["weight_kg"]), 4).alias("sum_weight"),
        F.col("e.confidence").alias("confidence"),
        F.col("e.anomalies_repaired").cast("long").alias("anomalies_repaired"),
    ).groupBy("file_id", "status", "confidence", "anomalies_repaired").agg(
        F.sum("n_rows").alias("n_rows"), F.round(F.sum("sum_weight"), 4).alias("sum_weight")
    )


def _model_tables(spark, sf_dir):
    """Model runs and their features, derived from parts: one run per brand, parts ranked by price."""
    runs = I.spark_view(
        spark, sf_dir,
        "SELECT p_brand AS id, concat('v-', p_brand) AS model_version, max(p_retailprice) AS created_at "
        "FROM {part} GROUP BY p_brand",
    )
    features = I.spark_view(
        spark, sf_dir,
        "SELECT p_brand AS model_run_id, p_name AS feature_name, p_retailprice / 10000 AS importance, "
        "p_type AS category, p_partkey AS rank FROM {part}",
    )
    return runs, features


def _status_view(spark, sf_dir):
    return I.spark_view(spark, sf_dir, STATUS_CASE)


def _dirty_dedup(spark, sf_dir):
    rows = I.shipments(spark, sf_dir).select(
        "shipment_id", "weight_kg", F.col("ingestion_log_id").alias("file_id"),
        (F.col("id") * 1000000 + F.col("vendor_id")).alias("row_idx"),
    )
    existing = rows.limit(0)
    # the sum is exact at any size; a file's sum that no BIGINT holds is NULL there and ends no other file
    total = F.sum(F.col("row_idx").cast("decimal(38,0)")).try_cast("bigint")
    return S.new_shipments(rows, existing, dedup="file").groupBy("file_id").agg(F.count("*").alias("n"), total.alias("s"))


QUERIES: dict[str, Query] = {
    # -- list, search, sort, point reads
    "shipments_page": Query(
        lambda sp, d: S.list_shipments(I.shipments(sp, d), I.vendors(sp, d), page=2, limit=50),
        L(
            f"SELECT {RS_COLS}, v.name AS vendor_name, {VENDOR_CONSTS} FROM shipments rs "
            f"LEFT JOIN vendors v ON v.id = rs.vendor_id ORDER BY {RS_ORDER} LIMIT 50 OFFSET 50"
        ),
    ),
    "shipments_page_filtered": Query(
        lambda sp, d: S.list_shipments(
            I.shipments(sp, d), I.vendors(sp, d), page=1, limit=500, status="delayed", q="#00000001"
        ),
        L(
            f"SELECT {RS_COLS}, v.name AS vendor_name, {VENDOR_CONSTS} FROM shipments rs "
            "LEFT JOIN vendors v ON v.id = rs.vendor_id WHERE rs.status = 'delayed' AND "
            f"(rs.shipment_id ILIKE '%#00000001%' OR v.name ILIKE '%#00000001%') ORDER BY {RS_ORDER} LIMIT 200"
        ),
    ),
    "shipments_page_info": Query(
        lambda sp, d: S.page_info(I.shipments(sp, d), I.vendors(sp, d), page=3, limit=50, status="delayed"),
        L(
            "SELECT count(*) AS total, 3 AS page, 50 AS \"limit\", CAST(ceil(count(*) / 50) AS BIGINT) AS pages "
            "FROM shipments WHERE status = 'delayed'"
        ),
    ),
    "shipments_by_status_and_log": Query(
        lambda sp, d: S.filter_log(S.filter_status(I.shipments(sp, d), "high_delay"), 7),
        L(f"SELECT {SHIPMENT_COLS} FROM shipments WHERE status = 'high_delay' AND ingestion_log_id = 7"),
    ),
    "search_like_vendor": Query(
        lambda sp, d: S.search_like(S.with_vendor(I.shipments(sp, d), I.vendors(sp, d)), "shp-1")
        .groupBy("vendor_name").agg(F.count("*").alias("n")),
        L(
            "SELECT v.name AS vendor_name, count(*) AS n FROM shipments rs LEFT JOIN vendors v ON v.id = rs.vendor_id "
            "WHERE rs.shipment_id ILIKE '%shp-1%' OR v.name ILIKE '%shp-1%' GROUP BY v.name"
        ),
    ),
    "search_any_column": Query(
        lambda sp, d: S.search_any(
            I.shipments(sp, d).select("shipment_id", "material_type", "status", "origin_hub", "destination_hub"), "Promo"
        ).groupBy("material_type").agg(F.count("*").alias("n")),
        L(
            "SELECT material_type, count(*) AS n FROM shipments WHERE contains(lower(shipment_id), 'promo') OR "
            "contains(lower(material_type), 'promo') OR contains(lower(status), 'promo') OR "
            "contains(lower(origin_hub), 'promo') OR contains(lower(destination_hub), 'promo') GROUP BY material_type"
        ),
    ),
    "sorted_by_delay": Query(
        lambda sp, d: S.sort_by(
            I.shipments(sp, d).select("id", "predicted_delay_hours", "weight_kg"), "predicted_delay_hours", "desc"
        ),
        L("SELECT id, predicted_delay_hours, weight_kg FROM shipments ORDER BY predicted_delay_hours DESC NULLS LAST, id"),
    ),
    "get_shipment": Query(
        lambda sp, d: S.get_shipment(I.shipments(sp, d), "SHP-7-3").select("id", "shipment_id"),
        L("SELECT id, shipment_id FROM shipments WHERE shipment_id = 'SHP-7-3' ORDER BY id LIMIT 1"),
    ),
    "inspect_columns": Query(
        lambda sp, d: S.inspect_columns(S.with_vendor(I.shipments(sp, d), I.vendors(sp, d))),
        L(
            "SELECT shipment_id, origin_hub, destination_hub, material_type, weight_kg, predicted_delay_hours, status, "
            "v.name AS vendor_name FROM shipments rs LEFT JOIN vendors v ON v.id = rs.vendor_id"
        ),
    ),
    "drop_internal_columns": Query(
        lambda sp, d: S.drop_internal(I.shipments(sp, d)),
        L(
            "SELECT id, shipment_id, material_type, weight_kg, predicted_delay_hours, status, origin_hub, "
            "destination_hub, departure_date FROM shipments"
        ),
    ),
    "delete_shipment": Query(
        lambda sp, d: S.delete_shipment(I.shipments(sp, d), 701).agg(
            F.count("*").alias("n"), F.sum("id").alias("ids")
        ),
        L("SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM shipments WHERE id <> 701"),
    ),
    "vendor_constants": Query(
        lambda sp, d: S.project_vendor_consts(S.with_vendor(I.shipments(sp, d).select("id", "vendor_id"), I.vendors(sp, d))),
        L(
            f"SELECT rs.id, rs.vendor_id, v.name AS vendor_name, {VENDOR_CONSTS} FROM shipments rs "
            "LEFT JOIN vendors v ON v.id = rs.vendor_id"
        ),
    ),
    # -- joins
    "vendor_join": Query(
        lambda sp, d: S.with_vendor(I.shipments(sp, d).select("id", "vendor_id", "weight_kg"), I.vendors(sp, d)),
        L(
            "SELECT rs.id, rs.vendor_id, rs.weight_kg, v.name AS vendor_name FROM shipments rs "
            "LEFT JOIN vendors v ON v.id = rs.vendor_id"
        ),
    ),
    "new_shipments": Query(
        lambda sp, d: S.new_shipments(
            I.shipments(sp, d).select("id", "shipment_id"),
            I.shipments(sp, d).filter("id % 3 <> 0").select("shipment_id"),
        ),
        L(
            "SELECT id, shipment_id FROM shipments WHERE shipment_id <> '' AND "
            f"NOT EXISTS (SELECT 1 FROM ({EXISTING_SQL}) e WHERE e.shipment_id = shipments.shipment_id)"
        ),
    ),
    "new_shipments_first_copy": Query(
        _dirty_dedup,
        L(
            "SELECT file_id, count(*) AS n, CAST(sum(row_idx) AS BIGINT) AS s FROM (SELECT ingestion_log_id AS file_id, "
            "min(id * 1000000 + vendor_id) AS row_idx FROM shipments GROUP BY shipment_id, ingestion_log_id) GROUP BY file_id"
        ),
    ),
    "geo_enrich": Query(
        lambda sp, d: S.geo_enrich(
            I.shipments(sp, d).select("id", "origin_hub", "destination_hub"), I.hubs(sp, d), "NATION_1", "NATION_2"
        ),
        L(
            "SELECT s.id, s.origin_hub, s.destination_hub, coalesce(o.lat, a.lat) AS origin_lat, "
            "coalesce(o.lng, a.lng) AS origin_lng, coalesce(t.lat, b.lat) AS destination_lat, "
            "coalesce(t.lng, b.lng) AS destination_lng FROM shipments s "
            "LEFT JOIN hubs o ON o.code = s.origin_hub LEFT JOIN hubs t ON t.code = s.destination_hub "
            "JOIN hubs a ON a.code = 'NATION_1' JOIN hubs b ON b.code = 'NATION_2'"
        ),
    ),
    "shipments_with_log": Query(
        lambda sp, d: S.shipments_by_log(
            I.shipments(sp, d).select("id", "ingestion_log_id"), I.logs(sp, d), "left"
        ),
        L(
            "SELECT s.id, s.ingestion_log_id, l.filename, l.status AS log_status, l.uploaded_at FROM shipments s "
            "LEFT JOIN logs l ON l.id = s.ingestion_log_id"
        ),
    ),
    "shipments_having_log": Query(
        lambda sp, d: S.shipments_by_log(
            I.shipments(sp, d).select("id", "ingestion_log_id"), I.logs(sp, d).filter("status = 'failed'"), "left_semi"
        ),
        L(
            "SELECT id, ingestion_log_id FROM shipments WHERE EXISTS (SELECT 1 FROM logs l WHERE "
            "l.id = shipments.ingestion_log_id AND l.status = 'failed')"
        ),
    ),
    "latest_risk_factors": Query(
        lambda sp, d: S.latest_risk_factors(*_model_tables(sp, d)),
        "WITH r AS (SELECT p_brand AS id, concat('v-', p_brand) AS model_version, max(p_retailprice) AS created_at "
        "FROM part GROUP BY p_brand), n AS (SELECT * FROM r ORDER BY created_at DESC, id DESC LIMIT 1) "
        "SELECT p_partkey AS rank, p_name AS feature, p_retailprice / 10000 AS importance, p_type AS category, "
        "CASE WHEN length(p_name) > 28 THEN concat(substr(p_name, 1, 28), '…') ELSE p_name END AS label, "
        "floor(p_retailprice / 10000 * 100 * 10 + 0.5) / 10 AS pct, model_version, created_at AS last_trained_at "
        "FROM part JOIN n ON n.id = p_brand",
    ),
    # -- headline aggregates
    "kpi": Query(
        lambda sp, d: S.kpi(I.shipments(sp, d), I.logs(sp, d)),
        L(
            "SELECT *, floor(avg_confidence * 10 + 0.5) / 10 AS avg_confidence_1dp, avg_confidence * 100 AS avg_confidence_pct "
            "FROM (SELECT count(*) AS total_shipments, count(*) FILTER (WHERE status = 'high_delay') AS at_risk_deliveries "
            "FROM shipments), (SELECT CAST(coalesce(sum(rows_repaired), 0) AS BIGINT) AS anomalies_repaired, "
            "coalesce(avg(reconstruction_confidence), 0.0) AS avg_confidence FROM logs WHERE status = 'success')"
        ),
    ),
    "ingestion_metrics": Query(
        lambda sp, d: S.ingestion_metrics(I.logs(sp, d), AS_OF, 14),
        L(
            "SELECT CAST(uploaded_at AS DATE) AS date, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS ingested, "
            "CAST(sum(CASE WHEN status = 'success' THEN rows_repaired ELSE 0 END) AS BIGINT) AS repaired, "
            "CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM logs "
            f"WHERE uploaded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS GROUP BY 1"
        ),
    ),
    "bracket_counts": Query(
        lambda sp, d: S.bracket_counts(I.shipments(sp, d)),
        L(
            "SELECT count(*) AS n_all, count(*) FILTER (WHERE predicted_delay_hours <= 3 AND status <> 'failed') AS n_on_time, "
            "count(*) FILTER (WHERE predicted_delay_hours > 3 AND predicted_delay_hours <= 12) AS n_minor_delay, "
            "count(*) FILTER (WHERE predicted_delay_hours > 12 OR status IN ('failed', 'high_delay')) AS n_high_delay FROM shipments"
        ),
    ),
    "impute_weight_median": Query(
        lambda sp, d: S.impute_weight(
            I.shipments(sp, d).select(
                "id", "material_type", F.when(F.col("id") % 4 > 0, F.col("weight_kg")).alias("weight_kg")
            )
        ),
        L(
            "SELECT s.id, s.material_type, s.weight_kg, CASE WHEN s.weight_kg IS NULL OR s.weight_kg = 0 THEN "
            "coalesce(m.med, 250.0) ELSE s.weight_kg END AS weight_kg_imputed FROM "
            "(SELECT id, material_type, CASE WHEN id % 4 > 0 THEN weight_kg END AS weight_kg FROM shipments) s LEFT JOIN "
            "(SELECT material_type, median(weight_kg) AS med FROM shipments WHERE id % 4 > 0 AND weight_kg <> 0 GROUP BY 1) m "
            "ON m.material_type = s.material_type"
        ),
    ),
    "impute_weight_baseline": Query(
        lambda sp, d: S.impute_weight(
            I.shipments(sp, d).select(
                "id", F.when(F.col("id") % 4 > 0, F.col("weight_kg")).alias("weight_kg")
            ),
            "baseline",
        ),
        L(
            "SELECT id, weight_kg, CASE WHEN weight_kg IS NULL OR weight_kg = 0 THEN 250.0 ELSE weight_kg END AS weight_kg_imputed "
            "FROM (SELECT id, CASE WHEN id % 4 > 0 THEN weight_kg END AS weight_kg FROM shipments)"
        ),
    ),
    # -- quality, alerts, guard
    "constraint_checks": Query(
        lambda sp, d: S.constraint_checks(
            I.shipments(sp, d),
            I.spark_view(sp, d, "SELECT s_nationkey % 6 AS tier, s_acctbal / 80 AS reliability_score FROM {supplier}"),
            I.logs(sp, d),
        ),
        L(
            "SELECT 'vendor_tier' AS \"check\", count(*) AS violations FROM supplier WHERE s_nationkey % 6 NOT BETWEEN 1 AND 4 "
            "UNION ALL SELECT 'vendor_reliability', count(*) FROM supplier WHERE s_acctbal / 80 NOT BETWEEN 0 AND 100 "
            "UNION ALL SELECT 'shipment_status', count(*) FROM shipments WHERE status NOT IN ('on_time', 'minor_delay', 'high_delay') "
            "UNION ALL SELECT 'log_status', count(*) FROM logs WHERE status NOT IN ('queued', 'processing', 'success', 'failed')"
        ),
    ),
    "confidence_guard": Query(
        lambda sp, d: S.confidence_guard(
            I.logs(sp, d).select("id", F.col("reconstruction_confidence").alias("confidence"))
        ),
        L(
            "SELECT id, reconstruction_confidence AS confidence, CASE WHEN reconstruction_confidence >= 0.85 THEN 'accepted' "
            "ELSE 'review' END AS route FROM logs"
        ),
    ),
    "delay_alerts": Query(
        lambda sp, d: S.delay_alerts(I.shipments(sp, d)),
        L(
            "SELECT id, shipment_id, 'critical' AS type, 'Critical Delivery Delay Risk' AS title, "
            "concat('Shipment ', shipment_id, ' (', material_type, ', ', origin_hub, ' → ', destination_hub, "
            "') predicted delay hours at ', CAST(CAST(predicted_delay_hours AS DECIMAL(30,1)) AS VARCHAR), "
            "' hrs exceeds high risk warning threshold (>12 hrs).') AS description FROM shipments WHERE predicted_delay_hours > 12"
        ),
    ),
    # -- routes
    "routes": Query(_routes, L(ROUTES_SQL)),
    "routes_at_risk": Query(
        lambda sp, d: S.filter_routes(
            S.routes(I.shipments(sp, d), I.hubs(sp, d)), "high_delay"
        ).groupBy("status", "to_hub").agg(F.count("*").alias("n")),
        L(
            "SELECT 'high_delay' AS status, destination_hub AS to_hub, count(*) AS n FROM shipments "
            "WHERE status IN ('failed', 'delayed', 'high_delay') GROUP BY destination_hub"
        ),
    ),
    "valid_coords": Query(lambda sp, d: S.valid_coords(_routes(sp, d)), L(ENDS_SQL)),
    "bounding_box": Query(
        lambda sp, d: S.bounding_box(_routes(sp, d)),
        L(
            "SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lng) AS min_lng, max(lng) AS max_lng, "
            f"count(*) AS n_points FROM ({ENDS_SQL})"
        ),
    ),
    "lane_counts": Query(
        lambda sp, d: S.lane_counts(_routes(sp, d)),
        L(f"SELECT from_hub, to_hub, count(*) AS n_routes FROM ({ROUTES_SQL}) GROUP BY 1, 2"),
    ),
    # -- cleaning
    "to_weight_and_delay": Query(
        lambda sp, d: I.spark_view(sp, d, DIRTY_WEIGHT).select(
            "l_orderkey", "l_linenumber", "l_partkey",
            V.to_weight(F.col("raw")).alias("weight_kg"), V.to_delay(F.col("raw")).alias("delay"),
        ),
        f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {NUM_SQL} >= 0 THEN {NUM_SQL} ELSE 250.0 END AS weight_kg, "
        f"CASE WHEN {NUM_SQL} >= 0 THEN {NUM_SQL} ELSE 0.0 END AS delay FROM ({I.duck(DIRTY_WEIGHT)})",
    ),
    "clean_text_values": Query(
        lambda sp, d: I.spark_view(sp, d, DIRTY_TEXT)
        .filter(V.is_record_id(F.col("raw_id")))
        .select(
            "c_custkey", V.clean_status(F.col("raw")).alias("status"), V.clean_hub(F.col("raw")).alias("hub"),
            V.clean_material(F.col("raw")).alias("material"),
        ),
        f"SELECT c_custkey, CASE WHEN lower(trim(raw)) IN ('', 'nan') THEN 'processing' ELSE lower(trim(raw)) END AS status, "
        f"upper(trim(raw)) AS hub, CASE WHEN trim(raw) = '' THEN 'General Cargo' ELSE trim(raw) END AS material "
        f"FROM ({I.duck(DIRTY_TEXT)}) WHERE lower(trim(raw_id)) NOT IN "
        "('shipment_id','expected_sequence','nan','','id','condition','uid')",
    ),
    "ingest_defaults": Query(
        lambda sp, d: S.ingest_defaults(I.spark_view(sp, d, DIRTY_SHIPMENTS)),
        DEFAULTS_SQL.format(o="MUM_HUB", d="DEL_HUB", src=I.duck(DIRTY_SHIPMENTS)),
    ),
    "stored_shipments": Query(
        lambda sp, d: S.geo_enrich(
            S.ingest_defaults(I.spark_view(sp, d, DIRTY_SHIPMENTS)), I.hubs(sp, d), "NATION_1", "NATION_2"
        ).select("id", "external_id", "weight_kg", "origin_lat", "origin_lng", "destination_lat", "destination_lng"),
        L(
            "SELECT s.id, s.external_id, s.weight_kg, coalesce(o.lat, a.lat) AS origin_lat, coalesce(o.lng, a.lng) AS origin_lng, "
            "coalesce(t.lat, b.lat) AS destination_lat, coalesce(t.lng, b.lng) AS destination_lng FROM ("
            + DEFAULTS_SQL.format(o="MUM_HUB", d="DEL_HUB", src=I.duck(DIRTY_SHIPMENTS))
            + ") s LEFT JOIN hubs o ON o.code = s.origin_hub LEFT JOIN hubs t ON t.code = s.destination_hub "
            "JOIN hubs a ON a.code = 'NATION_1' JOIN hubs b ON b.code = 'NATION_2'"
        ),
    ),
    "norm_confidence": Query(
        lambda sp, d: I.table(sp, d, "events").select(
            "event_id", V.norm_confidence(F.when(F.col("event_id") % 5 > 0, F.col("value"))).alias("confidence")
        ),
        "SELECT event_id, CASE WHEN event_id % 5 = 0 OR value = 0 THEN 0.95 "
        "ELSE floor((CASE WHEN value > 1 THEN value / 100 ELSE value END) * 100 + 0.5) / 100 END AS confidence FROM events",
    ),
    # -- canonical and display forms
    "canonical_status": Query(
        lambda sp, d: _status_view(sp, d).select(
            "event_id", V.canon_status_route(F.col("status")).alias("route_status"),
            V.canon_status_badge(F.col("status")).alias("badge"),
            V.status_label(V.canon_status_badge(F.col("status"))).alias("badge_label"),
            V.status_label(V.canon_status_route(F.col("status"))).alias("route_label"),
        ),
        f"""SELECT *, CASE badge WHEN 'success' THEN 'Success' WHEN 'processing' THEN 'Processing' WHEN 'failed' THEN 'Failed'
            ELSE 'Queued' END AS badge_label, CASE route_status WHEN 'on_time' THEN 'On Time' WHEN 'minor_delay' THEN
            'Minor Delay' ELSE 'High Delay Risk' END AS route_label FROM (SELECT event_id,
            CASE WHEN lower(status) IN ('failed','delayed','high_delay') THEN 'high_delay' WHEN lower(status) = 'minor_delay'
            THEN 'minor_delay' ELSE 'on_time' END AS route_status,
            CASE WHEN lower(status) IN ('delivered','on_time','success') THEN 'success'
                 WHEN lower(status) IN ('delayed','high_delay','failed') THEN 'failed'
                 WHEN lower(status) IN ('in_transit','minor_delay','processing') THEN 'processing' ELSE 'queued' END AS badge
            FROM ({I.duck(STATUS_CASE)}))""",
    ),
    "delay_brackets": Query(
        lambda sp, d: _status_view(sp, d).select(
            "event_id",
            *[V.in_bracket(F.col("hours"), F.col("status"), b).alias(b) for b in ("on_time", "minor_delay", "high_delay")],
        ),
        f"SELECT event_id, hours <= 3 AND lower(coalesce(status, '')) <> 'failed' AS on_time, hours > 3 AND hours <= 12 AS minor_delay, "
        f"hours > 12 OR lower(coalesce(status, '')) IN ('failed', 'high_delay') AS high_delay FROM ({I.duck(STATUS_CASE)})",
    ),
    "risk_display": Query(
        lambda sp, d: I.shipments(sp, d).select(
            "id", V.risk_pct(F.col("predicted_delay_hours")).alias("pct"),
            V.risk_band(F.col("predicted_delay_hours")).alias("band"),
            V.format_delay(F.col("predicted_delay_hours")).alias("shown"),
        ),
        L(
            "SELECT id, pct, CASE WHEN pct >= 75 THEN 'red' WHEN pct >= 40 THEN 'amber' ELSE 'green' END AS band, "
            "CASE WHEN h > 24 THEN concat(CAST(floor(h / 24) AS BIGINT), 'd ', CAST(floor(h % 24 + 0.5) AS BIGINT), 'h') "
            "ELSE concat(regexp_replace(CAST(h AS VARCHAR), '\\.0$', ''), ' hrs') END AS shown FROM "
            "(SELECT id, predicted_delay_hours AS h, CAST(least(100, greatest(0, floor(predicted_delay_hours * 4 + 0.5))) AS INT) AS pct "
            "FROM shipments)"
        ),
    ),
    "byte_sizes": Query(
        lambda sp, d: I.logs(sp, d).select(
            "id", V.format_bytes(F.col("file_size_bytes") * 37).alias("dashboard"),
            V.format_bytes(F.col("file_size_bytes") * 37, 2, 1).alias("upload"),
        ),
        L(
            "SELECT id, CASE WHEN b > 1000000 THEN concat(CAST(floor(b / 1000000 * 10 + 0.5) / 10 AS DECIMAL(30,1)), ' MB') "
            "ELSE concat(CAST(floor(b / 1000 + 0.5) AS DECIMAL(30,0)), ' KB') END AS dashboard, "
            "CASE WHEN b > 1000000 THEN concat(CAST(floor(b / 1000000 * 100 + 0.5) / 100 AS DECIMAL(30,2)), ' MB') "
            "ELSE concat(CAST(floor(b / 1000 * 10 + 0.5) / 10 AS DECIMAL(30,1)), ' KB') END AS upload "
            "FROM (SELECT id, CAST(file_size_bytes * 37 AS DOUBLE) AS b FROM logs)"
        ),
    ),
    "format_upload_time": Query(
        lambda sp, d: I.logs(sp, d).select("id", V.format_ts(F.col("uploaded_at")).alias("shown")),
        L("SELECT id, strftime(uploaded_at, '%b %-d, %I:%M %p') AS shown FROM logs"),
    ),
    "format_key": Query(
        lambda sp, d: I.table(sp, d, "part").select(
            "p_partkey", V.format_key(F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit("Size"))).alias("title")
        ),
        "SELECT p_partkey, array_to_string(list_transform(regexp_split_to_array(regexp_replace(concat(lower(replace(p_type, ' ', '_')), "
        "'Size'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_|\\s+'), lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ') AS title FROM part",
    ),
    "imputed_fields": Query(
        lambda sp, d: I.spark_view(
            sp, d,
            "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('[\"', event_type, '\",\"ts\",\"v', user_id, '\"]') ELSE props END AS raw FROM {events}",
        ).select("event_id", V.parse_imputed(F.col("raw")).alias("f")).select(
            "event_id", F.array_join(V.imputed_badge(F.col("f"))["shown"], "|").alias("shown"),
            V.imputed_badge(F.col("f"))["more"].cast("long").alias("more"),
        ),
        "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(event_type, '|ts') ELSE '' END AS shown, "
        "CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS more FROM events",
    ),
    "display_values": Query(
        lambda sp, d: I.spark_view(sp, d, DIRTY_SHIPMENTS).select(
            "id", V.display_null(F.col("material_type")).alias("material"), V.short_ext_id(F.col("external_id")).alias("ext"),
            V.truncate_label(F.concat(F.col("origin_hub"), F.lit(" via "), F.col("status"), F.lit(" to the last terminal"))).alias("label"),
        ),
        f"SELECT id, CASE WHEN material_type IS NULL OR material_type IN ('', '—') THEN 'Not Provided' ELSE material_type END AS material, "
        f"concat(substr(coalesce(external_id, ''), 1, 14), '...') AS ext, CASE WHEN length(l) > 28 THEN concat(substr(l, 1, 28), '…') ELSE l END AS label "
        f"FROM (SELECT *, concat(origin_hub, ' via ', status, ' to the last terminal') AS l FROM ({I.duck(DIRTY_SHIPMENTS)}))",
    ),
    # -- logs, envelopes, admission
    "latest_log": Query(lambda sp, d: tables.latest_log(_log_events(sp, d)), L(LATEST_LOG_SQL)),
    "log_status": Query(
        lambda sp, d: tables.log_status(tables.latest_log(_log_events(sp, d)), 42),
        L(f"SELECT * FROM ({LATEST_LOG_SQL}) WHERE id = 42"),
    ),
    "admit_files": Query(
        lambda sp, d: files.admit(
            I.spark_view(
                sp, d,
                "SELECT concat(url, CASE page_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.txt' WHEN 3 THEN '.pdf' "
                "ELSE '.CSV' END) AS path, CAST(length(html) AS BIGINT) AS file_size_bytes FROM {pages}",
            ),
            max_bytes=2000,
        ),
        "SELECT path, file_size_bytes, CASE WHEN NOT regexp_matches(path, '\\.(csv|txt|xlsx|xls)$', 'i') THEN 'rejected_type' "
        "WHEN file_size_bytes > 2000 THEN 'rejected_size' WHEN NOT regexp_matches(path, '\\.(csv|txt)$', 'i') THEN 'unsupported' "
        "ELSE 'admitted' END AS decision FROM (SELECT concat(url, CASE page_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' "
        "WHEN 2 THEN '.txt' WHEN 3 THEN '.pdf' ELSE '.CSV' END) AS path, length(html) AS file_size_bytes FROM pages)",
    ),
    "envelopes": Query(
        _envelopes,
        L(
            "SELECT ingestion_log_id AS file_id, 'reconstructed' AS status, count(*) AS n_rows, round(sum(weight_kg), 4) AS sum_weight, "
            "CAST(0.88 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS anomalies_repaired FROM shipments GROUP BY 1"
        ),
    ),
}
