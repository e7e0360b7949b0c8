"""Manifest queries: orders written out as messy manifests under three header styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.functions import cells as C
from tablemend.plans import manifest as M
from tablemend.plans.reconstruct import confidences, reconstruct
from tablemend.sources.tables import SHIPMENT_COLUMNS

from . import Query
from . import inputs as I

# file style: 0 clean header, 1 aliased header, 2 three header rows without a weight column
# file 0 holds a third of all rows, whatever their number; 47 files share the rest
REST = "(2 * CAST(floor(o_orderkey / 3) AS BIGINT) + o_orderkey % 3 - 1)"
FILE = f"CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + {REST} % 47 END"
ROW = f"CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_orderkey / 3) AS BIGINT) ELSE CAST(floor({REST} / 47) AS BIGINT) END"
BODY = """
SELECT {file} AS f, {row} AS r,
       concat('SHP-', o_orderkey) AS sid, lower(n_name) AS org, n_name AS dst,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS mat,
       CASE WHEN o_orderkey % 13 = 0 THEN 'heavy' WHEN o_orderkey % 13 = 1 THEN concat('-', o_custkey + 1) ELSE concat(o_custkey, '.5') END AS wt,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(o_orderkey % 60, '') END AS del,
       CASE WHEN o_orderkey % 17 = 0 THEN 'NaN' WHEN o_orderkey % 2 = 0 THEN 'Processing' ELSE 'failed' END AS st
FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
""".replace("{file}", FILE).replace("{row}", ROW)

# every 97th row of a file is a repeated header label and must be rejected
LINES = f"""
SELECT f, r + CASE WHEN f % 3 = 2 THEN 3 ELSE 1 END AS row_idx, CASE WHEN r % 97 = 5 THEN 'ID' ELSE sid END AS c0,
       CASE WHEN f % 3 = 2 THEN mat ELSE org END AS c1, CASE WHEN f % 3 = 2 THEN org ELSE dst END AS c2,
       CASE WHEN f % 3 = 2 THEN dst ELSE mat END AS c3, CASE WHEN f % 3 = 2 THEN concat('item ', r) ELSE wt END AS c4, del AS c5, st AS c6
FROM ({BODY})
UNION ALL SELECT f, CAST(0 AS BIGINT), 'shipment_id', 'origin_hub', 'destination_hub', 'material_type', 'weight_kg', 'predicted_delay_hours', 'status'
FROM (SELECT DISTINCT {FILE} AS f FROM {{orders}}) WHERE f % 3 = 0
UNION ALL SELECT f, CAST(0 AS BIGINT), 'uid', 'source', 'target', 'cargo', 'mass', 'delay', 'state'
FROM (SELECT DISTINCT {FILE} AS f FROM {{orders}}) WHERE f % 3 = 1
UNION ALL SELECT f, CAST(0 AS BIGINT), 'Consignment', '', 'Journey', '', 'Load', 'Forecast', 'Progress'
FROM (SELECT DISTINCT {FILE} AS f FROM {{orders}}) WHERE f % 3 = 2
UNION ALL SELECT f, CAST(1 AS BIGINT), 'Parcel ref', '', 'Stops', '', 'Goods', 'Lateness', 'Stage'
FROM (SELECT DISTINCT {FILE} AS f FROM {{orders}}) WHERE f % 3 = 2
UNION ALL SELECT f, CAST(2 AS BIGINT), 'ID', 'Type', 'From_hub', 'To_hub', 'Mass class', 'Hours late', 'State'
FROM (SELECT DISTINCT {FILE} AS f FROM {{orders}}) WHERE f % 3 = 2
"""


def manifest_rows(spark, sf_dir):
    lines = I.spark_view(spark, sf_dir, LINES, "orders")
    cells = F.transform(F.array(*[F.col(f"c{i}") for i in range(7)]), C.normalize_cell)
    return lines.select(
        F.col("f").cast("string").alias("file_id"), "row_idx", cells.alias("cells"), F.lit(7).alias("width")
    )


LONG_SQL = "lines AS ({}), long AS ({})".format(
    I.duck(LINES),
    " UNION ALL ".join(
        f"SELECT CAST(f AS VARCHAR) AS file_id, f, row_idx, {i} AS col, {I.norm_sql(f'c{i}')} AS val FROM lines" for i in range(7)
    ),
)

STATUS_SQL = "CASE WHEN st = 'NaN' THEN 'processing' ELSE lower(st) END"

CANONICAL_SQL = f"""
SELECT CAST(f AS VARCHAR) AS file_id, r + CASE WHEN f % 3 = 2 THEN 3 ELSE 1 END AS row_idx, sid AS shipment_id,
  upper(org) AS origin_hub, upper(dst) AS destination_hub, CASE WHEN mat = '' THEN 'General Cargo' ELSE mat END AS material_type,
  CASE WHEN f % 3 = 2 OR wt = 'heavy' OR wt LIKE '-%' THEN 250.0 ELSE CAST(wt AS DOUBLE) END AS weight_kg,
  CASE WHEN del = '' THEN 0.0 ELSE CAST(del AS DOUBLE) END AS predicted_delay_hours, {STATUS_SQL} AS status
FROM ({I.duck(BODY)}) WHERE r % 97 <> 5
"""

HEADERS_SQL = f"""WITH {LONG_SQL},
h AS (SELECT file_id, coalesce(min(row_idx) FILTER (WHERE contains(lower(val), 'shp-')), 1) AS horizon FROM long GROUP BY file_id),
tok AS (SELECT file_id, col, lower(val) AS t, min(row_idx) AS fr FROM long JOIN h USING (file_id) WHERE row_idx < horizon AND val IS NOT NULL GROUP BY ALL),
nm AS (SELECT file_id, col, string_agg(t, '_' ORDER BY fr) AS name FROM tok GROUP BY ALL)
SELECT h.file_id, horizon, c.col, coalesce(name, concat('unmapped_column_', c.col)) AS name FROM h, (SELECT unnest(range(0, 7)) AS col) c
LEFT JOIN nm ON nm.file_id = h.file_id AND nm.col = c.col"""


def _headers(spark, sf_dir):
    rows = manifest_rows(spark, sf_dir)
    flat = M.flatten_headers(rows, M.header_horizon(rows))
    return flat.select("file_id", "horizon", F.posexplode("headers").alias("col", "name")).withColumn("col", F.col("col").cast("long"))


def _mapping(spark, sf_dir):
    m = M.column_mapping(manifest_rows(spark, sf_dir))
    return m.select("file_id", *[F.col(f"columns.{t}").cast("long").alias(t) for t in SHIPMENT_COLUMNS])


def _rebuilt_report(spark, sf_dir):
    rows = manifest_rows(spark, sf_dir)
    return M.manifest_report(rows, confidences(reconstruct(rows)))


QUERIES: dict[str, Query] = {
    "header_horizon": Query(
        lambda sp, d: M.header_horizon(manifest_rows(sp, d)).select("file_id", "horizon"),
        f"WITH {LONG_SQL} SELECT file_id, coalesce(min(row_idx) FILTER (WHERE contains(lower(val), 'shp-')), 1) AS horizon FROM long GROUP BY file_id",
    ),
    "flatten_headers": Query(_headers, HEADERS_SQL),
    "numeric_columns": Query(
        lambda sp, d: M.profile_columns(manifest_rows(sp, d), M.header_horizon(manifest_rows(sp, d))).select(
            "file_id", F.array_join(F.array_sort("numeric_cols").cast("array<string>"), ",").alias("cols")
        ),
        f"WITH {LONG_SQL}, h AS (SELECT file_id, coalesce(min(row_idx) FILTER (WHERE contains(lower(val), 'shp-')), 1) AS horizon FROM long GROUP BY file_id) "
        "SELECT file_id, string_agg(CAST(col AS VARCHAR), ',' ORDER BY col) AS cols FROM (SELECT file_id, col, avg(CASE WHEN "
        "regexp_matches(regexp_replace(regexp_replace(val, '\\.', ''), '-', ''), '^\\d*$') THEN 1.0 ELSE 0.0 END) AS s "
        "FROM long JOIN h USING (file_id) WHERE row_idx >= horizon AND val IS NOT NULL GROUP BY ALL) WHERE s >= 0.5 GROUP BY file_id",
    ),
    "map_columns": Query(
        _mapping,
        "SELECT CAST(f AS VARCHAR) AS file_id, CAST(0 AS BIGINT) AS shipment_id, CAST(CASE WHEN f % 3 = 2 THEN 2 ELSE 1 END AS BIGINT) AS origin_hub, "
        "CAST(CASE WHEN f % 3 = 2 THEN 3 ELSE 2 END AS BIGINT) AS destination_hub, CAST(CASE WHEN f % 3 = 2 THEN 1 ELSE 3 END AS BIGINT) AS material_type, "
        "CAST(4 AS BIGINT) AS weight_kg, CAST(5 AS BIGINT) AS predicted_delay_hours, CAST(6 AS BIGINT) AS status "
        f"FROM (SELECT DISTINCT {FILE} AS f FROM orders)",
    ),
    "process_manifest": Query(lambda sp, d: M.process_manifest(manifest_rows(sp, d)), CANONICAL_SQL),
    "manifest_report": Query(
        lambda sp, d: M.manifest_report(manifest_rows(sp, d)),
        "SELECT CAST(f AS VARCHAR) AS file_id, count(*) AS rows_in, CAST(sum(CASE WHEN r % 97 = 5 THEN 0 ELSE 1 END) AS BIGINT) AS rows_out, "
        "CAST(sum(CASE WHEN r % 97 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS rows_rejected, CAST(0.88 AS DOUBLE) AS confidence, 1 AS anomalies_repaired "
        f"FROM ({I.duck(BODY)}) GROUP BY f",
    ),
    # confidences come from strategies that compete, which SQL cannot say: tests/test_reconstruct.py compares them
    "manifest_report_rebuilt": Query(_rebuilt_report),
}
