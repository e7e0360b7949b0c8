"""Mapping of the given tables onto the engine's tables.

One SQL text serves both engines: table names stand in braces.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VENDORS = """
SELECT s_suppkey AS id, s_name AS name, s_nationkey % 4 + 1 AS tier FROM {supplier}
"""

HUBS = """
SELECT n_name AS code, CAST(n_nationkey * 7 % 120 - 60 AS DOUBLE) AS lat,
       CAST(n_nationkey * 37 % 340 - 170 AS DOUBLE) AS lng, CAST(n_nationkey AS BIGINT) AS position
FROM {nation}
"""

LOGS = """
SELECT event_id AS id, concat('file_', user_id, '.csv') AS filename,
       CAST(floor(value * 1000) AS BIGINT) AS file_size_bytes,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'processing' ELSE 'success' END AS status,
       CAST(floor(value) AS BIGINT) AS rows_total, CAST(floor(value / 10) AS BIGINT) AS rows_repaired,
       CAST(event_id % 100 AS DOUBLE) / 100 AS reconstruction_confidence, ts AS uploaded_at
FROM {events}
"""

SHIPMENTS = """
SELECT l_orderkey * 100 + l_linenumber AS id, concat('SHP-', l_orderkey, '-', l_linenumber) AS shipment_id,
       CASE WHEN l_suppkey % 10 < 8 THEN l_suppkey ELSE l_suppkey + 1000000000 END AS vendor_id, l_orderkey % 1000 AS ingestion_log_id, p_type AS material_type,
       l_quantity * p_size AS weight_kg,
       CAST((l_orderkey * 7 + l_linenumber * 13) % 300 AS DOUBLE) / 10 AS predicted_delay_hours,
       CASE WHEN l_returnflag = 'R' THEN 'delayed' WHEN l_returnflag = 'A' THEN 'in_transit'
            WHEN l_linestatus = 'O' THEN 'high_delay' ELSE 'delivered' END AS status,
       CASE WHEN sn.n_nationkey < 20 THEN sn.n_name ELSE concat('OFF ', sn.n_name) END AS origin_hub,
       CASE WHEN cn.n_nationkey < 20 THEN cn.n_name ELSE concat('OFF ', cn.n_name) END AS destination_hub, l_shipdate AS departure_date
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
JOIN {nation} sn ON sn.n_nationkey = s_nationkey JOIN {nation} cn ON cn.n_nationkey = c_nationkey
"""

# customers shredded to 3-row records in 16 files
MATRIX = """
SELECT CAST(c_custkey % 16 AS VARCHAR(20)) AS file_id, CAST(floor(c_custkey / 16) AS BIGINT) * 3 + k AS row_idx,
       CASE WHEN k = 0 THEN concat(c_custkey, '') WHEN k = 1 THEN concat(c_nationkey, '') ELSE c_mktsegment END AS c0,
       CASE WHEN k = 0 THEN c_name WHEN k = 1 THEN concat(CAST(c_acctbal AS DECIMAL(18,2)), '') END AS c1
FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table stored in fewer splits than there are cores is spread before heavy row work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spark_view(spark: SparkSession, sf_dir: str, sql: str, spread_out: str | None = None) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    tables = {n: table(spark, sf_dir, n) for n in names}
    if spread_out:
        tables[spread_out] = spread(tables[spread_out])
    return spark.sql(sql, **tables)


def duck(sql: str) -> str:
    """The same text for the oracle: braces dropped."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def vendors(spark, sf_dir):
    return spark_view(spark, sf_dir, VENDORS)


def hubs(spark, sf_dir):
    return spark_view(spark, sf_dir, HUBS)


def logs(spark, sf_dir):
    return spark_view(spark, sf_dir, LOGS)


def shipments(spark, sf_dir):
    return spark_view(spark, sf_dir, SHIPMENTS)


LOGISTICS_CTE = (
    f"vendors AS ({duck(VENDORS)}), hubs AS ({duck(HUBS)}), logs AS ({duck(LOGS)}), "
    f"shipments AS ({duck(SHIPMENTS)})"
)


def with_logistics(body: str) -> str:
    return f"WITH {LOGISTICS_CTE} {body}"


# --- raw matrices ------------------------------------------------------------

BLANKS = "chr(32) || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"

# orders shredded to two sparse rows per record in 32 files, below one header row
ORDER_MATRIX = """
SELECT CAST(o_orderkey % 32 AS VARCHAR(20)) AS file_id, CAST(floor(o_orderkey / 32) AS BIGINT) * 2 + k + 1 AS row_idx,
       CASE WHEN k = 0 THEN concat('ORD-', o_orderkey) END AS c0,
       CASE WHEN k = 0 THEN o_orderpriority END AS c1,
       CASE WHEN k = 1 THEN concat(CAST(o_totalprice AS DECIMAL(18,2)), '') END AS c2,
       CASE WHEN k = 1 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS c3
FROM {orders} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t
UNION ALL
SELECT DISTINCT CAST(o_orderkey % 32 AS VARCHAR(20)) AS file_id, CAST(0 AS BIGINT) AS row_idx,
       'order_id' AS c0, 'priority name' AS c1, 'total price' AS c2, 'order date' AS c3 FROM {orders}
"""

# the customer matrix below three header rows
HEADED_MATRIX = """
SELECT file_id, row_idx + 3 AS row_idx, c0, c1 FROM ({matrix})
UNION ALL
SELECT f.file_id, CAST(k AS BIGINT) AS row_idx,
       CASE WHEN k = 0 THEN 'customer_id' WHEN k = 1 THEN 'nation code' ELSE 'market segment' END AS c0,
       CASE WHEN k = 0 THEN 'customer name' WHEN k = 1 THEN 'account value' END AS c1
FROM (SELECT DISTINCT CAST(c_custkey % 16 AS VARCHAR(20)) AS file_id FROM {customer}) f
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) t
""".replace("{matrix}", MATRIX.replace("c_name", "replace(c_name, 'Customer', 'Acct')"))


def wide_to_rows(df: DataFrame, width: int) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(
        "file_id",
        F.col("row_idx").cast("long").alias("row_idx"),
        F.array(*[f"c{i}" for i in range(width)]).alias("cells"),
        F.lit(width).alias("width"),
    )


def matrix(spark, sf_dir):
    return wide_to_rows(spark_view(spark, sf_dir, MATRIX, "customer"), 2)


def headed_matrix(spark, sf_dir):
    return wide_to_rows(spark_view(spark, sf_dir, HEADED_MATRIX, "customer"), 2)


def order_matrix(spark, sf_dir):
    return wide_to_rows(spark_view(spark, sf_dir, ORDER_MATRIX, "orders"), 4)


def doc_rows(spark, sf_dir):
    """Lines of every document as the rows of one file each."""
    from pyspark.sql import functions as F

    from tablemend.sources import files

    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("file_id"), "text")
    rows = files.rows_from_lines(files.explode_text(docs, "file_id", F.col("text")))
    return files.with_width(rows)


NA_SQL = ", ".join(
    f"'{t}'"
    for t in [
        "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
        "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
    ]
)

NUMBER_SQL = r"'^[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
NONFINITE_SQL = "'^[+-]?(inf|infinity|nan)$'"
ISO_SQL = r"'^\d{4}-\d{2}-\d{2}([ T]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$'"
ANCHOR_SQL = (
    r"'^((TXN|ORD|INV|CUST|STU)[_-][A-Z0-9]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)'"
)


def strip_sql(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def norm_sql(x: str) -> str:
    return f"CASE WHEN {strip_sql(x)} NOT IN ('', {NA_SQL}) THEN {strip_sql(x)} END"


def number_sql(x: str) -> str:
    """Expects a trimmed text."""
    return f"(regexp_matches({x}, {NUMBER_SQL}) OR regexp_matches({x}, {NONFINITE_SQL}, 'i'))"


def class_sql(x: str) -> str:
    iso = (
        f"CASE WHEN regexp_matches({x}, {ISO_SQL}) THEN substr({x}, 1, 10) "
        f"WHEN regexp_matches({x}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN concat(split_part({x}, '/', 3), '-', "
        f"lpad(split_part({x}, '/', 1), 2, '0'), '-', lpad(split_part({x}, '/', 2), 2, '0')) "
        f"WHEN regexp_matches({x}, '^\\d{{8}}$') THEN concat(substr({x}, 1, 4), '-', substr({x}, 5, 2), '-', substr({x}, 7, 2)) "
        f"WHEN regexp_matches({x}, '^\\d{{4}}$') THEN concat({x}, '-01-01') END"
    )
    is_date = (
        f"(coalesce(TRY_CAST(({iso}) AS DATE) IS NOT NULL AND TRY_CAST(substr({iso}, 1, 4) AS INT) BETWEEN 1678 AND 2262, false) "
        f"OR regexp_matches({x}, '^([01]?\\d|2[0-3]):[0-5]\\d(:[0-5]\\d)?$'))"
    )
    bare = strip_sql(f"replace(replace({x}, ',', ''), '$', '')")
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'E' WHEN regexp_matches({x}, '^\\d') AND {is_date} THEN 'D' "
        f"WHEN {number_sql(bare)} THEN 'N' WHEN regexp_matches({x}, '\\p{{L}}') THEN 'T' ELSE 'M' END"
    )


DOC_CELLS = f"""
lines AS (SELECT file_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS row_idx FROM (
  SELECT CAST(doc_id AS VARCHAR) AS file_id, list_filter(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)),
         lambda l: {strip_sql('l')} <> '') AS ls FROM documents)),
parts AS (SELECT file_id, row_idx, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS col_idx FROM (
  SELECT file_id, row_idx, regexp_split_to_array(line, '[\\t,;|]') AS ps FROM lines)),
cells AS (SELECT file_id, row_idx, col_idx, {norm_sql('part')} AS val FROM parts)
"""


def wide_cells(sql: str, width: int) -> str:
    legs = " UNION ALL ".join(
        f"SELECT file_id, row_idx, CAST({i} AS BIGINT) AS col_idx, c{i} AS val FROM wide" for i in range(width)
    )
    return f"wide AS ({duck(sql)}), cells AS ({legs})"


MATRIX_CELLS = wide_cells(MATRIX, 2)
HEADED_CELLS = wide_cells(HEADED_MATRIX, 2)
ORDER_CELLS = wide_cells(ORDER_MATRIX, 4)

PROFILE_CTE = f"""
classed AS (SELECT *, {class_sql('val')} AS cls FROM cells),
widths AS (SELECT file_id, max(col_idx) + 1 AS width FROM cells GROUP BY file_id),
sigs AS (SELECT file_id, row_idx, concat(string_agg(cls, '' ORDER BY col_idx), repeat('E', CAST(any_value(width) - count(*) AS BIGINT))) AS signature,
         count(val) AS nn, count(*) AS n_cells FROM classed JOIN widths USING (file_id) GROUP BY file_id, row_idx),
act AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) - 1 AS seq,
        count(*) OVER (PARTITION BY file_id) AS n_active FROM sigs WHERE nn > 0)
"""


def similarity_sql(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = {b} THEN 1.0 ELSE CAST(list_sum(list_transform(range(1, CAST(least(length({a}), length({b})) AS BIGINT) + 1), "
        f"lambda i: CASE WHEN substr({a}, i, 1) = substr({b}, i, 1) THEN 1 ELSE 0 END)) AS DOUBLE) / greatest(length({a}), length({b})) END)"
    )


def with_cells(source: str, body: str) -> str:
    return f"WITH {source}, {PROFILE_CTE} {body}"
