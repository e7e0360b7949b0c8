"""Queries over stored shipments, vendors, hubs, logs and model runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..sources import dims
from ..sources.tables import STORED_COLUMNS, quality_flags
from .blocks import with_prefix

INTERNAL_COLUMNS = ["vendor_id", "ingestion_log_id"]
INSPECT_COLUMNS = [
    "shipment_id", "origin_hub", "destination_hub", "material_type", "weight_kg",
    "predicted_delay_hours", "status", "vendor_name", "external_id",
]

# a dimension above this many rows is joined by shuffle instead of broadcast
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dimension only after its row count was checked."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


# --- filters and projections -------------------------------------------------


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    return df if not status else df.filter(F.col("status") == status)


def filter_log(df: DataFrame, log_id) -> DataFrame:
    return df if log_id is None else df.filter(F.col("ingestion_log_id") == log_id)


def search_like(df: DataFrame, q: str, ignore_case: bool = True) -> DataFrame:
    """``%q%`` on shipment id or vendor name; wildcards in ``q`` stay wildcards."""
    ids, names = F.col("shipment_id"), F.col("vendor_name")
    pattern = f"%{q}%"
    hit = ids.ilike(pattern) | names.ilike(pattern) if ignore_case else ids.like(pattern) | names.like(pattern)
    return df.filter(hit)


def search_any(df: DataFrame, q: str) -> DataFrame:
    """Case-blind substring over every column."""
    if not q:
        return df
    needle = F.lit(q.lower())
    hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), needle) for c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def with_vendor(df: DataFrame, vendors: DataFrame, real_columns: bool = False) -> DataFrame:
    """Left join to vendors; unmatched rows keep a NULL name."""
    extra = (
        [F.col("tier").alias("vendor_tier"), F.col("country").alias("vendor_country"),
         F.col("reliability_score").alias("vendor_reliability_score")]
        if real_columns
        else []
    )
    names = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"), *extra)
    return df.drop("vendor_name").join(names, "vendor_id", "left")


def project_vendor_consts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "vendor_tier": F.lit("Tier 1"),
            "vendor_country": F.lit("Global"),
            "vendor_reliability_score": F.lit(95.0),
        }
    )


def list_shipments(
    shipments: DataFrame,
    vendors: DataFrame,
    page: int = 1,
    limit: int = 50,
    status: str | None = None,
    q: str | None = None,
    ingestion_log=None,
) -> DataFrame:
    """One page, newest id first. The page is cut before the vendor join unless
    the search itself needs vendor names."""
    page, limit = max(1, int(page)), min(200, max(1, int(limit)))
    rows = filter_log(filter_status(shipments, status), ingestion_log)
    skip = (page - 1) * limit
    ties = ("id", "shipment_id", "departure_date", "weight_kg", "vendor_id", "material_type", "origin_hub")
    order = [F.col(c).desc() for c in ties if c in rows.columns]
    if q:
        rows = search_like(with_vendor(rows, vendors), q)
        cut = rows.orderBy(*order).offset(skip).limit(limit)
    else:
        cut = with_vendor(rows.orderBy(*order).offset(skip).limit(limit), vendors)
    return project_vendor_consts(cut)


def page_info(
    shipments: DataFrame, vendors: DataFrame, page: int = 1, limit: int = 50,
    status: str | None = None, q: str | None = None, ingestion_log=None,
) -> DataFrame:
    page, limit = max(1, int(page)), min(200, max(1, int(limit)))
    rows = filter_log(filter_status(shipments, status), ingestion_log)
    if q:
        rows = search_like(with_vendor(rows, vendors), q)
    total = F.count("*")
    return rows.agg(
        total.alias("total"), F.lit(page).alias("page"), F.lit(limit).alias("limit"),
        F.ceil(total / limit).alias("pages"),
    )


def sort_by(df: DataFrame, key: str | None, direction: str = "asc", tie: str = "id") -> DataFrame:
    if not key:
        return df
    column = F.col(key).asc_nulls_last() if direction == "asc" else F.col(key).desc_nulls_last()
    return df.orderBy(column, F.col(tie))


def get_shipment(df: DataFrame, shipment_id: str) -> DataFrame:
    """Point lookup; of several copies the one with the lowest id."""
    return df.filter(F.col("shipment_id") == shipment_id).orderBy("id").limit(1)


def inspect_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in INSPECT_COLUMNS if c in df.columns])


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*INTERNAL_COLUMNS)


def delete_shipment(df: DataFrame, shipment_row_id) -> DataFrame:
    return df.filter(~F.col("id").eqNullSafe(F.lit(shipment_row_id)))


def constraint_checks(shipments: DataFrame, vendors: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Number of rows that violate each declared constraint, 0 where all hold."""
    of_vendors = {
        "vendor_tier": F.col("tier").between(1, 4),
        "vendor_reliability": F.col("reliability_score").between(0, 100),
    }
    found = _violations(vendors, of_vendors).unionByName(_violations(shipments, shipment_checks(shipments.columns)))
    return found if logs is None else found.unionByName(_violations(logs, {"log_status": log_status_check()}))


def _violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    flags = quality_flags(checks)
    counts = rows.select(flags.alias("flags")).agg(
        *[F.count_if(F.array_contains("flags", name)).alias(name) for name in checks]
    )
    told = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in checks])
    return counts.select(F.explode(told).alias("c")).select("c.*")


def shipment_checks(columns: list[str]) -> dict[str, Column]:
    checks = {"shipment_status": F.col("status").isin("on_time", "minor_delay", "high_delay")}
    if "predicted_delay_risk" in columns:
        checks["delay_risk"] = F.col("predicted_delay_risk").between(0, 1)
    if "original_structure_status" in columns:
        checks["structure_status"] = F.col("original_structure_status").isin(
            "clean", "repaired", "partial", "critical"
        )
    return checks


def log_status_check() -> Column:
    return F.col("status").isin("queued", "processing", "success", "failed")


def confidence_guard(files: DataFrame, minimum: float = 0.85) -> DataFrame:
    """Route each file by its confidence: ``accepted`` or ``review``."""
    enough = F.coalesce(F.col("confidence") >= F.lit(minimum), F.lit(False))
    return files.withColumn("route", F.when(enough, "accepted").otherwise("review"))


def delay_alerts(df: DataFrame, hours: float = 12.0) -> DataFrame:
    delay = F.col("predicted_delay_hours")
    return df.filter(delay > hours).select(
        "id",
        "shipment_id",
        F.lit("critical").alias("type"),
        F.lit("Critical Delivery Delay Risk").alias("title"),
        F.concat(
            F.lit("Shipment "), F.col("shipment_id"), F.lit(" ("),
            F.coalesce("material_type", F.lit(V.DEFAULT_MATERIAL)), F.lit(", "),
            F.coalesce("origin_hub", F.lit("?")), F.lit(" → "), F.coalesce("destination_hub", F.lit("?")),
            F.lit(") predicted delay hours at "), V.fixed_point(delay, 1),
            F.lit(f" hrs exceeds high risk warning threshold (>{hours:g} hrs)."),
        ).alias("description"),
    )


# --- joins -------------------------------------------------------------------


def new_shipments(incoming: DataFrame, existing: DataFrame, dedup: str | None = None) -> DataFrame:
    """Rows with an id that is not stored yet.

    Copies inside the incoming data are kept, unless ``dedup='file'`` keeps the
    first by ``(file_id, row_idx)``. Stored ids are made distinct first: that
    folds the copies of a hot id before the shuffle the join needs anyway.
    """
    fresh = incoming.filter(F.col("shipment_id").isNotNull() & (F.col("shipment_id") != "")).join(
        existing.select("shipment_id").distinct(), "shipment_id", "left_anti"
    )
    if dedup is None:
        return fresh
    order = [c for c in ("file_id", "row_idx") if c in fresh.columns]
    payload = [c for c in fresh.columns if c != "shipment_id"]
    # min over the order key folds map-side, so a hot id does not pile up in one task
    first = fresh.groupBy("shipment_id").agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("r")
    )
    return first.select("shipment_id", "r.*").select(*fresh.columns)


def ingest_defaults(df: DataFrame, legacy_zero: bool = False) -> DataFrame:
    external = F.col("external_id") if "external_id" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "external_id": F.coalesce(F.nullif(external, F.lit("")), F.col("shipment_id")),
            "material_type": V.falsy_to(F.col("material_type"), V.DEFAULT_MATERIAL),
            "weight_kg": V.number_or(F.col("weight_kg"), V.DEFAULT_WEIGHT, legacy_zero),
            "predicted_delay_hours": V.number_or(F.col("predicted_delay_hours"), V.DEFAULT_DELAY),
            "origin_hub": V.falsy_to(F.col("origin_hub"), dims.DEFAULT_ORIGIN),
            "destination_hub": V.falsy_to(F.col("destination_hub"), dims.DEFAULT_DESTINATION),
            "status": V.falsy_to(F.col("status"), "processing"),
        }
    )


def geo_enrich(
    df: DataFrame,
    hubs: DataFrame,
    default_origin: str = dims.DEFAULT_ORIGIN,
    default_destination: str = dims.DEFAULT_DESTINATION,
) -> DataFrame:
    """Coordinates of both hubs; an unknown hub gets those of the default hub."""
    known = small(hubs.select("code", "lat", "lng"))
    defaults = hubs.agg(
        *[
            F.max(F.when(F.col("code") == code, F.col(axis))).alias(f"{side}_{axis}_default")
            for side, code in (("origin", default_origin), ("destination", default_destination))
            for axis in ("lat", "lng")
        ]
    )
    out = df
    for side in ("origin", "destination"):
        located = known.select(
            F.col("code").alias(f"{side}_hub"),
            F.col("lat").alias(f"{side}_lat_known"),
            F.col("lng").alias(f"{side}_lng_known"),
        )
        out = out.join(located, f"{side}_hub", "left")
    # one row: four scalars
    out = out.crossJoin(F.broadcast(defaults))
    for side in ("origin", "destination"):
        found = F.col(f"{side}_lat_known").isNotNull()
        for axis in ("lat", "lng"):
            out = out.withColumn(
                f"{side}_{axis}",
                F.when(found, F.col(f"{side}_{axis}_known")).otherwise(F.col(f"{side}_{axis}_default")),
            )
    return out.drop(
        *[f"{side}_{axis}_{kind}" for side in ("origin", "destination") for axis in ("lat", "lng")
          for kind in ("known", "default")]
    )


def to_stored(
    df: DataFrame, hubs: DataFrame, log_id: Column, legacy_zero: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Canonical rows to the 14 persisted columns, and those of ``keep``."""
    rows = ingest_defaults(df, legacy_zero).withColumns(
        {"vendor_id": F.lit(dims.DEFAULT_VENDOR_ID), "ingestion_log_id": log_id}
    )
    return geo_enrich(rows, hubs).select(*STORED_COLUMNS, *keep)


def shipments_by_log(shipments: DataFrame, logs: DataFrame, how: str = "inner") -> DataFrame:
    keyed = logs.withColumnRenamed("id", "ingestion_log_id")
    if how != "left_semi":
        keyed = keyed.select(
            "ingestion_log_id", "filename", F.col("status").alias("log_status"), "uploaded_at"
        )
    return shipments.join(keyed, "ingestion_log_id", how)


def latest_risk_factors(runs: DataFrame, features: DataFrame) -> DataFrame:
    """Feature weights of the newest model run, by rank."""
    newest = runs.agg(
        F.max_by(F.struct("id", "model_version", F.col("created_at").alias("last_trained_at")),
                 F.struct("created_at", "id")).alias("r")
    ).select(F.col("r.id").alias("model_run_id"), "r.model_version", "r.last_trained_at")
    return (
        features.join(F.broadcast(newest), "model_run_id")  # one row
        .select(
            "rank", F.col("feature_name").alias("feature"), "importance", "category",
            V.truncate_label(F.col("feature_name")).alias("label"),
            V.pct_1dp(F.col("importance").cast("double")).alias("pct"),
            "model_version", "last_trained_at",
        )
        .orderBy("rank")
    )


# --- routes ------------------------------------------------------------------


def routes(shipments: DataFrame, hubs: DataFrame) -> DataFrame:
    """Origin-destination edges with coordinates and display defaults.

    ``hubs`` needs ``position, code, lat, lng``; positions run from 0.
    """
    n = hubs.count()
    by_code = hubs.select("code", "lat", "lng")
    by_position = hubs.select(F.col("position").cast("long").alias("position"), "code")
    row_id = F.coalesce(F.col("id").try_cast("long"), F.lit(0))
    out = shipments
    # a fallback hub is looked up only for rows that lack one
    for side, shift in (("origin", 0), ("destination", 2)):
        slot = F.when(
            F.coalesce(F.col(f"{side}_hub"), F.lit("")) == "", F.pmod(row_id + F.lit(shift), F.lit(n))
        )
        fallback = by_position.select(
            F.col("position").alias(f"{side}_slot"), F.col("code").alias(f"{side}_fallback")
        )
        out = out.withColumn(f"{side}_slot", slot).join(small(fallback), f"{side}_slot", "left")
    ends = {"origin": ("from", 22.5937, 78.9629), "destination": ("to", 24.5937, 80.9629)}
    for side, (name, lat, lng) in ends.items():
        out = out.withColumn(
            f"{name}_hub", F.coalesce(F.nullif(F.col(f"{side}_hub"), F.lit("")), F.col(f"{side}_fallback"))
        )
        located = by_code.select(
            F.col("code").alias(f"{name}_hub"), F.col("lat").alias(f"{name}_l"), F.col("lng").alias(f"{name}_g")
        )
        out = out.join(small(located), f"{name}_hub", "left")
        for axis, found, default in (("lat", f"{name}_l", lat), ("lng", f"{name}_g", lng)):
            given = [F.col(f"{side}_{axis}")] if f"{side}_{axis}" in shipments.columns else []
            out = out.withColumn(f"{name}_{axis}", F.coalesce(*given, F.col(found), F.lit(default)))

    def optional(column: str, default) -> Column:
        present = F.col(column) if column in shipments.columns else F.lit(None)
        return F.coalesce(present, F.lit(default))

    def truthy(column: str, default: float) -> Column:
        value = optional(column, 0.0)
        return F.when(value == 0, F.lit(default)).otherwise(value)

    return out.select(
        F.col("id").cast("string").alias("id"),
        "from_hub", "to_hub", "from_lat", "from_lng", "to_lat", "to_lng",
        V.canon_status_route(F.col("status")).alias("status"),
        F.coalesce(F.nullif(F.col("shipment_id"), F.lit("")), F.concat(F.lit("SHP-"), F.col("id").cast("string"))).alias(
            "shipment_id"
        ),
        V.falsy_to(optional("vendor_name", ""), "Default Vendor").alias("vendor_name"),
        optional("predicted_delay_hours", 0.0).alias("predicted_delay_hours"),
        V.falsy_to(optional("primary_delay_driver", ""), "None").alias("primary_delay_driver"),
        truthy("freight_cost_usd", 4500.0).alias("freight_cost_usd"),
        V.falsy_to(optional("material_type", ""), V.DEFAULT_MATERIAL).alias("material_type"),
    )


def filter_routes(df: DataFrame, status: str = "all") -> DataFrame:
    return df if status == "all" else df.filter(F.col("status") == status)


def valid_coords(df: DataFrame) -> DataFrame:
    """Both endpoints of each route; 0, NaN and missing coordinates are dropped."""
    ends = F.array(
        F.struct(F.lit("from").alias("end"), F.col("from_lat").alias("lat"), F.col("from_lng").alias("lng")),
        F.struct(F.lit("to").alias("end"), F.col("to_lat").alias("lat"), F.col("to_lng").alias("lng")),
    )
    points = df.select("id", F.explode(ends).alias("p")).select("id", "p.*")
    good = lambda c: F.col(c).isNotNull() & (F.col(c) != 0) & ~F.isnan(c)
    return points.filter(good("lat") & good("lng"))


def bounding_box(df: DataFrame) -> DataFrame:
    return valid_coords(df).agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"), F.count("*").alias("n_points"),
    )


def lane_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("from_hub", "to_hub").agg(F.count("*").alias("n_routes"))


# --- aggregates --------------------------------------------------------------


def kpi(shipments: DataFrame, logs: DataFrame) -> DataFrame:
    """Headline numbers: one pass over each table, joined as two single rows."""
    s = shipments.agg(
        F.count("*").alias("total_shipments"),
        F.count(F.when(F.col("status") == "high_delay", 1)).alias("at_risk_deliveries"),
    )
    ok = logs.filter(F.col("status") == "success").agg(
        F.coalesce(F.sum("rows_repaired"), F.lit(0)).cast("long").alias("anomalies_repaired"),
        F.coalesce(F.avg("reconstruction_confidence"), F.lit(0.0)).alias("avg_confidence"),
    )
    return s.crossJoin(F.broadcast(ok)).withColumns(
        {
            "avg_confidence_1dp": V.half_up(F.col("avg_confidence"), 1),
            "avg_confidence_pct": F.col("avg_confidence") * 100,
        }
    )


def ingestion_metrics(logs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Per upload day: ingested files, repaired rows and failed files."""
    day = F.to_date("uploaded_at")
    success = F.col("status") == "success"
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        logs.filter(F.col("uploaded_at") >= since)
        .groupBy(day.alias("date"))
        .agg(
            F.sum(F.when(success, 1).otherwise(0)).alias("ingested"),
            F.sum(F.when(success, F.col("rows_repaired")).otherwise(0)).alias("repaired"),
            F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed"),
        )
        .orderBy("date")
    )


def bracket_counts(df: DataFrame) -> DataFrame:
    """Number of rows each delay filter would show."""
    hours, status = F.col("predicted_delay_hours"), F.col("status")
    return df.agg(
        *[
            F.count(F.when(V.in_bracket(hours, status, b), 1)).alias(f"n_{b}")
            for b in ("all", "on_time", "minor_delay", "high_delay")
        ]
    )


def impute_weight(df: DataFrame, mode: str = "median", default: float = V.DEFAULT_WEIGHT) -> DataFrame:
    """Fill missing or zero weights: median of the material, or a fixed value.

    The exact median is read off per-value counts. Equal weights are folded
    map-side; ranks are summed over 1 kg bins, so a material that holds most
    rows is still spread over many tasks.
    """
    weight = F.col("weight_kg")
    missing = weight.isNull() | (weight == 0)
    if mode == "baseline":
        return df.withColumn("weight_kg_imputed", F.when(missing, F.lit(default)).otherwise(weight))
    if mode != "median":
        raise ValueError(f"unknown mode {mode!r}")
    counts = df.filter(~missing).groupBy("material_type", "weight_kg").agg(F.count("*").alias("n"))
    totals = counts.groupBy("material_type").agg(F.sum("n").alias("total"))
    ranked = with_prefix(counts, ["material_type"], "weight_kg", F.col("n"), "before", block_rows=1).join(
        totals, "material_type"
    )
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    holds = lambda k: (F.col("before") < k) & (F.col("before") + F.col("n") >= k)
    medians = ranked.groupBy("material_type").agg(
        ((F.max(F.when(holds(lower), F.col("weight_kg"))) + F.max(F.when(holds(upper), F.col("weight_kg")))) / 2).alias(
            "median_weight"
        )
    )
    return (
        df.join(medians, "material_type", "left")
        .withColumn(
            "weight_kg_imputed",
            F.when(missing, F.coalesce("median_weight", F.lit(default))).otherwise(weight),
        )
        .drop("median_weight")
    )
