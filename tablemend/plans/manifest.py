"""Shipment manifests: any columns, any header height, onto the canonical schema.

All decisions are made on one small row per file. The manifest's own rows are
read twice, once for header cells and column statistics and once for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cells as C, values as V
from ..operators.blocks import with_facts
from ..sources.tables import SHIPMENT_COLUMNS

MARKER = "shp-"
PASS_THROUGH_CONFIDENCE = 0.88

# Names accepted for each canonical column, in matching order.
ALIASES = {
    "shipment_id": ["id", "shipment_id", "shipment", "tracking", "ident", "uid"],
    "origin_hub": ["source_terminal", "from_hub", "origin_hub", "origin", "source", "origin_terminal"],
    "destination_hub": [
        "target_terminal", "to_hub", "destination_hub", "destination", "target", "target_terminal",
    ],
    "material_type": ["cargo_details", "material_type", "commodity", "type", "cargo", "cargo_class"],
    "weight_kg": ["physical_specifications", "weight_kg", "mass", "kg", "weight", "vol", "m3_vol"],
    "predicted_delay_hours": [
        "expected_hours", "predicted_delay_hours", "hours", "delay", "disruption_index",
    ],
    "status": ["condition", "status", "state", "tracking_state"],
}

NUMERIC_TARGETS = ("weight_kg", "predicted_delay_hours")


def header_horizon(raw_rows: DataFrame, marker: str = MARKER) -> DataFrame:
    """Number of header rows per file: index of the first row with the marker, else 1."""
    text = F.lower(F.array_join("cells", " "))
    first = F.min(F.when(F.contains(text, F.lit(marker)), F.col("row_idx")))
    return raw_rows.groupBy("file_id").agg(
        F.coalesce(first, F.lit(1)).alias("horizon"), F.max("width").alias("width")
    )


def _cells_long(raw_rows: DataFrame, *keep: str) -> DataFrame:
    return raw_rows.select("file_id", "row_idx", *keep, F.posexplode("cells").alias("col", "value")).filter(
        "value IS NOT NULL"
    )


def flatten_headers(raw_rows: DataFrame, horizon: DataFrame) -> DataFrame:
    """One row per file with ``headers``: the distinct tokens of each column, joined by ``_``.

    Tokens are made distinct before they are gathered, so even a file with a
    very deep header moves each token once.
    """
    top = _cells_long(with_facts(raw_rows, horizon.drop("width"), "row_idx").filter("row_idx < horizon"))
    tokens = (
        top.groupBy("file_id", "col", F.lower(C.strip(F.col("value"))).alias("token"))
        .agg(F.min("row_idx").alias("first_row"))
        .groupBy("file_id", "col")
        .agg(F.array_sort(F.collect_list(F.struct("first_row", "token"))).alias("tokens"))
        .select("file_id", "col", F.array_join(F.transform("tokens", lambda t: t["token"]), "_").alias("name"))
    )
    named = tokens.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "name"))).alias("names"))
    columns = F.sequence(F.lit(0), F.col("width") - 1)
    name_of = lambda i: F.coalesce(
        F.try_element_at("names", i), F.concat(F.lit("unmapped_column_"), i.cast("string"))
    )
    return horizon.join(named, "file_id", "left").select(
        "file_id", "horizon", "width", F.transform(columns, name_of).alias("headers")
    )


def map_aliases(files: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Add ``mapped``, one column index per target or -1: the first free exact match,
    else the first free column whose name contains an alias.

    The picks made so far are the state of one fold over the targets.
    """
    targets = F.array(*[F.array(*[F.lit(w) for w in words]) for words in aliases.values()])
    positions = F.sequence(F.lit(0), F.size("headers") - 1)

    def pick(picked: Column, words: Column) -> Column:
        name = lambda i: F.lower(F.get("headers", i))
        free = F.filter(positions, lambda i: ~F.array_contains(picked, i))
        exact = F.filter(free, lambda i: F.array_contains(words, name(i)))
        partial = F.filter(free, lambda i: F.exists(words, lambda w: F.contains(name(i), w)))
        return F.coalesce(F.get(exact, F.lit(0)), F.get(partial, F.lit(0)), F.lit(-1))

    none = F.array().cast("array<int>")
    fold = F.aggregate(targets, none, lambda picked, words: F.concat(picked, F.array(pick(picked, words))))
    return files.withColumn("mapped", fold)


def is_metric_text(value: Column) -> Column:
    """Digits once one dot and one minus are removed; nothing left counts too."""
    text = C.strip(value)
    without_dot = F.regexp_replace(text, r"^([^.]*)\.", "$1")
    without_minus = F.regexp_replace(without_dot, r"^([^-]*)-", "$1")
    return without_minus.rlike(r"^\d*$")


def profile_columns(raw_rows: DataFrame, horizon: DataFrame) -> DataFrame:
    """``numeric_cols`` per file: columns of the data rows that are at least half numeric."""
    data = _cells_long(with_facts(raw_rows, horizon.select("file_id", "horizon"), "row_idx").filter("row_idx >= horizon"))
    return (
        data.groupBy("file_id", "col")
        .agg(F.avg(is_metric_text(F.col("value")).cast("double")).alias("share"))
        .filter("share >= 0.5")
        .groupBy("file_id")
        .agg(F.collect_set("col").alias("numeric_cols"))
    )


def auto_allocate(files: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Give columns nobody claimed to targets nobody filled, in order.

    Needs ``mapped``, ``headers`` and ``numeric_cols``; adds ``columns``
    (target to column index, NULL when nothing was left).
    """
    positions = F.sequence(F.lit(0), F.size("headers") - 1)
    unclaimed = F.filter(positions, lambda i: ~F.array_contains("mapped", i))
    numeric = F.coalesce("numeric_cols", F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    start = F.struct(
        F.filter(unclaimed, lambda i: F.array_contains(numeric, i)).alias("numbers"),
        F.filter(unclaimed, lambda i: ~F.array_contains(numeric, i)).alias("texts"),
        none.alias("picks"),
    )
    wants = F.array(*[F.lit(t in NUMERIC_TARGETS) for t in aliases])
    targets = F.arrays_zip(F.col("mapped").alias("mapped"), wants.alias("metric"))
    rest = lambda pool: F.slice(pool, F.lit(2), F.greatest(F.size(pool) - 1, F.lit(0)))

    def step(state: Column, target: Column) -> Column:
        claimed = target["mapped"] >= 0
        has_number, has_text = F.size(state["numbers"]) > 0, F.size(state["texts"]) > 0
        use_number = ~claimed & has_number & (target["metric"] | ~has_text)
        use_text = ~claimed & has_text & (~target["metric"] | ~has_number)
        choice = (
            F.when(claimed, target["mapped"])
            .when(use_number, F.get(state["numbers"], F.lit(0)))
            .when(use_text, F.get(state["texts"], F.lit(0)))
        )
        return F.struct(
            F.when(use_number, rest(state["numbers"])).otherwise(state["numbers"]).alias("numbers"),
            F.when(use_text, rest(state["texts"])).otherwise(state["texts"]).alias("texts"),
            F.concat(state["picks"], F.array(choice)).alias("picks"),
        )

    picks = F.aggregate(targets, start, step, lambda state: state["picks"])
    named = F.struct(*[F.get("_picks", F.lit(i)).alias(t) for i, t in enumerate(aliases)])
    return files.withColumn("_picks", picks).withColumn("columns", named).drop("_picks")


def column_mapping(raw_rows: DataFrame) -> DataFrame:
    """One row per file: ``horizon, headers, mapped, columns``."""
    horizon = header_horizon(raw_rows)
    named = map_aliases(flatten_headers(raw_rows, horizon))
    return auto_allocate(named.join(profile_columns(raw_rows, horizon), "file_id", "left"))


def project_canonical(raw_rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Data rows with the seven canonical columns, still as text."""
    picked = [
        F.coalesce(
            F.get("cells", F.col(f"columns.{t}")),
            F.when(F.col(f"columns.{t}").isNull(), F.lit("0.0" if t in NUMERIC_TARGETS else "")),
        ).alias(t)
        for t in SHIPMENT_COLUMNS
    ]
    return (
        with_facts(raw_rows, mapping.select("file_id", "horizon", "columns"), "row_idx")
        .filter("row_idx >= horizon")
        .select("file_id", "row_idx", *picked)
    )


def clean_rows(canonical: DataFrame) -> DataFrame:
    """Reject rows without a record id and clean every value."""
    return canonical.filter(V.is_record_id(F.col("shipment_id"))).select(
        "file_id",
        "row_idx",
        C.strip(F.col("shipment_id")).alias("shipment_id"),
        V.clean_hub(F.col("origin_hub")).alias("origin_hub"),
        V.clean_hub(F.col("destination_hub")).alias("destination_hub"),
        V.clean_material(F.col("material_type")).alias("material_type"),
        V.to_weight(F.col("weight_kg")).alias("weight_kg"),
        V.to_delay(F.col("predicted_delay_hours")).alias("predicted_delay_hours"),
        V.clean_status(F.col("status")).alias("status"),
    )


def process_manifest(raw_rows: DataFrame) -> DataFrame:
    """``raw_rows(file_id, row_idx, cells, width)`` to clean canonical shipments."""
    return clean_rows(project_canonical(raw_rows, column_mapping(raw_rows)))


def manifest_report(raw_rows: DataFrame, confidences: DataFrame | None = None) -> DataFrame:
    """Row balance and confidence per file: rows_in = rows_out + rows_rejected.

    ``confidences(file_id, confidence)`` comes from table reconstruction where
    that was run; other files get the pass-through confidence.
    """
    canonical = project_canonical(raw_rows, column_mapping(raw_rows))
    kept = F.when(V.is_record_id(F.col("shipment_id")), 1).otherwise(0)
    out = canonical.groupBy("file_id").agg(
        F.count("*").alias("rows_in"), F.sum(kept).alias("rows_out"), F.sum(1 - kept).alias("rows_rejected")
    )
    if confidences is None:
        found = F.lit(None).cast("double")
    else:
        out, found = out.join(confidences, "file_id", "left"), F.col("confidence")
    fraction = F.coalesce(F.when(found > 1.0, found / 100.0).otherwise(found), F.lit(PASS_THROUGH_CONFIDENCE))
    return out.withColumn("confidence", fraction).withColumn("anomalies_repaired", F.lit(1))
