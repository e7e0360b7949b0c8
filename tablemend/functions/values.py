"""Cleaning, canonical statuses and display forms of shipment values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .cells import NON_FINITE, NUMBER, strip

DEFAULT_WEIGHT = 250.0
DEFAULT_DELAY = 0.0
DEFAULT_MATERIAL = "General Cargo"

# Ids that are really left-over header labels.
NOT_RECORD_IDS = ["shipment_id", "expected_sequence", "nan", "", "id", "condition", "uid"]

# Display labels of status codes.
STATUS_LABELS = {
    "success": "Success",
    "processing": "Processing",
    "failed": "Failed",
    "queued": "Queued",
    "on_time": "On Time",
    "minor_delay": "Minor Delay",
    "high_delay": "High Delay Risk",
}


def parse_number(value: Column) -> Column:
    """Plain decimal text to double; NULL for anything else, NaN and infinities included."""
    text = strip(value)
    return F.when(
        text.rlike(NUMBER) & ~text.rlike(NON_FINITE),
        F.replace(text, F.lit("_"), F.lit("")).try_cast("double"),
    )


def _non_negative(value: Column, default: float) -> Column:
    number = parse_number(value)
    return F.when(number >= 0, number).otherwise(F.lit(default))


def to_weight(value: Column) -> Column:
    return _non_negative(value, DEFAULT_WEIGHT)


def to_delay(value: Column) -> Column:
    return _non_negative(value, DEFAULT_DELAY)


def clean_status(value: Column) -> Column:
    low = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("", "nan"), "processing").otherwise(low)


def clean_hub(value: Column) -> Column:
    return F.upper(strip(F.coalesce(value, F.lit(""))))


def clean_material(value: Column) -> Column:
    text = strip(F.coalesce(value, F.lit("")))
    return F.when(text == "", DEFAULT_MATERIAL).otherwise(text)


def is_record_id(value: Column) -> Column:
    return ~F.lower(strip(F.coalesce(value, F.lit("")))).isin(NOT_RECORD_IDS)


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up, towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)) / scale


def norm_confidence(value: Column) -> Column:
    """Percentages become fractions; two decimals; 0.95 when missing or zero."""
    fraction = F.when(value > 1.0, value / 100.0).otherwise(value)
    return F.when(value.isNull() | (value == 0), 0.95).otherwise(half_up(fraction, 2))


def falsy_to(value: Column, default) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def number_or(value: Column, default: float, legacy_zero: bool = False) -> Column:
    kept = F.when(value != 0, value) if legacy_zero else value
    return F.coalesce(kept, F.lit(default))


def canon_status_route(status: Column) -> Column:
    low = F.lower(F.coalesce(status, F.lit("on_time")))
    return (
        F.when(low.isin("failed", "delayed", "high_delay"), "high_delay")
        .when(low == "minor_delay", "minor_delay")
        .otherwise("on_time")
    )


def canon_status_badge(status: Column) -> Column:
    low = F.lower(status)
    return (
        F.when(low.isin("delivered", "on_time", "success"), "success")
        .when(low.isin("delayed", "high_delay", "failed"), "failed")
        .when(low.isin("in_transit", "minor_delay", "processing"), "processing")
        .otherwise("queued")
    )


def in_bracket(hours: Column, status: Column, bracket: str) -> Column:
    """Whether a shipment belongs to a delay bracket; brackets may overlap."""
    h = F.coalesce(hours, F.lit(0.0))
    low = F.lower(F.coalesce(status, F.lit("")))
    if bracket == "all":
        return F.lit(True)
    if bracket == "on_time":
        return (h <= 3) & (low != "failed")
    if bracket == "minor_delay":
        return (h > 3) & (h <= 12)
    if bracket == "high_delay":
        return (h > 12) | low.isin("failed", "high_delay")
    raise ValueError(f"unknown bracket {bracket!r}")


def risk_pct(hours: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(hours * 4 + F.lit(0.5)))).cast("int")


def risk_band(hours: Column) -> Column:
    pct = risk_pct(hours)
    return F.when(pct >= 75, "red").when(pct >= 40, "amber").otherwise("green")


def plain_number(value: Column) -> Column:
    """Shortest display of a number: no trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def format_delay(hours: Column) -> Column:
    days = F.floor(hours / 24).cast("string")
    rest = F.floor(hours % 24 + F.lit(0.5)).cast("string")
    return F.when(hours > 24, F.concat(days, F.lit("d "), rest, F.lit("h"))).otherwise(
        F.concat(plain_number(hours), F.lit(" hrs"))
    )


def fixed_point(value: Column, digits: int) -> Column:
    """Fixed decimals, half up, without thousands separators."""
    return half_up(value, digits).cast(f"decimal(30,{digits})").cast("string")


def format_bytes(size: Column, mb_digits: int = 1, kb_digits: int = 0) -> Column:
    number = size.cast("double")
    return F.when(
        number > 1_000_000, F.concat(fixed_point(number / 1_000_000, mb_digits), F.lit(" MB"))
    ).otherwise(F.concat(fixed_point(number / 1_000, kb_digits), F.lit(" KB")))


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, hh:mm a")


def format_key(key: Column) -> Column:
    spaced = F.regexp_replace(key, r"([a-z])([A-Z])", "$1 $2")
    words = F.transform(
        F.split(spaced, r"_|\s+"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))),
    )
    return (
        F.when(key == "shipment_id", "Shipment ID")
        .when(key == "external_id", "Tracking ID")
        .otherwise(F.array_join(words, " "))
    )


def parse_imputed(value: Column) -> Column:
    """JSON array text to ``array<string>``; anything else is empty."""
    parsed = F.when(strip(value).startswith("["), F.from_json(value, "array<string>"))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def imputed_badge(fields: Column) -> Column:
    """First two names and the number of further ones."""
    return F.struct(
        F.slice(fields, 1, 2).alias("shown"), F.greatest(F.size(fields) - 2, F.lit(0)).alias("more")
    )


def truncate_label(label: Column, limit: int = 28) -> Column:
    return F.when(
        F.length(label) > limit, F.concat(F.substring(label, 1, limit), F.lit("…"))
    ).otherwise(label)


def pct_1dp(importance: Column) -> Column:
    return half_up(importance * 100, 1)


def display_null(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull() | text.isin("", "—"), "Not Provided").otherwise(text)


def short_ext_id(value: Column) -> Column:
    return F.concat(F.substring(F.coalesce(value, F.lit("")), 1, 14), F.lit("..."))


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUS_LABELS.items())])
    return F.try_element_at(labels, status)
