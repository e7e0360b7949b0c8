"""Quality of reconstructed tables: alignment, coherence, consistency, score.

Tables are ``file_id, variant, record_id, values``; names are arrays per
(file_id, variant). Nearly every measure is a function of how many values of
each kind a column holds, so a table is scanned once into column counts and the
rest runs on one small row per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cells as C, rows as R
from ..functions.scores import TABLE, clamp, percent
from .blocks import with_facts

KEYS = ["file_id", "variant"]
CLASSES = ["D", "N", "T", "M"]
KINDS = ["datetime", "numeric", "categorical"]


def with_classes(tables: DataFrame) -> DataFrame:
    """Add ``sig``, the classes of the values, so that every value is classified once."""
    return tables if "sig" in tables.columns else tables.withColumn("sig", R.row_signature(F.col("values")))


def column_counts(tables: DataFrame) -> DataFrame:
    """Per (table, column): rows, values, plain numbers and values of each class."""
    cells = with_classes(tables).select(*KEYS, "sig", F.posexplode("values").alias("col", "value"))
    cls = F.substr(F.col("sig"), F.col("col") + 1, F.lit(1))
    # only dates and numbers by class can be plain numbers
    plain = F.when(F.col("cls").isin("D", "N"), C.is_number_text(F.col("value"))).otherwise(False)
    staged = cells.withColumn("cls", cls).select(*KEYS, "col", "value", "cls", plain.alias("plain"))
    return staged.groupBy(*KEYS, "col").agg(
        F.count("*").alias("n"),
        F.count("value").alias("nn"),
        F.sum(F.col("plain").cast("int")).alias("n_plain"),
        *[F.sum((F.col("cls") == k).cast("int")).alias(f"n_{k}") for k in CLASSES],
    )


def column_types(counts: DataFrame) -> DataFrame:
    """numeric when every value is a number, else datetime when every one is a date, else text."""
    kind = (
        F.when(F.col("nn") == 0, "empty")
        .when(F.col("n_plain") == F.col("nn"), "numeric")
        .when(F.col("n_D") == F.col("nn"), "datetime")
        .otherwise("categorical_or_text")
    )
    return counts.withColumn("inferred_type", kind)


def table_columns(counts: DataFrame) -> DataFrame:
    """One row per table: its column counts as an ordered array ``cols``."""
    fields = ["col", "n", "nn", "n_plain", *[f"n_{k}" for k in CLASSES]]
    return counts.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cols"))


def renumber(cols: Column) -> Column:
    """Column counts with ``col`` set to the place in the array."""
    return F.transform(cols, lambda c, i: c.withField("col", i))


def _kind_counts(col: Column) -> dict[str, Column]:
    return {"datetime": col["n_D"], "numeric": col["n_N"], "categorical": col["n_T"] + col["n_M"]}


def default_names(cols: Column) -> Column:
    return F.transform(cols, lambda c: F.concat(F.lit("col_"), c["col"].cast("string")))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def match_sum(kind: Column, col: Column) -> Column:
    """Sum of type matches of a column's values under a header kind."""
    return sum((C.type_match(kind, F.lit(k)) * n for k, n in _kind_counts(col).items()), F.lit(0.0))


def column_fit(kind: Column, col: Column) -> Column:
    """Mean type match of a column under a header kind; 0.5 for an empty column."""
    return F.when(col["nn"] == 0, 0.5).otherwise(match_sum(kind, col) / col["nn"])


def row_fit_sum(kind: Column, col: Column) -> Column:
    return match_sum(kind, col) + (col["n"] - col["nn"]) * 0.5


def _internal_sum(kind: Column, col: Column) -> Column:
    fits = sum((C.internal_match(kind, F.lit(k)) * n for k, n in _kind_counts(col).items()), F.lit(0.0))
    return fits + (col["n"] - col["nn"])


def semantic_alignment(tables: DataFrame) -> DataFrame:
    """Column and row alignment of ``cols`` under ``names`` (both per table)."""
    kinds = F.transform("names", C.header_type)
    staged = tables.withColumn("kinds", kinds)
    fits = F.zip_with("kinds", "cols", column_fit)
    size = F.size("cols")
    n_rows = F.get("cols", F.lit(0))["n"]
    row_mean = _sum(F.zip_with("kinds", "cols", row_fit_sum)) / (size * n_rows)
    return (
        staged.withColumn("column_scores", fits)
        .withColumns(
            {
                "semantic_alignment_score": _sum(F.col("column_scores")) / size,
                "n_misaligned": F.size(F.filter("column_scores", lambda s: s < 0.5)),
                "row_alignment": row_mean,
                "internal_mean": _sum(F.zip_with("kinds", "cols", _internal_sum)) / (size * n_rows),
            }
        )
    )


def shape_report(cols: str = "cols") -> dict[str, Column]:
    """Size, nulls, number columns and signature consistency from column counts."""
    c = F.col(cols)
    values = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["nn"])
    cells = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    filled = F.filter(c, lambda x: x["nn"] > 0)
    modes = F.transform(filled, lambda x: F.greatest(*[x[f"n_{k}"] for k in CLASSES]) / x["nn"])
    return {
        "row_count": F.get(c, F.lit(0))["n"],
        "col_count": F.size(c),
        "null_ratio": F.when(cells > 0, F.lit(1.0) - values / cells).otherwise(1.0),
        "numeric_col_count": F.size(F.filter(filled, lambda x: x["n_plain"] == x["nn"])),
        "signature_consistency": F.when(F.size(filled) > 0, _sum(modes) / F.size(filled)).otherwise(0.0),
    }


def anchor_positions(names: Column) -> Column:
    """First two columns whose names announce an identifier."""
    at = F.filter(
        F.transform(names, lambda n, i: F.when(C.is_anchor_name(n), i)), lambda i: i.isNotNull()
    )
    return F.slice(at, 1, 2)


def anchor_duplicates(tables: DataFrame, keyed: DataFrame) -> DataFrame:
    """Values of the first identifier column that occur more than once."""
    return (
        _anchor_values(tables, keyed)
        .groupBy(*KEYS, "value")
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def _anchor_values(tables: DataFrame, keyed: DataFrame) -> DataFrame:
    return (
        with_facts(tables, keyed.select(*KEYS, "anchor_col"), "record_id", keys=KEYS)
        .select(*KEYS, F.get("values", F.col("anchor_col")).alias("value"))
        .filter("value IS NOT NULL")
    )


def record_coherence(tables: DataFrame, aligned: DataFrame) -> DataFrame:
    """Coherence of each table; ``aligned`` comes from ``semantic_alignment``.

    Only tables with an identifier column are scanned again: their records may
    earn a bonus, and their identifiers are counted.
    """
    keyed = aligned.withColumn("anchor_col", F.get(anchor_positions(F.col("names")), F.lit(0)))
    with_key = keyed.filter("anchor_col IS NOT NULL").select(*KEYS, "anchor_col", "kinds")
    uniqueness = (
        _anchor_values(tables, with_key)
        .groupBy(*KEYS, "value")
        .agg(F.count("*").alias("copies"))
        .groupBy(*KEYS)
        .agg(
            (F.count("*") / F.sum("copies")).alias("anchor_uniqueness"),
            F.sum((F.col("copies") > 1).cast("long")).alias("n_duplicate_anchors"),
        )
    )
    kind_at = lambda i: C.class_type(F.substr(F.col("sig"), i + 1, F.lit(1)))
    per_record = (
        _sum(F.transform("kinds", lambda k, i: C.internal_match(k, kind_at(i)))) / F.size("values")
    )
    bonus = F.when(F.coalesce(C.is_anchor(F.get("values", F.col("anchor_col"))), F.lit(False)), 0.1).otherwise(0.0)
    internal = (
        with_facts(with_classes(tables), with_key, "record_id", keys=KEYS)
        .groupBy(*KEYS)
        .agg(F.avg(F.least(F.lit(1.0), per_record + bonus)).alias("internal_with_key"))
    )
    joined = (
        keyed.join(uniqueness, KEYS, "left")
        .join(internal, KEYS, "left")
        .fillna({"anchor_uniqueness": 1.0, "n_duplicate_anchors": 0})
        .withColumn("internal_coherence", F.coalesce("internal_with_key", "internal_mean"))
    )
    score = F.col("row_alignment") * 0.4 + F.col("anchor_uniqueness") * 0.3 + F.col("internal_coherence") * 0.3
    return joined.withColumn("record_coherence_score", score).drop("internal_with_key")


def validate(tables: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Full report, one row per table. Without ``names`` columns are ``col_i``."""
    cols = table_columns(column_counts(tables))
    if names is None:
        named = cols.withColumn("names", default_names(F.col("cols")))
    else:
        named = cols.join(names.select(*KEYS, "names"), KEYS)
    return report(tables, named)


def report(tables: DataFrame, named: DataFrame) -> DataFrame:
    """Report from column counts at hand; ``named``: keys, names, cols."""
    return record_coherence(tables, semantic_alignment(named)).withColumns(shape_report())


def strategy_score(report: DataFrame) -> DataFrame:
    """Weighted score of a validation report, as ``confidence_score`` (0..100)."""
    null_ratio = F.col("null_ratio")
    semantic = F.when(
        F.col("semantic_alignment_score") < 0.45, F.col("semantic_alignment_score") * 0.5
    ).otherwise(F.col("semantic_alignment_score"))
    signals = {
        "semantic_alignment": semantic,
        "record_coherence": F.col("record_coherence_score"),
        "signature_consistency": F.col("signature_consistency"),
        "row_completeness": F.lit(1.0) - null_ratio * 0.85,
        "null_stability": F.lit(1.0) - null_ratio,
        "datatype_consistency": F.col("numeric_col_count") / F.greatest("col_count", F.lit(1)),
        "anchor_continuity": F.col("anchor_uniqueness"),
        "anomaly_penalty": F.lit(1.0) - F.col("n_duplicate_anchors") * 0.15,
    }
    bounded = {k: clamp(v) for k, v in signals.items()}
    return report.withColumn("confidence_score", percent(TABLE.sum(bounded)))


def row_alignments(tables: DataFrame, names: DataFrame) -> DataFrame:
    """Mean type match of every record."""
    kinds = names.select(*KEYS, F.transform("names", C.header_type).alias("kinds"))
    # one array after the other: inside one lambda a value would be trimmed and classified for every branch
    types = F.transform(F.transform(F.transform("values", C.strip), C.classify_normalized), C.class_type)
    fit = _sum(F.zip_with("kinds", types, lambda k, t: C.type_match(k, F.coalesce(t, F.lit("empty"))))) / F.size("kinds")
    return with_facts(tables, kinds, "record_id", keys=KEYS).select(*KEYS, "record_id", fit.alias("row_alignment"))
