"""Blueprints, row cycles and identifier columns.

A blueprint is held per file as ``bp array<array<int>>``: for each row of a
record the columns that carry values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cells as C, rows as R
from ..functions.scores import clamp
from ..session import cut
from .blocks import BLOCK_ROWS, with_facts, with_neighbours
from .profile import repeating_pattern

MAX_CYCLE = 12
BLOCK_MATCH = 0.72
ANCHOR_MIN = 0.45

# Weights of the signals of one cycle length.
CYCLE_WEIGHTS = {"signature_repeat": 0.45, "width_repeat": 0.30, "cyclic_sim": 0.25}


def header_cells(rows: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Cells of the header rows per file, in order, with the blueprint they imply."""
    picked = header_rows.join(rows.select("file_id", "row_idx", "cells"), ["file_id", "row_idx"])
    return (
        picked.groupBy("file_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "cells"))).alias("h"))
        .select(
            "file_id",
            F.transform("h", lambda x: x["cells"]).alias("header_cells"),
            F.transform("h", lambda x: R.layout(x["cells"])).alias("bp"),
        )
    )


def total_columns(bp: Column) -> Column:
    return F.aggregate(bp, F.lit(0), lambda acc, cols: acc + F.size(cols))


def blueprint_segments(blueprints: DataFrame) -> DataFrame:
    """One row per (file, row offset) with its columns and global positions."""
    before = F.aggregate(
        F.slice("bp", F.lit(1), F.col("offset")), F.lit(0), lambda acc, cols: acc + F.size(cols)
    )
    return (
        blueprints.select("file_id", "bp", F.posexplode("bp").alias("offset", "cols"))
        .withColumns({"width": F.size("cols"), "global_start": before})
        .filter("width > 0")
        .select(
            "file_id", "offset", "cols", "width", "global_start",
            (F.col("global_start") + F.col("width") - 1).alias("global_end"),
        )
    )


def signature_layout(signature: Column) -> Column:
    """Columns that carry a value, read off a signature."""
    n = F.length(signature)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.filter(
            F.transform(
                F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                lambda i: F.when(F.substr(signature, i, F.lit(1)) != "E", i - 1),
            ),
            lambda i: i.isNotNull(),
        )
    )


def extract_headers(bp: Column, header: Column) -> Column:
    """Column names: the header rows read through a blueprint."""

    def name(offset: Column, col: Column) -> Column:
        text = C.header_cell_text(F.get(F.get(header, offset), col))
        return (
            F.when(offset >= F.size(header), F.concat(F.lit("missing_header_"), offset.cast("string")))
            .when(text.isNull() | (text == ""), F.concat_ws("_", F.lit("missing_header"), offset.cast("string"), col.cast("string")))
            .otherwise(text)
        )

    named = F.flatten(F.transform(bp, lambda cols, o: F.transform(cols, lambda c: name(o, c))))
    return F.when(header.isNotNull() & (F.size(header) > 0) & bp.isNotNull(), named).otherwise(
        F.array().cast("array<string>")
    )


# --- identifier columns -------------------------------------------------------


def column_values(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Statistics of every column of the data part, one row per (file, col)."""
    data = (
        with_facts(
            rows.filter("non_null_count > 0").select("file_id", "row_idx", "cells"),
            files.select("file_id", "data_start"),
            "row_idx",
        )
        .filter("row_idx >= data_start")
        .select("file_id", "row_idx", F.posexplode("cells").alias("col", "value"))
        .filter("value IS NOT NULL")
    )
    # one row per distinct value first: patterns are then matched once per value
    values = data.groupBy("file_id", "col", "value").agg(
        F.count("*").alias("n"), F.min("row_idx").alias("first_row")
    )
    staged = values.withColumns(
        {
            "pattern": C.match_anchor(F.col("value")),
            "id_number": (C.classify_cell(F.col("value")) == "N") & C.looks_like_id(F.col("value")),
        }
    )
    names = [name for name, _ in C.ANCHOR_PATTERNS]
    per_pattern = [
        x
        for name in names
        for x in (
            F.sum(F.when(F.col("pattern") == name, F.col("n"))).alias(f"n_{name}"),
            F.min(F.when(F.col("pattern") == name, F.col("first_row"))).alias(f"r_{name}"),
        )
    ]
    grouped = staged.groupBy("file_id", "col").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_distinct"),
        F.sum(F.when(F.col("pattern").isNotNull(), F.col("n")).otherwise(0)).alias("n_pattern"),
        F.sum(F.when(F.col("id_number"), F.col("n")).otherwise(0)).alias("n_id_number"),
        *per_pattern,
    )
    # commonest pattern; of equals the one met first
    contest = F.array_max(
        F.array(
            *[
                F.when(
                    F.col(f"n_{name}").isNotNull(),
                    F.struct(
                        F.col(f"n_{name}").alias("n"), (-F.col(f"r_{name}")).alias("neg"), F.lit(name).alias("name")
                    ),
                )
                for name in names
            ]
        )
    )
    return grouped.select(
        "file_id", "col", "n", "n_distinct", "n_pattern", "n_id_number",
        F.coalesce(contest["name"], F.lit("generic_id")).alias("pattern"),
    )


def anchor_columns(stats: DataFrame, blueprints: DataFrame, names: str | None = None) -> DataFrame:
    """Identifier-like columns of a blueprint with a confidence of at least 0.45.

    ``blueprints`` needs ``file_id, bp`` and, when ``names`` is given, that array column.
    """
    label_array = F.col(names) if names else F.array().cast("array<string>")
    places = (
        blueprint_segments(blueprints.select("file_id", "bp"))
        .select("file_id", "offset", "global_start", F.posexplode("cols").alias("i", "col"))
        .withColumn("global_idx", F.col("global_start") + F.col("i"))
        .join(blueprints.select("file_id", label_array.alias("_names")), "file_id")
        .withColumn(
            "label",
            F.coalesce(F.get("_names", F.col("global_idx")), F.concat(F.lit("col_"), F.col("col").cast("string"))),
        )
    )
    joined = places.join(stats, ["file_id", "col"])
    unique = F.col("n_distinct") / F.col("n")
    share = F.col("n_pattern") / F.col("n")
    confidence = (
        F.when(C.has_anchor_keyword(F.col("label")), 0.35).otherwise(0.0)
        + F.when(F.col("offset") == 0, 0.15).otherwise(0.0)
        + F.when(unique > 0.85, 0.25).when(unique > 0.6, 0.1).otherwise(0.0)
        + F.when(share > 0.5, 0.35).when(share > 0.2, 0.15).otherwise(0.0)
        + F.when((F.col("n_id_number") / F.col("n") > 0.7) & (unique > 0.7), 0.15).otherwise(0.0)
    )
    return (
        joined.withColumn("confidence", F.round(F.least(F.lit(1.0), confidence), 9))
        .filter(F.col("confidence") >= ANCHOR_MIN)
        .select("file_id", "col", "global_idx", "label", "pattern", "confidence", F.col("offset").alias("segment_offset"))
    )


def anchor_summary(anchors: DataFrame) -> DataFrame:
    """Per file: strength and the anchors as a small array."""
    return anchors.groupBy("file_id").agg(
        clamp(F.max("confidence")).alias("anchor_strength"),
        F.collect_list(F.struct("col", "segment_offset", "pattern")).alias("anchors"),
    )


def row_has_anchor(cells: Column, anchors: Column, bp: Column) -> Column:
    """Whether a row carries an identifier in a column of the first record row."""

    def hit(anchor: Column) -> Column:
        value = F.get(cells, anchor["col"])
        usable = (anchor["segment_offset"] == 0) | F.array_contains(F.get(bp, F.lit(0)), anchor["col"])
        whole = (anchor["pattern"] == "generic_id") & C.looks_like_id(value)
        return usable & value.isNotNull() & (C.is_anchor(value) | whole)

    return F.coalesce(F.exists(anchors, hit), F.lit(False))


# --- cycles -------------------------------------------------------------------


def data_rows(active: DataFrame, files: DataFrame) -> DataFrame:
    """Active rows of the data part with position ``j`` and, where they have a signature, the compact one as ``sig``."""
    firsts = (
        with_facts(active.select("file_id", "row_idx", "seq"), files.select("file_id", "data_start"), "seq")
        .filter("row_idx >= data_start")
        .groupBy("file_id")
        .agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_data"))
    )
    data = with_facts(active, firsts, "seq").filter("seq >= first_seq").withColumn("j", F.col("seq") - F.col("first_seq"))
    return data.withColumn("sig", R.compact_signature(F.col("signature"))) if "signature" in data.columns else data


def templates(data: DataFrame) -> DataFrame:
    """Per file ``template``: the signatures of its first ``MAX_CYCLE`` data rows."""
    return (
        data.filter(F.col("j") < MAX_CYCLE)
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_list(F.struct("j", "sig")))["sig"].alias("template"), F.max("n_data").alias("n_data"))
    )


def value_width(signature: Column) -> Column:
    return F.length(F.replace(signature, F.lit("E"), F.lit("")))


def cycle_scores(data: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Score of every cycle length 2..12 per file; files of fewer than 4 rows have none.

    The signatures of the next rows, and of the first ones of the file, stand beside a row only inside this operator, in
    one narrow window, as codes that are compared by bits. Every row then gives a row for each length, which is counted
    where it lies: with the rows of its repetition, whose last ones may be copies from the block behind.
    """
    longest = F.least(F.lit(MAX_CYCLE), F.floor(F.col("n_data") / 2)).cast("int")
    narrow = data.filter("n_data >= 4").select(
        "file_id", "j", "n_data", R.signature_code(F.col("sig")).alias("code"), value_width(F.col("sig")).alias("filled")
    )
    first = F.when(F.col("j") < MAX_CYCLE, F.struct("code", "filled"))
    usable = with_neighbours(
        narrow,
        ["file_id"],
        "j",
        before=0,
        after=MAX_CYCLE,
        columns=lambda w: {
            "nearby": F.collect_list("code").over(w.rowsBetween(0, MAX_CYCLE)),
            "template": F.collect_list(first).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        },
        block_rows=block_rows,
        head=MAX_CYCLE,
        size="n_data",
        copies=True,
    )

    j, n, cycle = F.col("j"), F.col("n_data"), F.col("cycle")
    residue = (j % cycle).cast("int")
    model = F.get("template", residue)
    follows = F.col("_own") & (j + cycle < n)
    # steps of a length are averaged by residue first; how many there are of one is known
    steps = F.floor((n - cycle - 1 - residue) / cycle) + 1
    tried = usable.select("*", F.explode(F.sequence(F.lit(2), longest)).alias("cycle")).select(
        "file_id",
        "_blk",
        "n_data",
        "cycle",
        (j - residue).alias("start"),
        R.code_similarity(F.col("code"), model["code"]).alias("sim"),
        (F.abs(F.col("filled") - model["filled"]) <= 1).alias("same_width"),
        F.when(follows, R.code_similarity(F.col("code"), F.get("nearby", cycle)) / steps).otherwise(0.0).alias("step"),
    )
    repetitions = tried.groupBy("file_id", "_blk", "n_data", "cycle", "start").agg(
        F.sum("sim").alias("sim"), F.min("same_width").alias("same_width"), F.sum("step").alias("step")
    )
    whole = (F.floor(F.col("start") / block_rows) == F.col("_blk")) & (F.col("start") + cycle <= n)
    share = lambda cond: F.avg(F.when(whole, cond.cast("int")))
    scored = repetitions.groupBy("file_id", "cycle").agg(
        share(F.col("sim") / cycle >= BLOCK_MATCH - 1e-12).alias("signature_repeat"),
        share(F.col("same_width")).alias("width_repeat"),
        (F.sum("step") / cycle).alias("cyclic_sim"),
    )
    score = sum((F.col(k) * w for k, w in CYCLE_WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("score", F.round(clamp(score), 9))


def choose_mode(score: Column, strength: Column) -> Column:
    return (
        F.when((score >= 0.55) & (score > strength + 0.15), "periodic")
        .when((strength >= 0.5) & (score < 0.45), "anchor")
        .when((score >= 0.4) & (strength >= 0.4), "hybrid")
        .when(score >= strength, "periodic")
        .otherwise("anchor")
    )


def best_cycle(data: DataFrame, profile: DataFrame) -> DataFrame:
    """Per file ``cycle, score, template`` (signatures of the first data rows).

    Where no cycle reaches 0.45, a repeating signature pattern of the data rows
    takes its place.
    """
    best = (
        cycle_scores(data)
        .filter("score > 0")
        .groupBy("file_id")
        .agg(
            F.max(
                F.struct(
                    "score", (-F.col("cycle")).alias("neg"), "signature_repeat", "width_repeat", "cyclic_sim"
                )
            ).alias("b")
        )
    )
    # materialised, as the weak files are looked up before all are read
    found = cut(
        templates(data).join(best, "file_id", "left").select(
            "file_id", "n_data", "template",
            F.coalesce(-F.col("b.neg"), F.lit(0)).alias("cycle"),
            F.coalesce("b.score", F.lit(0.0)).alias("score"),
            "b.signature_repeat", "b.width_repeat", "b.cyclic_sim",
        )
    )
    weak = found.filter("n_data >= 4 AND (cycle <= 1 OR score < 0.45)").select("file_id")
    again = with_facts(data, weak, "j", "left_semi").select(
        "file_id", F.col("j").alias("seq"), F.col("sig").alias("signature")
    )
    pattern = repeating_pattern(again).select("file_id", F.col("span").alias("pattern_span"))
    likelihood = profile.select("file_id", "segmentation_likelihood")
    return (
        found.join(pattern, "file_id", "left")
        .join(likelihood, "file_id", "left")
        .withColumns(
            {
                "cycle": F.coalesce("pattern_span", "cycle").cast("int"),
                "score": F.when(
                    F.col("pattern_span").isNotNull(), F.greatest("score", "segmentation_likelihood")
                ).otherwise(F.col("score")),
            }
        )
        .drop("pattern_span", "segmentation_likelihood")
    )


def cycle_blueprint(template: Column, cycle: Column) -> Column:
    """Blueprint of the first cycle of data rows."""
    return F.transform(F.slice(template, F.lit(1), F.greatest(cycle, F.lit(0))), signature_layout)


def enhance_blueprints(files: DataFrame, cycles: DataFrame, strengths: DataFrame) -> DataFrame:
    """Let a confident data cycle longer than the header replace the blueprint.

    ``files`` needs ``file_id, bp`` (NULL without header). Adds ``cycle,
    cycle_score, template, mode`` and the resulting ``bp``.
    """
    joined = (
        files.join(cycles.select("file_id", "n_data", "template", "cycle", F.col("score").alias("cycle_score")), "file_id", "left")
        .join(strengths.select("file_id", F.col("anchor_strength").alias("header_strength")), "file_id", "left")
        .fillna({"cycle": 0, "cycle_score": 0.0, "header_strength": 0.0, "n_data": 0})
    )
    mode = choose_mode(F.col("cycle_score"), F.col("header_strength"))
    span = F.coalesce(F.size("bp"), F.lit(1))
    confident = (F.col("cycle") > 1) & (F.col("cycle_score") >= 0.45)
    swap = confident & mode.isin("periodic", "hybrid") & (F.col("cycle") > F.when(F.col("bp").isNull(), 1).otherwise(span))
    return joined.withColumns(
        {
            "periodic_found": confident,
            "bp_from_cycle": swap,
            "bp": F.when(swap, cycle_blueprint(F.col("template"), F.col("cycle"))).otherwise(F.col("bp")),
        }
    )


def validate_periodic(records: DataFrame, cycles: DataFrame) -> DataFrame:
    """Completeness and length stability of records against their cycle.

    ``records``: file_id, record_id, values. ``cycles``: file_id, cycle, score, template.
    """
    filled = F.size(F.filter("values", lambda v: v.isNotNull() & (C.strip(v) != "")))
    expected = F.aggregate(
        F.slice("template", F.lit(1), F.greatest(F.col("cycle"), F.lit(0))), F.lit(0), lambda a, s: a + value_width(s)
    )
    known = cycles.select("file_id", "cycle", F.col("score").alias("periodicity_score"), expected.alias("expected"))
    per = with_facts(
        records.select("file_id", "record_id", filled.alias("filled"), F.size("values").alias("len")), known, "record_id"
    )
    share = F.when(F.col("expected") > 0, F.least(F.lit(1.0), F.col("filled") / F.col("expected"))).otherwise(
        F.col("filled") / F.greatest("len", F.lit(1))
    )
    by_length = per.groupBy("file_id", "len", "cycle", "periodicity_score").agg(
        F.count("*").alias("n"), F.sum(share).alias("s")
    )
    return by_length.groupBy("file_id", "cycle", "periodicity_score").agg(
        (F.col("periodicity_score") >= 0.45).alias("periodic_valid"),
        (F.sum("s") / F.sum("n")).alias("completeness"),
        (F.max("n") / F.sum("n")).alias("length_stability"),
    )
