"""Row and file profiles: densities, signatures, stability, regions, repeating patterns.

Vocabulary used throughout the package:

* ``rows``    one line of a file: ``file_id, row_idx, cells, width`` plus profile columns;
* ``active``  rows with at least one value, ranked densely by ``seq``.

Searches for patterns compare digests of consecutive rows, see ``span_blocks``; only small counters are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import cells as C, rows as R
from ..functions.scores import clamp
from .blocks import BLOCK_ROWS, with_neighbours, with_rank

MAX_SPAN = 15
MIN_SHARE = 0.6


def profile_rows(raw_rows: DataFrame) -> DataFrame:
    """Profile every row. ``raw_rows`` needs ``file_id, row_idx, cells, width``."""
    cells, width = F.col("cells"), F.col("width")
    # in steps, so that each reads what the one before has made, and nothing is made twice
    read = raw_rows.withColumns(
        {"_present": R.non_blank(cells), "_classes": F.transform(cells, C.classify_normalized)}
    ).withColumn("_facts", R.label_facts(F.col("_present")))
    counted = read.withColumns(R.counted_columns(cells, F.col("_present"), F.col("_classes"), width)).withColumns(
        {
            "anchor_share": R.anchor_density(F.col("_facts")),
            "label_likelihood": R.label_likelihood(F.col("_facts")),
            "header_words": R.header_word_hits(F.col("_facts")),
        }
    )
    return (
        counted.withColumns(R.ratio_columns())
        .withColumns(
            {
                "header_confidence": R.header_confidence(width),
                "is_label": R.is_label_row(F.col("anchor_share"), F.col("label_likelihood")),
            }
        )
        .drop("_present", "_classes", "_facts", "letters", "distinct")
    )


def active_rows(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Non-empty rows with ``seq``, the signature of the next one, if rows have one, and the place of the one before."""
    kept = [c for c in ("signature", "cells", "width", "anchor_share", "is_label") if c in rows.columns]
    present = rows.filter(F.col("non_null_count") > 0).select("file_id", "row_idx", *kept)
    ranked = with_rank(present, ["file_id"], "row_idx", "seq", block_rows)
    return with_neighbours(
        ranked,
        ["file_id"],
        "seq",
        before=1,
        after=1,
        columns=lambda w: {
            **({"next_signature": F.lead("signature").over(w)} if "signature" in kept else {}),
            "prev_row_idx": F.lag("row_idx").over(w),
        },
        block_rows=block_rows,
    )


def row_similarity(active: DataFrame) -> DataFrame:
    """Mean similarity of consecutive active rows per file."""
    following = F.col("next_signature")
    step = R.similarity(F.col("signature"), following)
    return active.groupBy("file_id").agg(
        F.coalesce(F.avg(F.when(following.isNotNull(), step)), F.lit(0.0)).alias("row_similarity_stability"),
        F.count("*").alias("n_active"),
    )


def span_blocks(
    active: DataFrame, max_span: int = MAX_SPAN, keep: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every complete block of 2..max_span consecutive rows, by digest.

    A signature is known by two hashes. Those of the rows behind a row stand beside it only inside this operator, in one
    narrow window; rows never carry the signatures of others. A block that starts at ``seq`` belongs to the chunking with
    offset ``seq % span``, so each start yields one row per span, not one per offset.
    """
    code = F.struct(F.xxhash64("signature").alias("a"), F.xxhash64(F.lit("|"), "signature").alias("b"))
    near = with_neighbours(
        active.select("file_id", "seq", *keep, code.alias("code")),
        ["file_id"],
        "seq",
        before=0,
        after=max_span - 1,
        columns=lambda w: {"codes": F.collect_list("code").over(w.rowsBetween(0, max_span - 1))},
        block_rows=block_rows,
    )
    spans = F.sequence(F.lit(2), F.greatest(F.size("codes"), F.lit(2)))
    return (
        near.filter(F.size("codes") >= 2)
        .select("file_id", "seq", *keep, "codes", F.explode(spans).alias("span"))
        .withColumn("codes", F.slice("codes", F.lit(1), F.col("span")))
        .select(
            "file_id",
            "seq",
            *keep,
            "span",
            (F.col("seq") % F.col("span")).cast("int").alias("offset"),
            # a 128-bit digest in two longs: fixed width, cheap to sort and to group by
            F.xxhash64("codes").alias("block"),
            F.xxhash64(F.lit("|"), "codes").alias("block2"),
        )
    )


def span_shares(active: DataFrame, max_span: int = MAX_SPAN) -> DataFrame:
    """Share of the most common block for every (file, span, offset)."""
    counts = (
        span_blocks(active, max_span)
        .groupBy("file_id", "span", "offset", "block", "block2")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    )
    return (
        counts.groupBy("file_id", "span", "offset")
        .agg(
            F.sum("n").alias("blocks"),
            F.max(F.struct("n", (-F.col("first_seq")).alias("neg_first"))).alias("top"),
        )
        .select(
            "file_id", "span", "offset", "blocks",
            (F.col("top.n") / F.col("blocks")).alias("share"),
            (-F.col("top.neg_first")).alias("first_seq"),
        )
    )


def repeating_pattern(active: DataFrame, shares: DataFrame | None = None, max_span: int = MAX_SPAN) -> DataFrame:
    """Smallest span, then offset, whose most common block makes up over 60 %.

    Gives ``file_id, span, offset, first_seq, zero_share``; ``zero_share`` is the
    share at offset 0 of the same span. Files without a pattern are absent.
    """
    shares = span_shares(active, max_span) if shares is None else shares
    zero = F.max(F.when(F.col("offset") == 0, F.col("share")))
    # a span counts only when two whole spans fit the file: offset 0 then has >= 2 blocks
    per_span = shares.groupBy("file_id", "span").agg(
        F.min(
            F.when(
                (F.col("blocks") >= 2) & (F.col("share") > MIN_SHARE),
                F.struct("offset", "first_seq"),
            )
        ).alias("hit"),
        zero.alias("zero_share"),
        F.max(F.when(F.col("offset") == 0, F.col("blocks"))).alias("zero_blocks"),
    )
    return (
        per_span.filter(F.col("hit").isNotNull() & (F.col("zero_blocks") >= 2))
        .groupBy("file_id")
        .agg(F.min(F.struct("span", "hit", "zero_share")).alias("p"))
        .select("file_id", "p.span", "p.hit.offset", "p.hit.first_seq", "p.zero_share")
    )


def pattern_signatures(active: DataFrame, pattern: DataFrame) -> DataFrame:
    """The signatures of the repeating block itself."""
    places = pattern.select(
        "file_id", "span", F.explode(F.sequence(F.col("first_seq"), F.col("first_seq") + F.col("span") - 1)).alias("seq")
    )
    # at most MAX_SPAN rows of a file
    return (
        active.select("file_id", "seq", "signature")
        .join(places, ["file_id", "seq"])
        .groupBy("file_id", "span")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "signature")))["signature"].alias("pattern"))
    )


def table_regions(rows: DataFrame, min_density: float = 0.05, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of at least two neighbouring populated rows."""
    populated = rows.filter(F.col("non_null_count") / F.col("width") > min_density).select("file_id", "row_idx")
    ranked = with_rank(populated, ["file_id"], "row_idx", "rank", block_rows)
    return (
        ranked.groupBy("file_id", (F.col("row_idx") - F.col("rank")).alias("island"))
        .agg(F.min("row_idx").alias("start"), F.max("row_idx").alias("end"))
        .filter(F.col("end") > F.col("start"))
        .drop("island")
    )


def cell_totals(rows: DataFrame) -> DataFrame:
    """Per-file sums over rows; the entropy needs only sum(d) and sum(d*log2 d)."""
    d = F.col("non_null_count") / F.col("width")
    dates = F.length("signature") - F.length(F.replace("signature", F.lit("D"), F.lit("")))
    return rows.groupBy("file_id").agg(
        F.count("*").alias("total_rows"),
        F.max("width").alias("total_columns"),
        F.sum("non_null_count").alias("n_values"),
        F.sum("text_count").alias("n_text"),
        F.sum("numeric_count").alias("n_numeric"),
        F.sum(dates).alias("n_dates"),
        F.sum(d).alias("sum_d"),
        F.sum(F.when(d > 0, d * F.log2(d)).otherwise(0.0)).alias("sum_dlogd"),
    )


def dataset_profile(rows: DataFrame, active: DataFrame) -> DataFrame:
    """One row per file; files without any value keep zero stability."""
    cells = F.col("total_rows") * F.col("total_columns")
    share = lambda n: F.when(F.col("n_values") > 0, F.col(n) / F.col("n_values")).otherwise(0.0)
    totals = cell_totals(rows).withColumns(
        {
            "row_density": F.when(cells > 0, F.col("n_values") / cells).otherwise(0.0),
            "text_ratio": share("n_text"),
            "numeric_ratio": share("n_numeric"),
            "datetime_ratio": share("n_dates"),
            "structural_entropy": F.when(
                F.col("sum_d") > 0, F.log2("sum_d") - F.col("sum_dlogd") / F.col("sum_d")
            ).otherwise(0.0),
        }
    )
    pattern = repeating_pattern(active).select(
        "file_id", F.col("span").alias("repeating_signature_span"), "offset", "first_seq", "zero_share"
    )
    joined = (
        totals.join(row_similarity(active), "file_id", "left")
        .join(pattern, "file_id", "left")
        .fillna(
            {"row_similarity_stability": 0.0, "n_active": 0, "repeating_signature_span": 0}
        )
    )
    stability = F.col("row_similarity_stability")
    likelihood = F.when(F.col("repeating_signature_span") <= 0, stability * 0.5).otherwise(
        clamp(F.col("zero_share") * 0.5 + stability * 0.5)
    )
    entropy_part = F.lit(1.0) - F.least(F.col("structural_entropy") / 4.0, F.lit(1.0))
    return (
        joined.withColumns(
            {
                "null_ratio": F.lit(1.0) - F.col("row_density"),
                "segmentation_likelihood": likelihood,
                "stability_interval": F.struct(
                    F.greatest(F.lit(0.0), stability - 0.15).alias("lo"),
                    F.least(F.lit(1.0), stability + 0.15).alias("hi"),
                ),
            }
        )
        .withColumns(
            {
                "sparsity_score": clamp(F.col("null_ratio")),
                "profile_confidence": clamp(
                    F.col("row_density") * 0.35
                    + stability * 0.25
                    + F.col("segmentation_likelihood") * 0.25
                    + entropy_part * 0.15
                ),
            }
        )
        .drop("sum_d", "sum_dlogd", "n_text", "n_numeric", "n_dates", "offset", "zero_share")
    )
