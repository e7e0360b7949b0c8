"""Scans of messy delimited files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import cells as C
from ..operators.blocks import with_facts
from ..session import cut

#: a folder whose largest file is larger than this is read in splits
WHOLE_BYTES = 64 << 20
TEXT_EXTENSIONS = r"(?i)\.(csv|txt)$"
KNOWN_EXTENSIONS = r"(?i)\.(csv|txt|xlsx|xls)$"


def rows_from_lines(lines: DataFrame, file_id: str = "file_id") -> DataFrame:
    """``(file_id, row_idx, line)`` to ``raw_rows``; line order is given."""
    return lines.select(F.col(file_id).alias("file_id"), "row_idx", C.split_line(F.col("line")).alias("cells"))


def explode_text(texts: DataFrame, file_id: str, text: Column) -> DataFrame:
    """One row per non-blank line of each text, numbered from 0 in file order."""
    lines = F.filter(
        F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda line: C.strip(line) != ""
    )
    return texts.select(
        F.col(file_id).alias("file_id"), F.posexplode(lines).alias("row_idx", "line")
    ).withColumn("row_idx", F.col("row_idx").cast("long"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times of all files below a folder; bytes are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("file_size_bytes"), "modificationTime")
    )


def _admitted_text(spark: SparkSession, path: str, max_bytes: int | None = None, **options) -> DataFrame:
    """Text of the files that admission lets in. Names and sizes are known before reading, so others are not opened."""
    read = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path, **options)
    return read.where(decision(F.col("_metadata.file_path"), F.col("_metadata.file_size"), max_bytes) == "admitted")


def scan_matrix(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Admitted delimited files of a folder, nested ones too, to ``raw_rows(file_id, row_idx, cells)``.

    Small files are each read whole by one task, so their row order needs no shuffle; where
    one is larger than ``WHOLE_BYTES``, files are read in splits.
    """
    admitted = admit(_listed(spark, path)).filter("decision = 'admitted'")
    if (admitted.agg(F.max("file_size_bytes")).first()[0] or 0) > whole_bytes:
        return scan_large_matrix(spark, path)
    texts = _admitted_text(spark, path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), "value")
    return rows_from_lines(explode_text(texts, "file_id", F.col("value")))


def scan_large_matrix(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """As ``scan_matrix`` for files of any size, which Spark reads in splits.

    The order key is (split start, order inside the split); line numbers come
    from one count per split, so no file is gathered anywhere.
    """
    return rows_from_lines(number_lines(_admitted_text(spark, path, max_bytes).select(*line_columns())))


@dataclass(frozen=True)
class Scan:
    """``rows``: raw rows of the files that could be read; ``files``: one row for every file, with what became of it."""

    rows: DataFrame
    files: DataFrame


def scan_admitted(spark: SparkSession, path: str, max_bytes: int | None = None) -> Scan:
    """Scan a folder as admission decides, and account for every file in it.

    ``files`` holds ``path, file_size_bytes, modificationTime, decision, rows_total, status, error_message``. A file is
    ``refused`` by name or size, ``failed`` where its content is binary or nothing could be read from it, else ``read``;
    no file ends the scan of the others. Spark's readers do not list files without a byte.
    """
    raw = cut(scan_large_matrix(spark, path, max_bytes))
    seen = cut(content_of(raw))
    listed = admit(_listed(spark, path), max_bytes).withColumn("path", _plain_path(F.col("path")))
    joined = listed.join(seen.withColumn("path", _plain_path(F.col("file_id"))).drop("file_id"), "path", "left")
    admitted = F.col("decision") == "admitted"
    error = (
        F.when(~admitted, F.col("decision"))
        .when(F.col("rows_total").isNull(), "nothing could be read")
        .when(F.col("is_binary"), "binary content")
    )
    files = joined.withColumns(
        {
            "status": F.when(~admitted, "refused").when(error.isNotNull(), "failed").otherwise("read"),
            "error_message": error,
            "rows_total": F.when(error.isNull(), F.col("rows_total")).otherwise(F.lit(0).cast("long")),
        }
    ).drop("is_binary")
    return Scan(readable(raw, seen), files)


def content_of(raw_rows: DataFrame) -> DataFrame:
    """Per file ``rows_total`` and ``is_binary``: whether a cell holds a NUL character, as no text does."""
    nul = F.exists("cells", lambda c: F.contains(c, F.lit("\x00")))
    return raw_rows.groupBy("file_id").agg(
        F.count("*").alias("rows_total"), F.max(F.coalesce(nul, F.lit(False))).alias("is_binary")
    )


def readable(raw_rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of files that are no binary content."""
    return with_facts(raw_rows, seen.filter("is_binary").select("file_id"), "row_idx", "left_anti")


def _plain_path(path: Column) -> Column:
    """Listing and reading write the scheme of a path with one slash or three, and escape it or not."""
    return F.regexp_replace(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^file:/+", "file:/")


def line_columns() -> list[Column]:
    """What ``number_lines`` needs of a text source that is read line by line."""
    return [
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("value").alias("line"),
    ]


def number_lines(read: DataFrame) -> DataFrame:
    """Lines as read in splits, with their numbers among the non-blank lines of their file."""
    kept = read.withColumn("scan_id", F.monotonically_increasing_id()).filter(C.strip(F.col("line")) != "")
    lines = cut(kept)  # the ids are read twice below and must agree
    splits = lines.groupBy("file_id", "split_start").agg(
        F.count("*").alias("n"), F.min("scan_id").alias("first_id"), F.max("scan_id").alias("last_id")
    )
    before = Window.partitionBy("file_id").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # ids within a split grow in line order; blank lines leave gaps, ranked away per split chunk
    chunk = 1 << 16
    keyed = lines.join(base, ["file_id", "split_start"]).withColumn(
        "chunk", F.floor((F.col("scan_id") - F.col("first_id")) / chunk)
    )
    in_chunk = Window.partitionBy("file_id", "split_start", "chunk").orderBy("scan_id")
    chunk_sizes = keyed.groupBy("file_id", "split_start", "chunk").agg(F.count("*").alias("m"))
    earlier = (
        Window.partitionBy("file_id", "split_start")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = chunk_sizes.select(
        "file_id", "split_start", "chunk", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("carry")
    )
    return (
        keyed.withColumn("rn", F.row_number().over(in_chunk))
        .join(carry, ["file_id", "split_start", "chunk"])
        .withColumn("row_idx", F.col("base") + F.col("carry") + F.col("rn") - 1)
    )


def admit_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One row per file with the decision taken for it; bytes are not read."""
    return admit(_listed(spark, path), max_bytes)


def decision(path: Column, size: Column, max_bytes: int | None = None) -> Column:
    """What becomes of a file, by name and size; files of any size are admitted unless ``max_bytes`` is given."""
    too_large = F.lit(False) if max_bytes is None else size > max_bytes
    return (
        F.when(~path.rlike(KNOWN_EXTENSIONS), "rejected_type")
        .when(too_large, "rejected_size")
        .when(~path.rlike(TEXT_EXTENSIONS), "unsupported")
        .otherwise("admitted")
    )


def admit(listed: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Decide on ``(path, file_size_bytes, ...)`` rows."""
    return listed.withColumn("decision", decision(F.col("path"), F.col("file_size_bytes"), max_bytes))


def with_width(raw_rows: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Add the width of the widest line of each file as ``width``."""
    widths = raw_rows.groupBy(*keys).agg(F.max(F.size("cells")).alias("width"))
    return with_facts(raw_rows, widths, "row_idx", keys=keys)
