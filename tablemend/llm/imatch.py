"""Document fingerprints by I-Match with randomised lexicons.

Terms are lower-cased words without marks, hashed to ``SLOTS`` slots. The lexicon holds the slots whose document
frequency, counted over all documents, lies within a band: its inverse document frequency is neither common
nor rare. A document keeps its distinct terms of the lexicon, sorts them, and hashes them once for each of
several randomised sub-lexicons, from the whole one to a small share. Equal parts of two fingerprints then tell how
alike two texts are: a smaller sub-lexicon survives more edits.

The lexicon travels as a bitmap of ``SLOTS`` bits (64 KB), whatever the size of the corpus; the slots within the band
number at most (mean distinct terms of a document) / (lower bound of the band).

Rows: NULL text is the empty text. A sub-lexicon that meets no term of a text hashes all its terms instead, so equal
texts have equal fingerprints and texts without common terms are not alike by accident. Repeated ids are ordered by
text; repeated rows are neighbours. The next document of the last is the first; of a single row, itself. NULL ids come
first. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words

SLOTS = 1 << 19
#: share of all documents that a term of the lexicon is in
BAND = (0.004, 0.2)
#: kept 64ths of the lexicon, one sub-lexicon each
KEPT = (64, 32, 16, 8, 4, 4, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1)
_MARKS = ".,;:!?\"'()[]*#$%&|<>"


@dataclass(frozen=True)
class Lexicon:
    """Slots within the band, 64 to a word of the bitmap."""

    words: tuple[int, ...]

    def column(self) -> Column:
        return F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")


def slots(text: Column) -> Column:
    """Distinct term slots of a text."""
    terms = words(F.translate(F.lower(text), _MARKS, ""))
    return F.array_distinct(F.transform(terms, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> Lexicon:
    """Count document frequencies over all documents; the driver gets SLOTS / 64 words at most."""
    n = docs.count()
    counts = docs.select(F.explode(slots(F.coalesce(F.col(text_col), F.lit("")))).alias("slot")).groupBy("slot").count()
    inside = counts.where(F.col("count").between(band[0] * n, band[1] * n))
    packed = inside.groupBy(F.shiftright("slot", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, slot % 64))").alias("bits")
    )
    bitmap = [0] * (SLOTS // 64)
    for row in packed.collect():
        bitmap[row["at"]] = row["bits"]
    return Lexicon(tuple(bitmap))


def fingerprint(text: Column, lexicon: Lexicon) -> Column:
    """One hash for each sub-lexicon, joined by hyphens."""
    bits = lexicon.column()

    def parts(kept: Column, everything: Column) -> Column:
        def part(at: int, share: int) -> Column:
            mine = kept if share == 64 else F.filter(kept, lambda s: F.pmod(F.xxhash64(F.lit(at), s), F.lit(64)) < share)
            return let(
                mine,
                lambda terms: F.hex(
                    F.when(F.size(terms) > 0, F.xxhash64(F.lit(at), terms)).otherwise(
                        F.xxhash64(F.lit(-1 - at), F.sort_array(everything))
                    )
                ),
            )

        return F.concat_ws("-", *[part(at, share) for at, share in enumerate(KEPT)])

    def of(everything: Column) -> Column:
        known = F.filter(everything, lambda s: F.getbit(F.get(bits, F.shiftright(s, 6)), s % 64) == 1)
        return let(F.sort_array(known), lambda kept: parts(kept, everything))

    return F.lower(let(slots(text), of))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts of two fingerprints, 0 to 1."""
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    return F.size(F.filter(pairs, lambda z: z["a"] == z["b"])) / F.lit(float(len(KEPT)))


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Each row with the carried columns of the next row by id (as ``next_*``), after the last the first.

    Rows are cut into ranges of ids by quantiles, four to a shuffle partition. Each range gets a copy of the first
    row of the range after it, so that one window over ranges sees every neighbour.
    """
    spark = docs.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    cuts = docs.agg(F.percentile_approx(id_col, [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0]
    splits = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    ranged = Bucketizer(splits=splits, inputCol="__key", outputCol="__range").transform(docs.withColumn("__key", key))
    firsts = ranged.groupBy("__range").agg(F.min("__key").alias("__key")).orderBy("__range").collect()
    if not firsts:
        borders = spark.createDataFrame([], "__key double, __before double")
    else:
        before = [firsts[-1], *firsts[:-1]]
        borders = spark.createDataFrame(
            [(f["__key"], b["__range"]) for f, b in zip(firsts, before, strict=True)], "__key double, __before double"
        )
    # one row per range, so the broadcast side is bounded by the number of ranges
    guests = (
        ranged.join(F.broadcast(borders), "__key")
        .groupBy("__before")
        .agg(F.min(F.struct(*carried)).alias("g"))
        .select(F.col("__before").alias("__range"), F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), "g.*", F.lit(True).alias("__guest"))
    )
    rows = ranged.select("__range", id_col, *carried, F.lit(False).alias("__guest")).unionByName(guests)
    order = Window.partitionBy("__range").orderBy("__guest", F.col(id_col).asc_nulls_first(), *carried[:1])
    return (
        rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
        .where(~F.col("__guest"))
        .drop("__guest", "__range")
    )


def edited(text: Column, following: Column) -> Column:
    """The text, its last half replaced by as many code points from the start of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame, known: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``fingerprint``, the ``edited`` text and its fingerprint, and both likenesses."""
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    printed = texts.withColumn("__print", fingerprint(F.col("__text"), known))
    pairs = with_next(printed, id_col, ["__text", "__print"]).withColumn(
        "edited", edited(F.col("__text"), F.col("next___text"))
    )
    both = pairs.withColumn("edited_fingerprint", fingerprint(F.col("edited"), known))
    return both.select(
        id_col,
        F.col("__text").alias("text"),
        "edited",
        F.col("__print").alias("fingerprint"),
        "edited_fingerprint",
        likeness(F.col("__print"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("__print"), F.col("next___print")).alias("near_next"),
    )
