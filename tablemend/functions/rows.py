"""Expressions over one row, held as ``array<string>`` of normalised cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import cells as C

# Words that mark a cell as a column label.
LABEL_WORDS = [
    "id", "date", "amount", "score", "total", "quantity", "age", "name", "category",
    "status", "description", "price", "value", "type", "index", "guid", "sum",
    "customer", "transaction", "order", "invoice", "payment", "location", "discount",
    "item",
]

# Words counted by the header confidence of a row.
HEADER_WORDS = [
    "id", "date", "amount", "score", "total", "quantity", "age", "name", "category",
    "status", "description", "price", "value", "type", "index", "guid", "sum",
    "customer", "transaction", "order", "payment", "location",
]

# words that mark a label and do not count for a header
LABEL_ONLY_WORDS = [w for w in LABEL_WORDS if w not in HEADER_WORDS]

SHORT_LABEL = r"^[a-zA-Z_][a-zA-Z0-9_\s-]*$"


def non_blank(cells: Column) -> Column:
    return F.filter(cells, lambda c: c.isNotNull())


def is_empty_row(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: c.isNotNull())


def pad_cells(cells: Column, width: Column) -> Column:
    missing = F.greatest(width - F.size(cells), F.lit(0))
    return F.concat(cells, F.array_repeat(F.lit(None).cast("string"), missing))


def row_signature(cells: Column) -> Column:
    """One class per normalised cell."""
    return F.array_join(F.transform(cells, C.classify_normalized), "")


def full_signature(cells: Column, width: Column, signature: Column | None = None) -> Column:
    """Signature over the width of the whole file: short rows end in E; ``signature`` is that of the cells, if known."""
    signature = row_signature(cells) if signature is None else signature
    return F.concat(signature, F.repeat(F.lit("E"), F.greatest(width - F.size(cells), F.lit(0))))


def compact_signature(signature: Column) -> Column:
    stripped = F.rtrim(signature, F.lit("E"))
    return F.when(stripped == "", signature).otherwise(stripped)


def matching_positions(a: Column, b: Column) -> Column:
    # both are cut into characters once: taking them out one by one would count from the start each time
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    return F.when(F.least(F.length(a), F.length(b)) == 0, 0).otherwise(F.size(F.filter(same, lambda s: s)))


def similarity(a: Column, b: Column) -> Column:
    """Share of positions with the same class, over the longer signature."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .otherwise(matching_positions(a, b) / longest)
    )


def similarity_with_length_penalty(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    penalty = F.lit(1.0) - F.abs(F.length(a) - F.length(b)) / longest
    return F.when((a == "") | (b == ""), 0.0).otherwise(similarity(a, b) * penalty)


def layout_similarity(a: Column, b: Column) -> Column:
    """As ``similarity``, but two equal signatures count 1 even when empty."""
    return F.when(a == b, 1.0).otherwise(similarity(a, b))


#: columns of a signature that a long has bits for
PLANE_COLUMNS = 60
CLASSES = "EDNTM"


def signature_code(signature: Column) -> Column:
    """A signature for many comparisons: its length and the classes of its columns as three planes of a bit a column.

    What lies past ``PLANE_COLUMNS`` columns is kept as numbers, one for a class at a column.
    """
    n, near = F.length(signature), F.reverse(F.substr(signature, F.lit(1), F.lit(PLANE_COLUMNS)))
    plane = lambda bits: F.coalesce(F.conv(F.translate(near, CLASSES, bits), 2, 10).cast("long"), F.lit(0).cast("long"))
    tail = F.transform(
        F.sequence(F.lit(PLANE_COLUMNS), F.greatest(n - 1, F.lit(PLANE_COLUMNS))),
        lambda i: i * len(CLASSES) + F.position(F.substr(signature, i + 1, F.lit(1)), F.lit(CLASSES)),
    )
    return F.struct(
        n.alias("n"), plane("10101").alias("a"), plane("01100").alias("b"), plane("00011").alias("c"),
        F.when(n > PLANE_COLUMNS, tail).alias("tail"),
    )


def code_similarity(a: Column, b: Column) -> Column:
    """``layout_similarity`` of two signatures by their codes; no function over arrays of cells is run."""
    shorter, longer = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    near = F.least(shorter, F.lit(PLANE_COLUMNS))
    differ = a["a"].bitwiseXOR(b["a"]).bitwiseOR(a["b"].bitwiseXOR(b["b"])).bitwiseOR(a["c"].bitwiseXOR(b["c"]))
    both = F.call_function("shiftleft", F.lit(1).cast("long"), near) - 1
    far = F.when(shorter > PLANE_COLUMNS, F.size(F.array_intersect(a["tail"], b["tail"]))).otherwise(0)
    return F.when(longer == 0, 1.0).otherwise((near - F.bit_count(differ.bitwiseAND(both)) + far) / longer)


def class_change(before: Column, after: Column) -> Column:
    """Numbers appear where the row above held text, and the class sets differ.

    Arguments are signatures; classes of empty cells do not count.
    """
    kinds = ["D", "N", "T", "M"]
    differs = reduce(
        lambda x, y: x | y, [F.contains(before, F.lit(k)) != F.contains(after, F.lit(k)) for k in kinds]
    )
    has_any = before.rlike("[DNTM]") & after.rlike("[DNTM]")
    return F.coalesce(
        has_any & differs & F.contains(after, F.lit("N")) & F.contains(before, F.lit("T")), F.lit(False)
    )


def layout(cells: Column) -> Column:
    """Indices of the non-blank columns."""
    return F.filter(
        F.transform(cells, lambda c, i: F.when(c.isNotNull(), i)), lambda i: i.isNotNull()
    )


def mask(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.when(c.isNull(), "0").otherwise("1")), "")


def roll(cells: Column, shift: Column) -> Column:
    """Cyclic shift to the right; negative shifts go left."""
    n = F.size(cells)
    s = F.pmod(shift, n)
    return F.when((n == 0) | (s == 0), cells).otherwise(
        F.concat(F.slice(cells, n - s + 1, s), F.slice(cells, F.lit(1), n - s))
    )


def label_facts(present: Column) -> Column:
    """Of every non-blank cell whether it is an identifier, has a word of headers, and its points as a label.

    Every text is searched once: inside one lambda it would be searched again wherever its facts are used.
    """
    read = F.transform(
        present, lambda c: F.struct(c.alias("value"), C.is_anchor(c).alias("anchor"), F.lower(c).alias("low"))
    )
    found = F.transform(
        read, lambda f: f.withField("word", C.contains_any(f["low"], HEADER_WORDS))
    )
    return F.transform(
        found,
        lambda f: F.struct(
            f["anchor"].alias("anchor"),
            f["word"].alias("word"),
            F.when(f["anchor"], 0.0)
            .when(f["word"] | C.contains_any(f["low"], LABEL_ONLY_WORDS), 1.0)
            .when((F.length(f["value"]) < 35) & f["value"].rlike(SHORT_LABEL), 0.5)
            .otherwise(0.0)
            .alias("points"),
        ),
    )


def anchor_density(facts: Column) -> Column:
    hits = F.size(F.filter(facts["anchor"], lambda hit: hit))
    return F.when(F.size(facts) == 0, 0.0).otherwise(hits / F.size(facts))


def label_likelihood(facts: Column) -> Column:
    """Share of cells that read like column labels."""
    points = F.aggregate(facts["points"], F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.size(facts) == 0, 0.0).otherwise(points / F.size(facts))


def is_label_row(density: Column, likelihood: Column) -> Column:
    return (density < 0.25) & (likelihood >= 0.4)


def is_data_row(density: Column, likelihood: Column, signature: Column) -> Column:
    shaped = signature.rlike("[ND]") & F.contains(signature, F.lit("T")) & (likelihood < 0.35)
    return (density >= 0.2) | shaped


def header_word_hits(facts: Column) -> Column:
    return F.size(F.filter(facts["word"], lambda hit: hit))


def counted_columns(cells: Column, present: Column, classes: Column, width: Column) -> dict[str, Column]:
    """What is counted of one row: ``present`` its non-blank cells, ``classes`` those of all its cells."""
    flags = F.transform(cells, lambda c: c.isNotNull())
    # a cell of class T has a letter and is no number, one of class M neither
    told = F.filter(F.arrays_zip(cells.alias("cell"), classes.alias("cls")), lambda x: x["cls"].isin("D", "N", "T"))
    joined = F.array_join(present, "")
    return {
        "non_null_count": F.size(present),
        "text_count": F.size(F.filter(told, lambda x: (x["cls"] == "T") | C.is_text(x["cell"]))),
        "numeric_count": F.size(F.filter(told, lambda x: (x["cls"] != "T") & C.is_numeric(x["cell"]))),
        "letters": F.length(F.regexp_replace(joined, r"[^\p{L}]", "")),
        "total_chars": F.length(joined),
        "first_non_null_pos": (F.array_position(flags, F.lit(True)) - 1).cast("int"),
        "last_non_null_pos": F.when(F.size(present) == 0, -1)
        .otherwise(F.size(cells) - F.array_position(F.reverse(flags), F.lit(True)))
        .cast("int"),
        "distinct": F.size(F.array_distinct(present)),
        "signature": full_signature(cells, width, F.array_join(classes, "")),
    }


def ratio_columns() -> dict[str, Column]:
    """Shares of what ``counted_columns`` counts; an empty row gets zeros."""
    c = F.col
    share = lambda part, whole: F.when(c("non_null_count") == 0, 0.0).otherwise(c(part) / c(whole))
    return {
        "text_ratio": share("text_count", "non_null_count"),
        "numeric_ratio": share("numeric_count", "non_null_count"),
        "alpha_ratio": share("letters", "total_chars"),
        "unique_token_ratio": share("distinct", "non_null_count"),
    }


def header_confidence(width: Column) -> Column:
    """0..100 confidence that a row is a header, from its profile columns.

    Expects the columns of ``counted_columns`` and ``ratio_columns`` plus
    ``header_words`` and ``anchor_share``.
    """
    c = F.col
    total = F.length("signature")
    count_of = lambda k: total - F.length(F.replace(c("signature"), F.lit(k), F.lit("")))
    text = F.when(c("text_ratio") > 0.8, 0.30).when(c("text_ratio") > 0.5, 0.15).otherwise(0.0)
    numeric = F.when(c("numeric_ratio") < 0.1, 0.20).when(c("numeric_ratio") > 0.5, -0.35).otherwise(0.0)
    unique = F.when(c("unique_token_ratio") > 0.9, 0.15).otherwise(0.0)
    words = F.least(F.lit(0.30), c("header_words") * F.lit(0.10))
    mean_length = c("total_chars") / c("non_null_count")
    short = F.when(mean_length < 15, 0.10).when(mean_length > 25, -0.10).otherwise(0.0)
    density = F.when(c("non_null_count") / width > 0.3, 0.10).otherwise(0.0)
    sig_text = F.when(count_of("T") / total > 0.6, 0.15).otherwise(0.0)
    sig_date = F.when(count_of("D") > 1, -0.25).otherwise(0.0)
    sig_numeric = F.when((count_of("N") > 0) & (c("numeric_ratio") > 0.4), -0.20).otherwise(0.0)
    anchors = F.when(c("anchor_share") >= 0.2, -0.40).otherwise(0.0)
    raw = text + numeric + unique + words + short + density + sig_text + sig_date + sig_numeric + anchors
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100.0))
    # float addition of tenths leaves noise that would flip the >= 25 / >= 35 cuts
    return F.when(c("non_null_count") == 0, 0.0).otherwise(F.round(bounded, 9))
