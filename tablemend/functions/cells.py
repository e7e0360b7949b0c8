"""Expressions over one cell of a raw matrix.

Every function takes and returns a ``Column``, so it can be used on a plain
column as well as inside ``transform``/``filter`` over an array of cells.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Tokens read as missing.
NA_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

BLANKS = " \t\r\n\f\u000b "
CELL_SEPARATOR = r"[\t,;|]"

# Identifier patterns of a trimmed value from its start, first match wins.
ANCHOR_PATTERNS = [
    ("txn_prefix", r"TXN[_-][A-Z0-9]+"),
    ("order_prefix", r"ORD[_-][A-Z0-9]+"),
    ("invoice_prefix", r"INV[_-][A-Z0-9]+"),
    ("customer_prefix", r"CUST[_-][A-Z0-9]+"),
    ("student_prefix", r"STU[_-][A-Z0-9]+"),
    ("uuid", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\s*$"),
]

# Words in a column name that tell its semantic type.
DATETIME_WORDS = ["date", "time", "stamp", "year", "month", "day"]
NUMERIC_WORDS = [
    "amount", "total", "quantity", "score", "price", "value", "sum", "count",
    "qty", "rate", "cost",
]

# Words in a column name that hint at a record identifier.
ANCHOR_KEYWORDS = [
    "transaction_id", "transaction", "invoice", "order_id", "order", "customer_id",
    "customer", "student_id", "student", "record_id", "uuid", "guid", "id", "txn",
]

NUMBER = r"^[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NON_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"
ANY_NUMBER = r"^\s*[+-]?((\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
ISO_DATE = (
    r"^\d{4}-\d{2}-\d{2}([ T]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?"
    r"(Z|[+-]\d{2}:?\d{2})?)?$"
)
US_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"
COMPACT_DATE = r"^\d{8}$"
CLOCK_TIME = r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"
FIRST_YEAR, LAST_YEAR = 1678, 2262


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def normalize_cell(value: Column) -> Column:
    """Trim, then map blanks and missing-value tokens to NULL."""
    trimmed = strip(value)
    return F.when((trimmed != "") & ~trimmed.isin(NA_TOKENS), trimmed)


def split_line(line: Column) -> Column:
    """Cut one line into normalised cells; quotes have no meaning."""
    return F.transform(F.split(line, CELL_SEPARATOR), normalize_cell)


def is_number_text(value: Column) -> Column:
    return value.rlike(ANY_NUMBER)


def is_numeric(value: Column) -> Column:
    """Number once thousands separators are removed."""
    return F.coalesce(is_number_text(F.replace(value, F.lit(","), F.lit(""))), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\p{L}"), F.lit(False))


def is_date(value: Column) -> Column:
    """Closed list of date, time and year forms."""
    return _is_date(strip(value))


def _is_date(text: Column) -> Column:
    slash = F.split(text, "/")
    iso = (
        F.when(text.rlike(ISO_DATE), F.substring(text, 1, 10))
        .when(
            text.rlike(US_DATE),
            F.concat_ws("-", slash[2], F.lpad(slash[0], 2, "0"), F.lpad(slash[1], 2, "0")),
        )
        .when(
            text.rlike(COMPACT_DATE),
            F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
        )
        .when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
    )
    year = F.substring(iso, 1, 4).try_cast("int")
    calendar = iso.try_cast("date").isNotNull() & year.between(FIRST_YEAR, LAST_YEAR)
    # only cells that begin with a digit can match: skip the rest of the work
    return F.when(text.rlike(r"^\d"), F.coalesce(calendar, F.lit(False)) | text.rlike(CLOCK_TIME)).otherwise(
        F.lit(False)
    )


def classify_cell(value: Column) -> Column:
    """E(mpty), D(ate), N(umber), T(ext) or M(ixed)."""
    return classify_normalized(strip(value))


def classify_normalized(value: Column) -> Column:
    """As ``classify_cell`` for a cell without blanks around it.

    Inside ``transform`` nothing is shared between branches, so trimming over
    and over would cost more than the classification.
    """
    bare = F.translate(value, ",$", "")
    return (
        F.when(value.isNull() | (value == ""), "E")
        # a leading letter settles it, unless the word may spell inf or nan
        .when(value.rlike(r"^[\p{L}&&[^iInN]]"), "T")
        .when(_is_date(value), "D")
        .when(is_number_text(bare), "N")
        .when(value.rlike(r"\p{L}"), "T")
        .otherwise("M")
    )


def match_anchor(value: Column) -> Column:
    """Name of the first identifier pattern the value matches, else NULL."""
    names = [F.when(value.rlike(rf"(?i)^\s*{body}"), name) for name, body in ANCHOR_PATTERNS]
    return F.coalesce(*names)


def is_anchor(value: Column) -> Column:
    bodies = "|".join(body for _, body in ANCHOR_PATTERNS)
    return F.coalesce(value.rlike(rf"(?i)^\s*({bodies})"), F.lit(False))


def looks_like_id(value: Column) -> Column:
    """Non-negative whole number."""
    text = strip(value)
    number = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False))


def contains_any(text: Column, words: list[str]) -> Column:
    """One pass over the text for all words."""
    return text.rlike("|".join(re.escape(w) for w in words))


def header_type(name: Column) -> Column:
    """Semantic type a column name announces."""
    low = F.lower(name)
    return (
        F.when(contains_any(low, DATETIME_WORDS), "datetime")
        .when(contains_any(low, NUMERIC_WORDS), "numeric")
        .otherwise("categorical")
    )


def class_type(cell_class: Column) -> Column:
    """Semantic type of a value from its cell class."""
    return (
        F.when(cell_class == "D", "datetime")
        .when(cell_class == "N", "numeric")
        .when(cell_class.isin("T", "M"), "categorical")
        .otherwise("empty")
    )


def value_type(value: Column) -> Column:
    return class_type(classify_cell(value))


def type_match(header: Column, value: Column) -> Column:
    """How well a value type fits the type its header announces."""
    return (
        F.when(value == "empty", 0.5)
        .when(header == value, 1.0)
        .when((header == "categorical") & value.isin("categorical", "numeric"), 0.8)
        .otherwise(0.0)
    )


def internal_match(header: Column, value: Column) -> Column:
    return (
        F.when((header == value) | (value == "empty"), 1.0)
        .when(header == "categorical", 0.5)
        .otherwise(0.0)
    )


def is_anchor_name(name: Column) -> Column:
    """Column name that holds an identifier keyword and an id-like part."""
    low = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    return contains_any(low, ANCHOR_KEYWORDS) & contains_any(low, ["id", "txn", "transaction", "uuid"])


def has_anchor_keyword(name: Column) -> Column:
    return contains_any(F.replace(F.lower(name), F.lit(" "), F.lit("_")), ANCHOR_KEYWORDS)


def header_cell_text(value: Column) -> Column:
    return strip(F.replace(value, F.lit("\n"), F.lit(" ")))
