"""Quality rules as a ledger of bitmasks.

Every rule is evaluated once per document. The ledger keeps its measurements and one bit per failed rule; a
policy is a version with a mask of the rules that count, so that policies are applied, compared and ablated by
bit operations, without reading a text again. Ablations aggregate distinct masks, of which there are at most two
to the power of the number of rules.

Rows: NULL text has no words. Each row is measured on its own, so repeated ids and rows each give a row; an empty
table gives an empty ledger. Only the id and text columns are read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

# fixed values: the characters that count as symbols, and white space between words
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "longest_word",
)


@dataclass(frozen=True)
class Rule:
    """A bit, and the test of measurements that sets it. Bits are never reused; a changed rule takes a new one."""

    bit: int
    name: str
    fails: Callable[[], Column]


RULES: tuple[Rule, ...] = (
    Rule(0, "few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "many_symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule(3, "repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    Rule(4, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(5, "long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule(6, "few_letters", lambda: 100 * F.col("n_letter_words") < 40 * F.col("n_words")),
    Rule(7, "huge_word", lambda: F.col("longest_word") > 1000),
)

#: versions of policies by the bits that count
BASE_MASK = 0b11
POLICIES: Mapping[str, int] = {"base-1": BASE_MASK, "keep-1": 0b1111, "keep-2": 0b11111111}


def repeated_words(of: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text, first included."""

    def covered(windows: Column) -> Column:
        numbered = F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

        def positions(ordered: Column) -> Column:
            return F.filter(
                ordered,
                lambda x, at: ((at > 0) & (F.get(ordered, at - 1)["h"] == x["h"]))
                | F.coalesce(F.get(ordered, at + 1)["h"] == x["h"], F.lit(False)),
            )

        places = F.flatten(
            F.transform(let(numbered, positions), lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            F.size(F.array_distinct(places))
        )

    starts = F.sequence(F.lit(1), F.size(of) - 2)
    windows = F.transform(
        starts, lambda i: F.xxhash64(F.element_at(of, i), F.element_at(of, i + 1), F.element_at(of, i + 2))
    )
    return F.when(F.size(of) < 4, 0).otherwise(let(windows, covered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every document, all of them counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(w: Column, lines: Column) -> Column:
        numbers = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(F.col("__text"), _SPACES, "")),
            "n_symbols": F.length("__text") - F.length(F.translate(F.col("__text"), SYMBOLS, "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(w),
            "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
            "longest_word": F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)),
        }
        return F.struct(*[numbers[name].cast("long").alias(name) for name in MEASURES])

    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(WORD))
    of_row = let(words(F.col("__text")), lambda w: let(lines, lambda found: counts(w, found)))
    return docs.select(id_col, text.alias("__text")).select(id_col, of_row.alias("m")).select(id_col, "m.*")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements with ``failed``: one bit for each failed rule."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit).cast("long")).otherwise(0))
    return measure(docs, id_col, text_col).withColumn("failed", bits)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a version of the policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone, and that would pass without it."""
    mask = POLICIES[policy]
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(
        F.count("*").alias("n")
    )
    tests = F.explode(
        F.array(
            *[
                F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << rule.bit).cast("long").alias("bit"))
                for rule in RULES
                if mask >> rule.bit & 1
            ]
        )
    )
    hit = F.col("failed").bitwiseAND(F.col("t.bit")) != 0
    alone = F.col("failed") == F.col("t.bit")
    clean = F.col("failed") == 0
    return (
        masks.select("failed", "n", tests.alias("t"))
        .groupBy(F.col("t.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_alone"),
            F.sum(F.when(clean | alone, F.col("n")).otherwise(0)).alias("n_kept_without"),
            F.sum(F.when(clean, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )
