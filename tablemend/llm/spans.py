"""Places of pattern matches as column expressions.

All offsets count code points, the end is exclusive. Patterns use possessive quantifiers where the greedy
match cannot succeed by giving characters back, so that no text costs more than linear time or deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
_BLOCK = 64


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array of longs, in blocks so that long arrays stay cheap."""

    def append(sums: Column, value: Column) -> Column:
        return F.concat(sums, F.array(F.when(F.size(sums) > 0, F.element_at(sums, -1)).otherwise(0) + value))

    def join(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.element_at(block, -1))
        return let(
            F.aggregate(totals, F.array(F.lit(0).cast("long")), append),
            lambda before: F.flatten(
                F.transform(blocks, lambda block, at: F.transform(block, lambda x: x + before[at]))
            ),
        )

    def run(array: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        cut = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(array) - 1) / _BLOCK).cast("int")),
            lambda at: F.aggregate(F.slice(array, at * _BLOCK + 1, _BLOCK), empty, append),
        )
        return F.when(F.size(array) == 0, empty).otherwise(let(cut, join))

    return let(values, run)


def matches(
    text: Column,
    pattern: str,
    keep: Callable[[Column], Column] | None = None,
    group: int = 0,
    when: Column | None = None,
    context: int = 0,
) -> Column:
    """Leftmost non-overlapping matches of a pattern: start, end and the text of ``group``.

    ``keep`` drops matches by that text, after matching; ``when`` skips texts that cannot match. With a
    ``context`` spans also have ``left`` and ``right``, that many characters between a match and its neighbours.
    """
    kind = SPAN if not context else SPAN.replace("value:string", "value:string,left:string,right:string")
    size = lambda parts: F.transform(parts, lambda x: F.length(x).cast("long"))

    def place(found: Column, between: Column) -> Column:
        # the text is between[0] found[0] between[1] found[1] ...
        both = F.arrays_zip(size(between).alias("b"), size(found).alias("f"))
        sizes = F.flatten(F.transform(both, lambda z: F.array(z["b"], F.coalesce(z["f"], F.lit(0)))))
        values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

        def span(z: Column, at: Column, ends: Column) -> Column:
            fields = [ends[2 * at].alias("start"), ends[2 * at + 1].alias("end"), z["v"].alias("value")]
            if context:
                fields += [
                    F.right(between[at], F.lit(context)).alias("left"),
                    F.left(between[at + 1], F.lit(context)).alias("right"),
                ]
            return F.struct(*fields)

        return let(
            running_sum(sizes),
            lambda ends: F.transform(F.arrays_zip(values.alias("v")), lambda z, at: span(z, at, ends)),
        )

    empty = F.array().cast(kind)
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda all_of: F.when(
            F.size(all_of) > 0, let(F.split(text, pattern, -1), lambda between: place(all_of, between))
        ).otherwise(empty),
    )
    if keep is not None:
        found = F.filter(found, lambda span: keep(span["value"]))
    return found if when is None else F.when(when, found).otherwise(empty)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind and its place in the list of kinds."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def untold(spans: Column) -> Column:
    """Tagged spans without further fields, so that they sort by start, then kind as listed."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of tagged spans by start, then kind as listed, comma-joined."""
    return F.concat_ws(
        ",",
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
    )
