"""Ordered work inside one file without one task per file.

A single file may hold a large part of all rows, so no window here is
partitioned by the file alone. Rows are cut into blocks of consecutive
positions; a block is the unit of work. What crosses block borders travels in
one of three ways:

* ``with_prefix``      one summary row per block is scanned, and the carry is joined back;
* ``with_neighbours``  a few rows around each border are copied into the next block;
* ``fold_blocks``      a greedy rule is summarised per block as a transition array (for every
                       state it may be entered in), a prefix over the summaries gives the
                       true entry states, and each block is replayed from its own;
* ``follow_links``     rows that point to later rows of the file: pointers are doubled inside
                       blocks, and the places where blocks are entered are followed in turn.

The only per-file windows run over block summaries: one row for ``BLOCK_ROWS`` rows. Rules and
links run as expressions over the rows of a block, gathered into one array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

BLOCK_ROWS = 1 << 16
#: parts that the rows of a file are dealt to when facts about the file are joined
FACT_PARTS = 32
#: facts, at most, that are sent to every task instead
FEW_FACTS = 2000


def with_facts(
    rows: DataFrame,
    facts: DataFrame,
    place: str,
    how: str = "inner",
    keys: Sequence[str] = ("file_id",),
    parts: int = FACT_PARTS,
) -> DataFrame:
    """Join what is known per file onto the file's rows without gathering any file.

    Rows are dealt by file and a part that ``place``, a column of theirs, decides; facts, few per file, are copied to
    every part. What follows by ``(file_id, anything)`` is then dealt out anew, since rows do not lie by file.

    Facts are counted first, so they are materialised: up to ``FEW_FACTS`` rows are broadcast, without copies. More are
    never broadcast: the planner takes the copies for as small as the facts in their file, and the driver would hold all.
    """
    part = "_part"
    facts = cut(facts)
    broadcasts = not rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    if broadcasts and facts.limit(FEW_FACTS + 1).count() <= FEW_FACTS:
        return rows.join(F.broadcast(facts), list(keys), how)
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(place), F.lit(parts)))
    copies = facts.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), [*keys, part], how).drop(part)


def join_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join frames that both hold a row per row of the files, always by shuffle.

    The planner goes by the size of their files, where repetitive rows take hardly any room, and would send all of them
    through the driver.
    """
    return left.join(right.hint("merge"), list(keys), how)


def with_prefix(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` over all rows of the same key before this one."""
    keys = list(keys)
    block_keys = keys + ["_blk"]
    blocked = df.withColumn("_blk", F.floor(F.col(position) / block_rows)).withColumn(
        "_v", value.cast("long")
    )
    inside = Window.partitionBy(*block_keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    totals = blocked.groupBy(*block_keys).agg(F.sum("_v").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *block_keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carry")
    ).filter(F.col("_carry") > 0)
    return (
        local.join(carry, block_keys, "left")
        .withColumn(name, F.col("_local") + F.coalesce("_carry", F.lit(0)))
        .drop("_blk", "_v", "_local", "_carry")
    )


def with_rank(
    df: DataFrame, keys: Sequence[str], position: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Dense 0-based rank in position order."""
    return with_prefix(df, keys, position, F.lit(1), name, block_rows)


def with_running_max(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the maximum of ``value`` from this row to the end of its key."""
    keys = list(keys)
    block_keys = keys + ["_blk"]
    blocked = df.withColumn("_blk", F.floor(F.col(position) / block_rows))
    onward = Window.partitionBy(*block_keys).orderBy(F.col(position).desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = blocked.withColumn("_local", F.max(value).over(onward))
    tops = blocked.groupBy(*block_keys).agg(F.max(value).alias("_top"))
    later = Window.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = tops.select(*block_keys, F.max("_top").over(later).alias("_carry")).filter(
        F.col("_carry").isNotNull()
    )
    return (
        local.join(carry, block_keys, "left")
        .withColumn(name, F.greatest("_local", "_carry"))
        .drop("_blk", "_local", "_carry")
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    before: int,
    after: int,
    columns: Callable[[object], dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
    head: int = 0,
    size: str | None = None,
    copies: bool = False,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead.

    ``position`` must be dense (0, 1, 2, ... per key). ``columns`` receives the
    ordered window specification. The first ``head`` rows of a key, of which
    there are ``size`` rows, stand before the rows of every block as well. With
    ``copies``, rows copied into another block stay, and ``_blk`` and ``_own`` tell.
    """
    if max(before, after) >= block_rows:
        raise ValueError("the look-around must be smaller than a block")
    pos = F.col(position)
    own = F.floor(pos / block_rows)
    inside = pos - own * block_rows
    lie = [own]
    if before:
        lie.append(F.when(inside >= block_rows - before, own + 1))
    if after:
        lie.append(F.when((inside < after) & (own > 0), own - 1))
    homes = F.filter(F.array(*lie), lambda b: b.isNotNull())
    if head:
        all_blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) - 1) / block_rows))
        homes = F.when(pos < head, F.array_union(homes, all_blocks)).otherwise(homes)
    spread = df.withColumn("_blk", F.explode(homes)).withColumn("_own", F.col("_blk") == own)
    window = Window.partitionBy(*keys, "_blk").orderBy(position)
    seen = spread.withColumns(columns(window))
    return seen if copies else seen.filter("_own").drop("_blk", "_own")


class BlockRule:
    """A greedy scan rule as expressions: a finite automaton over the rows of a file.

    A state is a long; ``first`` is the state before the first row of a file. ``step`` maps (row, state) to
    (opens a record, offset in the record, next state); ``states`` lists, from a row of the file, the states that a
    block may be entered in. ``row`` is a struct of the position and of ``columns``.
    """

    columns: Sequence[str] = ()
    first: int = 0

    def prepared(self, rows: DataFrame) -> DataFrame:
        """Rows with ``columns``, where the rule names some that are made from others once per row."""
        return rows

    def states(self, row: Column) -> Column:
        raise NotImplementedError

    def step(self, row: Column, state: Column) -> tuple[Column, Column, Column]:
        raise NotImplementedError


#: rows that are run together: their outcomes are gathered in one array, which every row copies
CHUNK_ROWS = 64
#: summaries that are composed by one task
FAN = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def chunks(rows: Column, size: int = CHUNK_ROWS) -> Column:
    """An array cut into arrays of ``size``."""
    last = F.floor((F.size(rows) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * size + 1, F.lit(size)))


def gathered(narrow: DataFrame, block_keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of each block as one array in order of their position, the first of ``columns``."""
    return narrow.groupBy(*block_keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))


def replayed(
    rows: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str
) -> Column:
    """Run ``step`` over the rows from state ``start``; it gives (what is emitted for the row, next state).

    What a fold carries is copied whole with every element. So one pass carries nothing but states, and notes the one that
    each chunk is entered in; outcomes are gathered by chunks, each from its own state.
    """

    def passed(part: Column, state: Column) -> Column:
        return F.aggregate(part, state, lambda held, row: step(row, held)[1])

    def told(part: Column, state: Column) -> Column:
        before = F.struct(F.lit(None).cast(out_type).alias("emitted"), state.alias("state"))

        def one(held: Column, row: Column) -> Column:
            emitted, following = step(row, F.element_at(held, -1)["state"])
            return F.array_append(held, F.struct(emitted.alias("emitted"), following.alias("state")))

        # the first is the state before the chunk
        return F.slice(F.aggregate(part, F.array(before), one), F.lit(2), F.size(part))

    def many(cut_up: Column) -> Column:
        entries = F.aggregate(cut_up, F.array(start), lambda held, part: F.array_append(held, passed(part, F.element_at(held, -1))))
        return let(entries, lambda e: F.transform(cut_up, lambda part, i: told(part, F.get(e, i))["emitted"]))

    return F.flatten(let(chunks(rows), many))


def unrolled(told: Column) -> Column:
    """One row per outcome of a block, which has at least one row.

    The planner puts a test for empty arrays before ``explode``, which would run the rule over every block once more.
    """
    return F.explode_outer(told)


def _summaries(arrays: DataFrame, block_keys: Sequence[str], rule: BlockRule) -> DataFrame:
    """Transition array of each block: for every entry state the exit state and the records opened.

    States that have met stay together, so a chunk is folded once per different state.
    """
    walked = "struct<state:bigint,n:bigint>"

    def one(held: Column, row: Column) -> Column:
        opens, _, following = rule.step(row, held["state"])
        return F.struct(following.cast("long").alias("state"), (held["n"] + opens.cast("long")).alias("n"))

    def many(held: Column, part: Column) -> Column:
        def through(apart: Column) -> Column:
            ends = F.transform(apart, lambda s: F.aggregate(part, F.struct(s.alias("state"), F.lit(0).cast("long").alias("n")), one))
            return let(
                ends,
                lambda e: F.transform(
                    held,
                    lambda h: let(
                        F.get(e, F.array_position(apart, h["state"]).cast("int") - 1),
                        lambda x: F.struct(x["state"].alias("state"), (h["n"] + x["n"]).alias("n")),
                    ),
                ),
            )

        return let(F.array_distinct(F.transform(held, lambda h: h["state"])), through)

    states = F.concat(F.array(F.lit(rule.first).cast("long")), rule.states(F.get("_rows", F.lit(0))))
    started = F.transform("_states", lambda s: F.struct(s.alias("state"), F.lit(0).cast("long").alias("n")))
    return arrays.withColumn("_states", states).select(
        *block_keys, "_states", F.aggregate(chunks(F.col("_rows")), started.cast(f"array<{walked}>"), many).alias("_ends")
    )


def _passed(block: Column, held: Column) -> Column:
    """State and count behind a summarised block."""
    return let(
        F.get(block["_ends"], F.array_position(block["_states"], held["state"]).cast("int") - 1),
        lambda e: F.struct(e["state"].alias("state"), (held["n"] + e["n"]).alias("n")),
    )


def _entries(summaries: DataFrame, keys: list[str], place: str, first: int, fan: int = FAN) -> DataFrame:
    """True entry state and count of every summarised block, by a prefix over groups of blocks, groups of groups, ...

    No task sees more than ``fan`` summaries.
    """
    group = f"{place}g"
    grouped = cut(
        summaries.withColumn(group, F.floor(F.col(place) / fan))
        .groupBy(*keys, group)
        .agg(F.sort_array(F.collect_list(F.struct(place, "_states", "_ends"))).alias("_blocks"))
    )
    zero = F.struct(F.lit(first).cast("long").alias("state"), F.lit(0).cast("long").alias("n"))
    if grouped.filter(F.col(group) > 0).isEmpty():
        entered = grouped.withColumn("_in", zero)
    else:
        states = F.get("_blocks", F.lit(0))["_states"]
        each = lambda s: F.aggregate(
            "_blocks", F.struct(s.alias("state"), F.lit(0).cast("long").alias("n")), lambda held, block: _passed(block, held)
        )
        composed = grouped.select(*keys, group, states.alias("_states"), F.transform(states, each).alias("_ends"))
        above = _entries(composed, keys, group, first, fan)
        entered = grouped.join(
            above.select(*keys, group, F.struct(F.col("_entry").alias("state"), F.col("_base").alias("n")).alias("_in")),
            [*keys, group],
        )

    def step(block: Column, held: Column) -> tuple[Column, Column]:
        told = F.struct(block[place].alias("place"), held["state"].alias("state"), held["n"].alias("n"))
        return told, _passed(block, held)

    told = replayed(F.col("_blocks"), F.col("_in"), step, "struct<place:bigint,state:bigint,n:bigint>")
    return entered.select(*keys, unrolled(told).alias("_t")).select(
        *keys, F.col("_t.place").alias(place), F.col("_t.state").alias("_entry"), F.col("_t.n").alias("_base")
    )


def fold_blocks(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    rule: BlockRule,
    keep: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """Run a greedy rule over each key; adds ``record_id`` and ``offset``.

    Returns ``keys + position + keep + record_id + offset``. The rows of a block are one array, over which the rule
    runs as an expression. Keys of one block start in the rule's first state; of longer ones each block is summarised
    as a transition array, and a prefix over these gives the state that each block is entered in. Only the columns the
    rule names are gathered, never the cells. They are materialised once, as up to three passes read them.
    """
    keys = list(keys)
    block_keys = keys + ["_blk"]
    columns = list(dict.fromkeys([c for c in (*rule.columns, *keep) if c not in (*keys, position)]))
    narrow = cut(
        rule.prepared(df).select(*keys, F.col(position).cast("long").alias(position), *columns).withColumn(
            "_blk", F.floor(F.col(position) / block_rows)
        )
    )
    arrays = gathered(narrow, block_keys, [position, *columns])
    # keys that fit one block need no summary: their entry state is known
    long_keys = narrow.filter(F.col(position) == block_rows).select(*keys)
    if long_keys.isEmpty():
        entered = arrays.withColumns({"_entry": F.lit(rule.first).cast("long"), "_base": F.lit(0).cast("long")})
    else:
        own = [position, *[c for c in rule.columns if c != position]]
        longer = gathered(with_facts(narrow, long_keys, position, "left_semi", keys), block_keys, own)
        entries = _entries(_summaries(longer, block_keys, rule), keys, "_blk", rule.first, fan)
        entered = arrays.join(entries, block_keys, "left").fillna({"_entry": rule.first, "_base": 0})

    kept = [position, *[c for c in keep if c not in (*keys, position)]]
    fields = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    out_type = "struct<" + ",".join([*[f"`{c}`:{fields[c]}" for c in kept], "record_id:bigint,offset:bigint"]) + ">"

    def step(row: Column, held: Column) -> tuple[Column, Column]:
        opens, offset, following = rule.step(row, held["state"])
        record = held["n"] + opens.cast("long")
        told = F.struct(*[row[c].alias(c) for c in kept], (record - 1).alias("record_id"), offset.cast("long").alias("offset"))
        return told, F.struct(following.cast("long").alias("state"), record.alias("n"))

    start = F.struct(F.col("_entry").alias("state"), F.col("_base").alias("n"))
    told = replayed(F.col("_rows"), start, step, out_type)
    return entered.select(*keys, unrolled(told).alias("_t")).select(*keys, "_t.*")


def _followed(nodes: DataFrame, block_keys: list[str], block_rows: int, starts: DataFrame) -> DataFrame:
    """For every place in ``starts`` the last place of its block on the way, how many lie on it, and where it leaves to.

    ``nodes`` have dense ``_at`` and ``_to``. Pointers inside a block are doubled until none moves: an entry holds where
    it leads in its low half and how many steps away that is in its high half.
    """
    low = (1 << 32) - 1
    home = F.col("_blk") * block_rows
    to = F.transform("_rows", lambda r: r["_to"])
    own = F.transform(
        "_rows",
        lambda r, i: F.when(r["_to"] < home + F.size("_rows"), (r["_to"] - home) + (1 << 32)).otherwise(i.cast("long")),
    )

    def doubled(hops: Column, _: Column) -> Column:
        def further(h: Column) -> Column:
            then = F.get(hops, h.bitwiseAND(F.lit(low)).cast("int"))
            return then + F.shiftright(h, 32) * (1 << 32)

        return F.transform(hops, further)

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size("_rows").cast("long"))).cast("int"))
    arrays = gathered(nodes, block_keys, ["_at", "_to"])
    asked = starts.groupBy(*block_keys).agg(F.collect_list("_at").alias("_starts"))
    leaps = (
        arrays.join(asked, block_keys)
        .withColumns({"_next": to, "_hops": F.aggregate(rounds, own, doubled)})
        .select(*block_keys, "_next", "_hops", F.explode("_starts").alias("_at"))
        .withColumn("_hop", F.get("_hops", (F.col("_at") - home).cast("int")))
    )
    last = F.col("_hop").bitwiseAND(F.lit(low))
    return leaps.select(
        *block_keys, "_at", (home + last).alias("_last"), (F.shiftright("_hop", 32) + 1).alias("_n"),
        F.get("_next", last.cast("int")).alias("_to"),
    )


def follow_links(
    df: DataFrame, keys: Sequence[str], position: str, link: str, keep: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Records that begin at row 0 of each key and at every row its links lead to; adds ``record_id`` and ``offset``.

    ``position`` is dense per key; ``link`` is a later position or NULL. Within a block, pointers are doubled. The
    places where links enter a block become the nodes of a graph with far fewer rows, which is followed in the same way;
    so a key of any length takes a few rounds, and no task holds more than a block.
    """
    keys = list(keys)
    block_keys = keys + ["_blk"]
    carried = [c for c in keep if c not in (*keys, position)]
    block = lambda place: F.floor(F.col(place) / block_rows)
    narrow = cut(
        df.select(*keys, F.col(position).cast("long").alias("_at"), F.col(link).cast("long").alias("_to"), *carried).withColumn(
            "_blk", block("_at")
        )
    )
    arrays = gathered(narrow, block_keys, ["_at", "_to", *carried])
    long_keys = narrow.filter(F.col("_at") == block_rows).select(*keys)
    none = F.lit(None).cast("long")
    if long_keys.isEmpty():
        entered = arrays.withColumns({"_entry": F.lit(0).cast("long"), "_open": none, "_base": F.lit(0).cast("long")})
    else:
        longer = cut(with_facts(narrow.select(*keys, "_at", "_to", "_blk"), long_keys, "_at", "left_semi", keys))
        crossing = longer.filter(block("_to") > F.col("_blk")).select(*keys, F.col("_to").alias("_at"))
        starts = crossing.union(longer.filter("_at = 0").select(*keys, "_at")).distinct().withColumn("_blk", block("_at"))
        # nodes: the places where a block is entered, numbered densely
        entered_at = cut(_followed(longer, block_keys, block_rows, starts))
        nodes = cut(with_rank(entered_at, keys, "_at", "_rank", block_rows))
        led = nodes.join(
            nodes.select(*keys, F.col("_at").alias("_to"), F.col("_rank").alias("_to_rank")), [*keys, "_to"], "left"
        ).withColumnsRenamed({"_at": "_node", "_to": "_node_to"})
        # blocks double with each level, so that any graph ends in one
        seen = follow_links(led, keys, "_rank", "_to_rank", ["_node", "_node_to", "_last", "_n"], 2 * block_rows)
        counted = with_prefix(seen.filter("offset = 0"), keys, "record_id", F.col("_n"), "_base", block_rows)
        linked = with_neighbours(
            counted, keys, "record_id", before=1, after=0,
            columns=lambda w: {"_before": F.lag("_last").over(w)}, block_rows=max(block_rows, 2),
        )
        ends = longer.groupBy(*keys).agg(F.max("_blk").alias("_end"))
        first, past = block("_node"), F.coalesce(block("_node_to"), F.col("_end") + 1)
        here = F.col("_blk") == first
        # a block that no record begins in belongs to the record that was open before
        entries = (
            with_facts(linked, ends, "_node", keys=keys)
            .withColumn("_blk", F.explode(F.sequence(first, past - 1)))
            .select(
                *block_keys,
                F.when(here, F.col("_node")).otherwise(F.lit(-1)).alias("_entry"),
                F.when(here, F.col("_before")).otherwise(F.col("_last")).alias("_open"),
                F.when(here, F.col("_base")).otherwise(F.col("_base") + F.col("_n")).alias("_base"),
            )
        )
        entered = arrays.join(entries, block_keys, "left").fillna({"_entry": 0, "_base": 0})

    fields = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    out_type = "struct<" + ",".join(["_at:bigint", *[f"`{c}`:{fields[c]}" for c in carried], "record_id:bigint,offset:bigint"]) + ">"

    def step(row: Column, held: Column) -> tuple[Column, Column]:
        opens = row["_at"] == F.coalesce(held["next"], F.lit(-1))
        begun = F.when(opens, row["_at"]).otherwise(held["begun"])
        record = held["n"] + opens.cast("long")
        told = F.struct(
            row["_at"].alias("_at"), *[row[c].alias(c) for c in carried], (record - 1).alias("record_id"),
            (row["_at"] - begun).alias("offset"),
        )
        return told, F.struct(
            F.when(opens, row["_to"]).otherwise(held["next"]).alias("next"), begun.alias("begun"), record.alias("n")
        )

    start = F.struct(F.col("_entry").alias("next"), F.col("_open").alias("begun"), F.col("_base").alias("n"))
    told = replayed(F.col("_rows"), start, step, out_type)
    return (
        entered.select(*keys, unrolled(told).alias("_t"))
        .select(*keys, "_t.*")
        .withColumnRenamed("_at", position)
    )


def with_next(
    df: DataFrame, keys: Sequence[str], position: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the next larger ``position`` of the same key, NULL for its last row."""
    keys = list(keys)
    block_keys = keys + ["_blk"]
    blocked = df.withColumn("_blk", F.floor(F.col(position) / block_rows))
    local = blocked.withColumn("_local", F.lead(position).over(Window.partitionBy(*block_keys).orderBy(position)))
    firsts = blocked.groupBy(*block_keys).agg(F.min(position).alias("_first"))
    carry = firsts.select(
        *block_keys, F.lead("_first").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_carry")
    ).filter(F.col("_carry").isNotNull())
    return (
        local.join(carry, block_keys, "left")
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_blk", "_local", "_carry")
    )
