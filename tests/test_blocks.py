"""Block-wise ordered operators give the same result whatever the block size."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tablemend.operators import blocks as B, boundaries, records, structure, validate
from tablemend.operators.boundaries import BoundaryScoreRule, ScoredRule
from tablemend.plans import manifest
from tablemend.session import cut


def frame(spark, n=57, seed=3):
    rng = random.Random(seed)
    rows = [(f, i, rng.randint(0, 9)) for f, m in (("a", n), ("b", 5), ("c", 1)) for i in range(m)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "file_id string, pos long, v long").repartition(5), sorted(rows)


def test_prefix_and_running_max(spark):
    df, rows = frame(spark)
    out = B.with_prefix(df, ["file_id"], "pos", F.col("v"), "before", block_rows=4)
    out = B.with_running_max(out, ["file_id"], "pos", "v", "top", block_rows=4)
    for f, p, v, before, top in out.select("file_id", "pos", "v", "before", "top").collect():
        same = [r for r in rows if r[0] == f]
        assert before == sum(r[2] for r in same if r[1] < p)
        assert top == max(r[2] for r in same if r[1] >= p)


def test_neighbours(spark):
    df, rows = frame(spark)
    out = B.with_neighbours(
        df, ["file_id"], "pos", 1, 3,
        lambda w: {"prev": F.lag("v").over(w), "ahead": F.collect_list("v").over(w.rowsBetween(0, 3))}, block_rows=4,
    ).collect()
    assert len(out) == len(rows)
    for r in out:
        same = {x[1]: x[2] for x in rows if x[0] == r["file_id"]}
        assert r["prev"] == same.get(r["pos"] - 1)
        assert r["ahead"] == [same[q] for q in range(r["pos"], r["pos"] + 4) if q in same]


def feature_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for f, m in (("a", n), ("b", 9), ("c", 1)):
        span, rep = rng.choice([(2, 3), (3, 1), (4, 6)])
        for j in range(m):
            fits = "".join(rng.choice("01") for _ in range(span))
            mask = "".join(rng.choice("0001") for _ in range(rng.randint(1, 6)))
            mask = mask if "1" in mask else "1"
            rows.append((f, j, span, rep, fits, rng.randrange(span), rng.random() < 0.2, rng.choice([0.0, 10.0, 30.0]),
                         rng.choice([0.0, 15.0]), rng.random() < 0.5, mask))
    return rows


FEATURES = (
    "file_id string, j long, span int, rep_span int, fits string, best int, anchor boolean, extra double, "
    "reset double, aligned boolean, mask string"
)


def offset_at(row, place):
    expected = place % row["span"]
    return expected if row["fits"][expected] == "1" else row["best"]


def scored(row, state):
    """Greedy scored grouping, row by row: (opens, offset, next state)."""
    place, seen = state or (0, False)
    span = row["span"]
    if place == 0 or offset_at(row, place) == 0 or (row["anchor"] and seen):
        return True, 0, (1, row["anchor"])
    return False, place, (place + 1 if place + 1 < 2 * span else span, seen or row["anchor"])


def boundary(row, state):
    place, opened = state or (0, False)
    span, rep, offset = row["span"], max(row["rep_span"], 1), offset_at(row, place)
    total = offset + row["extra"] + 40 * row["anchor"]
    if offset == 0:
        total += 30 + row["reset"] + 20 * (place > 0) + 10 * row["aligned"]
    total += 15 * (rep > 1 and place > 0 and place % rep == 0)
    if opened and (total >= 45 or (offset == 0 and place > 0 and total >= 25)):
        return True, place, (0, True)
    period = math.lcm(span, rep)
    return not opened, place, (place + 1 if place + 1 < 2 * period else period, True)


def plain_run(step, rows):
    """A rule applied row by row to each whole file."""
    out = {}
    for f in sorted({r[0] for r in rows}):
        state, record = None, -1
        for r in sorted(x for x in rows if x[0] == f):
            opens, offset, state = step(dict(zip([c.split()[0] for c in FEATURES.split(", ")], r)), state)
            record += bool(opens)
            out[f, r[1]] = (record, offset)
    return out


@pytest.mark.parametrize("rule, step", [(ScoredRule(), scored), (BoundaryScoreRule(), boundary)], ids=["scored", "boundary"])
@pytest.mark.parametrize("seed", [11, 12])
def test_folds_do_not_depend_on_blocks(spark, rule, step, seed):
    rows = feature_rows(seed)
    df = spark.createDataFrame(rows, FEATURES).repartition(6)
    want = plain_run(step, rows)
    for size, fan in ((4, 3), (1 << 16, 1024)):
        folded = B.fold_blocks(df, ["file_id"], "j", rule, (), size, fan)
        assert {(r["file_id"], r["j"]): (r["record_id"], r["offset"]) for r in folded.collect()} == want


def test_folds_over_many_chunks(spark):
    """Outcomes are appended in chunks, and states that met are followed once."""
    rows = [r for r in feature_rows(5, 700) if r[0] == "a"]
    df = spark.createDataFrame(rows, FEATURES).repartition(3)
    for rule, step in ((ScoredRule(), scored), (BoundaryScoreRule(), boundary)):
        for size in (300, 1 << 16):
            folded = B.fold_blocks(df, ["file_id"], "j", rule, ["anchor"], size).collect()
            assert {(r["file_id"], r["j"]): (r["record_id"], r["offset"]) for r in folded} == plain_run(step, rows)
            assert {r["j"]: r["anchor"] for r in folded} == {r[1]: r[6] for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_links_do_not_depend_on_blocks(spark, seed):
    rng = random.Random(seed)
    links, want = [], {}
    for f, n, far in (("a", 90, 6), ("b", 50, 40), ("c", 1, 3), ("d", 7, 2)):
        own = [rng.choice([None] * (far > 10) + [i + rng.randint(1, far)] * 5) for i in range(n)]
        own = [None if t is None or t >= n else t for t in own]
        links += [(f, i, t, f"{f}{i}") for i, t in enumerate(own)]
        start, record = 0, -1
        for i in range(n):
            if i == 0 or i == own[start]:
                start, record = i, record + 1
            want[f, i] = (record, i - start, f"{f}{i}")
    df = spark.createDataFrame(links, "file_id string, j long, next long, name string").repartition(5)
    for size in (7, 1 << 16):
        found = B.follow_links(df, ["file_id"], "j", "next", ["name"], size).collect()
        assert {(r["file_id"], r["j"]): (r["record_id"], r["offset"], r["name"]) for r in found} == want


def merged(masks):
    """Record of each row of a greedy merge of rows without a common column."""
    out, held, record = [], None, -1
    for mask in masks:
        if held is None or held & mask:
            held, record = set(), record + 1
        held = held | mask
        out.append(record)
    return out


@pytest.mark.parametrize("width, share", [(6, 0.3), (40, 0.04), (1000, 0.002)])
def test_sparse_merge(spark, width, share):
    """Wide rows cost their filled cells; records of many rows cross several blocks."""
    rng = random.Random(width)
    rows, want = [], {}
    for f, n in (("a", 120), ("b", 9)):
        masks = [{c for c in range(width) if rng.random() < share} or {rng.randrange(width)} for _ in range(n)]
        rows += [(f, 2 * j + 1, j, ["x" if c in m else None for c in range(width)]) for j, m in enumerate(masks)]
        want |= {(f, 2 * j + 1): r for j, r in enumerate(merged(masks))}
    df = spark.createDataFrame(rows, "file_id string, row_idx long, j long, cells array<string>").repartition(4)
    for size in (32, 1 << 16):
        found = boundaries.sparse_merge_groups(df, size).collect()
        assert {(r["file_id"], r["row_idx"]): r["record_id"] for r in found} == want


def test_greedy_rules_run_without_python(spark):
    df = spark.createDataFrame(feature_rows(1), FEATURES)
    plans = [B.fold_blocks(df, ["file_id"], "j", rule, (), 4) for rule in (ScoredRule(), BoundaryScoreRule())]
    cells = df.select("file_id", "j", F.col("j").alias("row_idx"), F.array(F.lit("x")).alias("cells"))
    for plan in (*plans, boundaries.sparse_merge_groups(cells, 4)):
        assert not re.search("Pandas|Arrow|Python", plan._jdf.queryExecution().executedPlan().toString())


def exchanges(df):
    """Keys that rows are dealt by in the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"hashpartitioning\(([^)]*), \d+\)", re.sub(r"#\d+L?", "", plan))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_facts_join_like_a_plain_join(spark):
    df, rows = frame(spark)
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "file_id string, fact int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = B.with_facts(df, facts, "pos", how), df.join(facts, "file_id", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_copies_of_facts_are_never_broadcast(spark):
    """Few facts go to all tasks as they are; more are joined by shuffle, as the driver would hold every copy."""
    df, _ = frame(spark)
    facts = lambda n: spark.range(n).select(F.col("id").cast("string").alias("file_id"), F.col("id").alias("fact"))
    planned = lambda n: B.with_facts(df, facts(n), "pos")._jdf.queryExecution().executedPlan().toString()
    few, many = planned(B.FEW_FACTS), planned(B.FEW_FACTS + 1)
    assert "BroadcastHashJoin" in few and "Generate" not in few
    assert "Broadcast" not in many and "SortMergeJoin" in many and "Generate" in many


def test_rows_are_never_broadcast_to_rows(spark):
    """A few kilobytes on disk may be a million rows: joins of rows with rows do not go by the size of their files."""
    of = lambda *columns: cut(spark.range(50_000).select(F.lit("a").alias("file_id"), F.col("id").alias("row_idx"), *columns))
    rows, groups = of(F.array(F.lit("x")).alias("cells")), of(F.lit(0).cast("long").alias("record_id"))
    plan = records.merge_groups(groups, rows)._jdf.queryExecution().executedPlan().toString()
    assert "row_idx" not in "".join(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert any("row_idx" in line for line in plan.splitlines() if "SortMergeJoin" in line)


def test_no_operator_deals_rows_by_file_alone(spark, no_broadcast):
    """After per-file facts are joined, windows and aggregates deal rows out by block, column or value."""
    rows = spark.createDataFrame([("a", i, ["1", "x"], 2) for i in range(9)], "file_id string, row_idx long, cells array<string>, width int")
    widths = spark.createDataFrame([("a", 2, None)], "file_id string, schema_width int, stream_cols array<int>")
    data = rows.withColumn("j", F.col("row_idx"))
    assert "file_id, _blk" in exchanges(records.rechunk_stream(data, widths))
    horizon = spark.createDataFrame([("a", 1, 2)], "file_id string, horizon long, width int")
    assert "file_id, col" in exchanges(manifest.profile_columns(rows, horizon))
    files_ = spark.createDataFrame([("a", 1)], "file_id string, data_start long")
    profiled = rows.withColumn("non_null_count", F.lit(2))
    assert "file_id, col, value" in exchanges(structure.column_values(profiled, files_))
    tables = spark.createDataFrame([("a", "v", 0, ["1", "x"])], "file_id string, variant string, record_id long, values array<string>")
    keyed = spark.createDataFrame([("a", "v", 0)], "file_id string, variant string, anchor_col int")
    assert "file_id, variant, value" in exchanges(validate.anchor_duplicates(tables, keyed))
    for found in (records.rechunk_stream(data, widths), manifest.profile_columns(rows, horizon), structure.column_values(profiled, files_)):
        assert any(keys.startswith("file_id, _part") for keys in exchanges(found))
