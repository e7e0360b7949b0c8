"""Rows with few measures, and measures that are taken once."""

from pyspark.sql import functions as F

from queries import structure as QS
from tablemend.functions import cells as C
from tablemend.operators import profile as P, structure as S, validate as V
from tablemend.operators.blocks import unrolled
from tablemend.sources.store import KeyedStore


def test_rows_without_signatures_are_ordered(spark):
    data = [("a", i, [None if i % 3 else str(i), "x" if i % 3 == 1 else None], 2) for i in range(9)]
    raw = spark.createDataFrame(data, "file_id string, row_idx long, cells array<string>, width int")
    rows = P.profile_rows(raw).select("file_id", "row_idx", "non_null_count", "cells")
    active = P.active_rows(rows)
    assert "next_signature" not in active.columns
    data = S.data_rows(active, active.select("file_id").distinct().withColumn("data_start", F.lit(1)))
    assert "sig" not in data.columns
    assert sorted((r["row_idx"], r["j"]) for r in data.collect()) == [(1, 0), (3, 1), (4, 2), (6, 3), (7, 4)]


def test_cells_that_are_not_classified_are_told_from_the_data(spark):
    data = [("a", i, [str(i), "x"], 2) for i in range(4)]
    raw = spark.createDataFrame(data, "file_id string, row_idx long, cells array<string>, width int")
    rows, placed = QS._cell_data(raw, first=1)
    assert rows.columns == ["file_id", "row_idx", "non_null_count", "cells"]
    assert sorted((r["j"], r["row_idx"]) for r in placed.collect()) == [(0, 1), (1, 2), (2, 3)]


def test_row_alignment_classifies_a_value_once(spark, capsys):
    values = [[" 12 ", "2024-05-06", "word", "", None], ["x"], ["1", "2", "3", "4", "5", "6"], None, []]
    tables = spark.createDataFrame([("a", "v", i, v) for i, v in enumerate(values)], "file_id string, variant string, record_id long, values array<string>")
    names = spark.createDataFrame([("a", "v", ["total", "date", "remark", "price", "note"])], "file_id string, variant string, names array<string>")
    found = V.row_alignments(tables, names)
    got = {r["record_id"]: r["row_alignment"] for r in found.collect()}
    kinds = F.transform(F.array(*[F.lit(n) for n in ("total", "date", "remark", "price", "note")]), C.header_type)
    plain = F.zip_with(kinds, "values", lambda k, v: C.type_match(k, C.value_type(v)))
    wanted = tables.select("record_id", (F.aggregate(plain, F.lit(0.0), lambda a, x: a + x) / 5).alias("w")).collect()
    assert got == {r["record_id"]: r["w"] for r in wanted} and got[0] == 0.8
    V.row_alignments(tables, names).explain()
    # the pattern of numbers stands once in the plan that is run
    assert capsys.readouterr().out.count("inf|infinity|nan") == 1


def test_a_batch_larger_than_the_store_is_matched_once(spark, tmp_path, monkeypatch):
    store = KeyedStore(str(tmp_path / "store"), "shipment_id string, status string", buckets=4, segment_rows=10)

    def table(ids):
        return spark.createDataFrame([(k, "ok", i) for i, k in enumerate(ids)], "shipment_id string, status string, place long")

    asked = []
    reduce_store = KeyedStore._asked
    monkeypatch.setattr(KeyedStore, "_asked", lambda self, near, rows: asked.append(1) or reduce_store(self, near, rows))
    store.append(table(["a", "b", "b", None]), 0, ["place"], settled=True)
    store.append(table(["c", "b", None, "d", "d", "a"]), 1, ["place"], settled=True)
    # keys of the larger batch were not shuffled apart from its rows; those of a smaller one reduce the store
    assert not asked
    store.append(table(["d", "e"]), 2, ["place"])
    assert asked
    found = [r["shipment_id"] for r in store.rows(spark).orderBy("id").collect()]
    assert found == ["a", "b", "b", None, "c", None, "d", "d", "e"]


def test_outcomes_are_unrolled_without_running_the_rule_before(spark, capsys):
    rows = spark.range(3).select(F.sequence(F.lit(1).cast("long"), F.col("id") + 1).alias("rows"))
    told = rows.select(unrolled(F.transform("rows", lambda r: r * 2)).alias("t"))
    told.explain()
    assert "Filter" not in capsys.readouterr().out
    assert sorted(r["t"] for r in told.collect()) == [2, 2, 2, 4, 4, 6]
