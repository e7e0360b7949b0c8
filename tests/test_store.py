import os

import pytest
from pyspark.sql import functions as F

from tablemend.operators import shipments as S
from tablemend.sources import dims
from tablemend.sources.store import KeyedStore
from tablemend.streaming import jobs as J
from tests.fixtures import ALIASED, CHAOTIC, CLEAN

SCHEMA = "shipment_id string, status string"


def rows_of(spark, ids, status="ok"):
    data = [(key, status, place) for place, key in enumerate(ids)]
    return spark.createDataFrame(data, f"{SCHEMA}, place long")


def listing(store, spark):
    return [(r["id"], r["shipment_id"]) for r in store.rows(spark).orderBy("id").collect()]


def files_below(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def store(tmp_path):
    return KeyedStore(str(tmp_path / "store"), SCHEMA, buckets=8, segment_rows=10)


def test_numbers_follow_arrival_and_stored_keys_are_left_out(spark, store):
    first = [f"S{i:03d}" for i in range(25)]
    store.append(rows_of(spark, first), 0, ["place"])
    assert listing(store, spark) == list(enumerate(first, 1))
    store.append(rows_of(spark, ["S003", "T1", "T1", None, "S024", "T0"]), 1, ["place"])
    # copies inside a batch stay, NULL keys are never known
    assert listing(store, spark)[25:] == [(26, "T1"), (27, "T1"), (28, None), (29, "T0")]
    assert store.total(spark).first()[0] == 29


def test_a_batch_run_again_changes_nothing(spark, store):
    for batch_id, ids in ((0, ["a", "b"]), (1, ["b", "c"]), (1, ["b", "c"]), (2, [])):
        store.append(rows_of(spark, ids), batch_id, ["place"])
    assert listing(store, spark) == [(1, "a"), (2, "b"), (3, "c")]
    # a batch cut short before its fences were written is not visible
    rows_of(spark, ["x"]).select(F.lit(4).cast("long").alias("id"), "shipment_id", "status", F.lit(0).alias("segment")).write.partitionBy(
        "segment"
    ).parquet(f"{store.path}/rows/batch_id=3")
    assert len(listing(store, spark)) == 3
    store.append(rows_of(spark, ["y"]), 3, ["place"])
    assert listing(store, spark)[3:] == [(4, "y")]


def test_only_near_buckets_and_batches_are_opened(spark, store):
    store.append(rows_of(spark, [f"A{i:03d}" for i in range(50)]), 0, ["place"])
    store.append(rows_of(spark, [f"B{i:03d}" for i in range(50)]), 1, ["place"])
    known = store.known(rows_of(spark, ["B007"]))
    assert [r[0] for r in known.collect()] == ["B007"]
    filters = known._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    # B007 lies in no span of the first batch, and in one bucket
    bucket = spark.sql("SELECT pmod(xxhash64('B007'), 8L)").first()[0]
    assert f"= {bucket})" in filters and "batch_id" in filters and "= 1)" in filters
    # a key outside every span opens nothing
    assert store.known(rows_of(spark, ["Z"])).count() == 0


def test_pages_equal_sorting_everything(spark, store):
    store.append(rows_of(spark, [f"S{i:03d}" for i in range(47)]), 0, ["place"])
    store.append(rows_of(spark, [f"T{i:03d}" for i in range(13)], "late"), 1, ["place"])
    for gone in (60, 31, 1, 45, 999):
        store.delete(spark, gone)
    for where in (None, F.col("status") == "ok", F.col("id") % 3 == 0, F.col("status") == "none"):
        rows = store.rows(spark) if where is None else store.rows(spark).filter(where)
        expected = sorted((r["id"] for r in rows.collect()), reverse=True)
        for limit, pages in ((7, (1, 2, 5)), (200, (1, 2))):
            for page in pages:
                got = [r["id"] for r in store.page(spark, page, limit, where).collect()]
                assert got == expected[(page - 1) * limit : page * limit], (limit, page)


def test_a_page_reads_its_numbers_only(spark, store):
    store.append(rows_of(spark, [f"S{i:03d}" for i in range(100)]), 0, ["place"])
    page = store.page(spark, page=6, limit=5)
    assert [r["id"] for r in page.collect()] == [75, 74, 73, 72, 71]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "segment" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(id,71)" in plan and "LessThanOrEqual(id,75)" in plan


def test_delete_rewrites_one_segment_and_one_bucket(spark, store):
    store.append(rows_of(spark, [f"S{i:03d}" for i in range(35)]), 0, ["place"])
    before = files_below(store.path)
    store.delete(spark, 14)
    changed = {os.path.dirname(f).removeprefix(store.path) for f in before ^ files_below(store.path)}
    tables = sorted(folder.split("/")[1] for folder in changed)
    assert tables == ["fences", "keys", "rows"] and any(f.endswith("segment=1") for f in changed)
    assert 14 not in {i for i, _ in listing(store, spark)} and store.total(spark).first()[0] == 34
    store.delete(spark, 14)
    assert store.total(spark).first()[0] == 34
    # a deleted key may come again, under a new number
    assert store.lookup(spark, "S013").count() == 0
    store.append(rows_of(spark, ["S013", "S014"]), 1, ["place"])
    assert listing(store, spark)[-1] == (36, "S013")


def test_a_segment_may_become_empty(spark, store):
    store.append(rows_of(spark, [f"S{i:03d}" for i in range(11)]), 0, ["place"])
    store.delete(spark, 11)
    assert [r["id"] for r in store.page(spark, 1, 3).collect()] == [10, 9, 8]
    store.append(rows_of(spark, ["new"]), 1, ["place"])
    assert store.lookup(spark, "new").first()["id"] == 12


def test_lookup_takes_the_lowest_copy(spark, store):
    assert store.lookup(spark, "a").count() == 0
    store.append(rows_of(spark, ["b", "a", "a"]), 0, ["place"])
    assert store.lookup(spark, "a").first()["id"] == 2
    assert store.by_id(spark, 3).first()["shipment_id"] == "a" and store.by_id(spark, 77).count() == 0


def test_ingested_rows_are_served(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    (source / "a.csv").write_text(CLEAN)
    (source / "b.csv").write_text(CHAOTIC)
    store = KeyedStore(str(tmp_path / "store"), J.STORED_SCHEMA)
    run = lambda: J.drain(J.stream_ingest(spark, str(source), store, state, dims.dim_geo_hubs(spark), files_per_batch=1))
    run()
    assert store.total(spark).first()[0] == 25
    (source / "c.csv").write_text(CLEAN)
    (source / "d.csv").write_text(ALIASED)
    run()
    assert [r["id"] for r in store.rows(spark).orderBy("id").collect()] == list(range(1, 32))
    row = store.by_id(spark, 1).first()
    assert store.lookup(spark, row["shipment_id"]).first()["id"] == 1
    assert S.get_shipment(store.rows(spark), row["shipment_id"]).first()["id"] == 1


def test_a_stream_is_deduplicated_against_the_index(spark, tmp_path):
    source, state, schema = tmp_path / "in", str(tmp_path / "state"), "k string, ts timestamp"
    source.mkdir()
    store = KeyedStore(str(tmp_path / "store"), schema, key="k", buckets=4)
    for name, day, keys in (("a", 1, "xyx"), ("b", 20, "xz")):
        lines = [f'{{"k": "{key}", "ts": "2024-01-{day:02d}T00:00:00"}}' for key in keys]
        (source / f"{name}.json").write_text("\n".join(lines))
        rows = spark.readStream.schema(schema).json(str(source))
        J.drain(J.stream_dedup(rows, "k", "ts", "1 day", store, schema, state))
    assert [(r["id"], r["k"]) for r in store.rows(spark).orderBy("id").collect()] == [(1, "x"), (2, "y"), (3, "z")]
