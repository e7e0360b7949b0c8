from tablemend.sources import dims, tables
from tablemend.streaming import jobs as J
from tablemend.streaming.sinks import read_batches
from tests.fixtures import ALIASED, CHAOTIC, CLEAN


def test_ingest_restarts_without_new_rows(spark, tmp_path):
    source, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.csv").write_text(CLEAN)
    (source / "b.csv").write_text(CHAOTIC)
    log = str(tmp_path / "log")
    run = lambda: J.drain(J.stream_ingest(spark, str(source), store, state, dims.dim_geo_hubs(spark), files_per_batch=1, log=log))
    stored = lambda: read_batches(spark, store, J.STORED_SCHEMA)
    run()
    assert stored().count() == 25
    run()
    assert stored().count() == 25
    # ids seen before are dropped, new ones are added
    (source / "c.csv").write_text(CLEAN)
    (source / "d.csv").write_text(ALIASED)
    run()
    assert stored().count() == 31
    assert {r[0] for r in stored().select("ingestion_log_id").distinct().collect()} == {"a.csv", "b.csv", "d.csv"}
    # a file without shipments is logged as failed
    (source / "e.csv").write_text("shipment_id,origin_hub\n")
    run()
    state_of = {r["filename"]: (r["status"], r["rows_total"]) for r in tables.latest_log(read_batches(spark, log, J.LOG_SCHEMA).drop("batch_id")).collect()}
    assert state_of == {"a.csv": ("success", 5), "b.csv": ("success", 20), "c.csv": ("success", 5), "d.csv": ("success", 6), "e.csv": ("failed", 0)}


def test_files_that_are_no_manifests_fail_alone(spark, tmp_path):
    source, store, state, log = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state"), str(tmp_path / "log")
    (source / "nested").mkdir(parents=True)
    (source / "nested" / "a.csv").write_text(CLEAN)
    (source / "sheet.xlsx").write_bytes(b"PK\x03\x04" + bytes(50))
    (source / "binary.csv").write_bytes(bytes(range(256)) * 4)
    J.drain(J.stream_ingest(spark, str(source), store, state, dims.dim_geo_hubs(spark), log=log))
    assert read_batches(spark, store, J.STORED_SCHEMA).count() == 5
    logged = tables.latest_log(read_batches(spark, log, J.LOG_SCHEMA).drop("batch_id")).collect()
    assert {r["filename"]: (r["status"], r["error_message"], r["rows_total"]) for r in logged} == {
        "a.csv": ("success", None, 5), "sheet.xlsx": ("failed", "unsupported", 0), "binary.csv": ("failed", "binary content", 0),
    }


def test_a_batch_run_twice_overwrites_itself(spark, tmp_path):
    store = str(tmp_path / "store")
    lines = [("file:/x/a.csv", 0, line) for line in CLEAN.splitlines()]
    batch = spark.createDataFrame(lines, "file_id string, split_start long, line string").coalesce(1)
    step = J.ingest_batch(dims.dim_geo_hubs(spark), store)
    step(batch, 0)
    step(batch, 0)
    assert read_batches(spark, store, J.STORED_SCHEMA).count() == 5
