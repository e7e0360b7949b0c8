import json

from pyspark.sql import functions as F

from tablemend.sources import dims, files, tables
from tablemend.operators import shipments as S
from tests.fixtures import CHAOTIC, CLEAN, SCIENTIFIC


def test_scans_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CLEAN)
    (tmp_path / "b.txt").write_text("\n" + SCIENTIFIC.replace("\n", "\n\n"))
    (tmp_path / "big.csv").write_text("".join(f"{i},v{i}\n" for i in range(3000)))
    key = F.regexp_extract("file_id", r"([^/]+)$", 1)
    whole = files.scan_matrix(spark, str(tmp_path)).withColumn("file_id", key)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = files.scan_large_matrix(spark, str(tmp_path)).withColumn("file_id", key)
        assert split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0
        chosen = files.scan_matrix(spark, str(tmp_path), whole_bytes=1000).withColumn("file_id", key)
        assert chosen.exceptAll(whole).count() == 0 and whole.exceptAll(chosen).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole.filter("file_id = 'b.txt'").count() == 15


def test_admission(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x")
    (tmp_path / "b.xlsx").write_text("x")
    (tmp_path / "c.pdf").write_text("x")
    (tmp_path / "d.txt").write_text("x" * 100)
    got = files.admit_files(spark, str(tmp_path), max_bytes=50).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["decision"] for r in got} == {
        "a.CSV": "admitted", "b.xlsx": "unsupported", "c.pdf": "rejected_type", "d.txt": "rejected_size",
    }


def test_scan_follows_admission_and_accounts_for_every_file(spark, tmp_path):
    (tmp_path / "sub" / "deep one").mkdir(parents=True)
    (tmp_path / "a.csv").write_text(CLEAN)
    (tmp_path / "sub" / "b.TXT").write_text(SCIENTIFIC)
    (tmp_path / "sub" / "deep one" / "c+d.csv").write_text("x,y\n1,2\n")
    (tmp_path / "sheet.xlsx").write_bytes(b"PK\x03\x04" + bytes(50))
    (tmp_path / "sub" / "paper.pdf").write_text("text")
    (tmp_path / "binary.csv").write_bytes(bytes(range(256)) * 4)
    (tmp_path / "empty.csv").write_text(" \n\n")
    (tmp_path / "large.csv").write_text("1,2\n" * 1000)
    scan = files.scan_admitted(spark, str(tmp_path), max_bytes=3000)
    name = lambda path: path.rsplit("/", 1)[1]
    found = {name(r["path"]): (r["status"], r["error_message"], r["rows_total"]) for r in scan.files.collect()}
    rows = {name(r["file_id"]).replace("%20", " "): r["n"] for r in scan.rows.groupBy("file_id").agg(F.count("*").alias("n")).collect()}
    assert found == {
        "a.csv": ("read", None, rows["a.csv"]), "b.TXT": ("read", None, rows["b.TXT"]), "c+d.csv": ("read", None, 2),
        "sheet.xlsx": ("refused", "unsupported", 0), "paper.pdf": ("refused", "rejected_type", 0),
        "large.csv": ("refused", "rejected_size", 0), "binary.csv": ("failed", "binary content", 0),
        "empty.csv": ("failed", "nothing could be read", 0),
    }
    assert set(rows) == {"a.csv", "b.TXT", "c+d.csv"}
    # the plain scan reads the same files, nested ones too
    whole = {name(r["file_id"]) for r in files.scan_matrix(spark, str(tmp_path)).select("file_id").distinct().collect()}
    assert whole == {"a.csv", "b.TXT", "c+d.csv", "binary.csv", "large.csv"}


def test_log_lifecycle(spark):
    opened = spark.sql("SELECT * FROM VALUES (1L, 'a.csv', 10L, TIMESTAMP'2024-01-01'), (2L, 'b.csv', 20L, TIMESTAMP'2024-01-02'), (3L, 'c.csv', 5L, TIMESTAMP'2024-01-02') AS t(id, filename, file_size_bytes, uploaded_at)")
    done = spark.sql("SELECT * FROM VALUES (1L, 5L, 1L, 0.9D, CAST(NULL AS STRING), TIMESTAMP'2024-01-03'), (2L, 0L, 0L, 0D, 'bad', TIMESTAMP'2024-01-03') AS t(id, rows_total, rows_repaired, reconstruction_confidence, error_message, processed_at)")
    state = tables.latest_log(tables.log_events(opened, done))
    assert {r["id"]: r["status"] for r in state.collect()} == {1: "success", 2: "failed", 3: "processing"}
    assert tables.log_status(state, 2).first()["error_message"] == "bad"


def test_envelope_is_valid_json_and_split(spark):
    rows = spark.createDataFrame([("f", i, f"S{i}", "A", "B", "m", 1.0, 2.0, "ok") for i in range(5)], "file_id string, row_idx long, shipment_id string, origin_hub string, destination_hub string, material_type string, weight_kg double, predicted_delay_hours double, status string")
    per_file = spark.createDataFrame([("f", 0.9, 1)], "file_id string, confidence double, anomalies_repaired int")
    parts = tables.to_envelope(rows, per_file, block_rows=3).orderBy("part").collect()
    data = [json.loads(p["envelope"]) for p in parts]
    assert [len(d["data"]) for d in data] == [3, 2]
    assert data[0]["status"] == "reconstructed" and data[0]["data"][1]["shipment_id"] == "S1"


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"x": "a", "y": "1"}
    for _ in range(2):
        tables.write_shipments(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path), "t").count() == 2


def test_dimensions_and_routes(spark):
    assert dims.dim_vendors(spark).count() == 9 and dims.dim_hubs(spark).count() == 16 and dims.dim_geo_hubs(spark).count() == 19
    rows = spark.sql("SELECT * FROM VALUES (17L, 'SHP-1', 'ICN-HUB-01', '', 'Delayed', 5D, 0D), (3L, '', 'NOPE', 'OSL-HUB-01', CAST(NULL AS STRING), CAST(NULL AS DOUBLE), 120D) AS t(id, shipment_id, origin_hub, destination_hub, status, predicted_delay_hours, freight_cost_usd)")
    got = {r["id"]: r for r in S.routes(rows, dims.dim_hubs(spark)).collect()}
    assert got["17"]["to_hub"] == "BOM-PORT-01" and got["17"]["status"] == "high_delay" and got["17"]["freight_cost_usd"] == 4500.0
    assert got["3"]["shipment_id"] == "SHP-3" and got["3"]["from_lat"] == 22.5937 and got["3"]["status"] == "on_time"
    box = S.bounding_box(S.routes(rows, dims.dim_hubs(spark))).first()
    assert (box["min_lat"], box["max_lat"], box["n_points"]) == (18.9388, 59.9139, 4)


def test_legacy_zero_weight(spark):
    rows = spark.sql("SELECT 'a' AS shipment_id, '' AS origin_hub, 'X' AS destination_hub, '' AS material_type, 0D AS weight_kg, 1D AS predicted_delay_hours, '' AS status")
    assert S.ingest_defaults(rows).first()["weight_kg"] == 0.0
    assert S.ingest_defaults(rows, legacy_zero=True).first()["weight_kg"] == 250.0
