from pyspark.sql import functions as F

from tablemend.operators import shipments as S
from tablemend.plans import manifest as M
from tablemend.sources import dims, files
from tests.fixtures import ALIASED, CHAOTIC, CLEAN


def raw(spark, **texts):
    df = spark.createDataFrame(list(texts.items()), "file_id string, text string")
    return files.with_width(files.rows_from_lines(files.explode_text(df, "file_id", F.col("text"))))


def test_headers_and_mapping_of_the_chaotic_manifest(spark):
    row = M.column_mapping(raw(spark, chaotic=CHAOTIC)).first()
    assert row["horizon"] == 3
    assert row["headers"] == [
        "consignment_parcel ref_id", "type", "journey_stops_from_hub", "to_hub", "load_goods_mass class",
        "forecast_lateness_hours late", "progress_stage_state",
    ]
    assert row["columns"].asDict() == {
        "shipment_id": 0, "origin_hub": 2, "destination_hub": 3, "material_type": 1, "weight_kg": 4,
        "predicted_delay_hours": 5, "status": 6,
    }


def test_three_manifests_in_one_job(spark):
    rows = M.process_manifest(raw(spark, clean=CLEAN, aliased=ALIASED, chaotic=CHAOTIC)).collect()
    by_file = {f: sorted((r for r in rows if r["file_id"] == f), key=lambda r: r["row_idx"]) for f in ("clean", "aliased", "chaotic")}
    assert [len(by_file[f]) for f in ("clean", "aliased", "chaotic")] == [5, 6, 20]

    first = by_file["clean"][0].asDict()
    assert first["origin_hub"] == "LISBON" and first["weight_kg"] == 310.25 and first["predicted_delay_hours"] == 6.5
    assert by_file["aliased"][4]["weight_kg"] == 96.25 and by_file["aliased"][4]["status"] == "held"

    chaotic = by_file["chaotic"]
    assert {r["weight_kg"] for r in chaotic} == {250.0}
    assert [r["shipment_id"] for r in chaotic].count("SHP-40") == 2
    assert [r["predicted_delay_hours"] for r in chaotic if r["shipment_id"] in ("SHP-46", "SHP-54")] == [0.0, 0.0]
    assert [r["material_type"] for r in chaotic if r["shipment_id"] in ("SHP-48", "SHP-53")] == ["General Cargo"] * 2
    assert {r["status"] for r in chaotic} == {"queued", "lost", "delivered", "slight_delay"}


def test_unmapped_columns_are_allocated_in_order(spark):
    text = "shipment_id,aa,bb,cc,dd\nSHP-1,X,9.5,Y,\nSHP-2,Z,-,W,7"
    cols = M.column_mapping(raw(spark, f=text)).select("columns.*").first().asDict()
    # texts fill origin, destination; then numbers; numeric targets prefer numbers
    assert cols == {
        "shipment_id": 0, "origin_hub": 1, "destination_hub": 3, "material_type": 2, "weight_kg": 4,
        "predicted_delay_hours": None, "status": None,
    }


def test_report_balances(spark):
    text = CLEAN + "shipment_id,a,b,c,1,2,x\n,q,q,q,1,1,q\n"
    row = M.manifest_report(raw(spark, f=text)).first()
    assert (row["rows_in"], row["rows_out"], row["rows_rejected"], row["confidence"]) == (7, 5, 2, 0.88)


def test_new_shipments_and_storage(spark):
    rows = M.process_manifest(raw(spark, chaotic=CHAOTIC))
    existing = spark.createDataFrame([("SHP-41",), (None,)], "shipment_id string")
    assert S.new_shipments(rows, existing).count() == 19
    once = S.new_shipments(rows, existing, dedup="file")
    assert once.count() == 18
    stored = S.to_stored(once, dims.dim_geo_hubs(spark), F.lit("log-1"))
    got = stored.filter("shipment_id = 'SHP-40'").first()
    assert (got["origin_lat"], got["destination_lng"], got["external_id"]) == (42.3601, -122.3321, "SHP-40")


def test_unknown_hubs_take_the_defaults(spark):
    rows = spark.createDataFrame([("x", "NOWHERE", "DEL_HUB"), ("y", "BOSTON", "?")], "shipment_id string, origin_hub string, destination_hub string")
    got = {r["shipment_id"]: r for r in S.geo_enrich(rows, dims.dim_geo_hubs(spark)).collect()}
    assert got["x"]["origin_lat"] == 19.0760 and got["y"]["origin_lat"] == 42.3601 and got["y"]["destination_lat"] == 28.7041
