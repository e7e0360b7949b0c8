import pytest
from pyspark.sql import functions as F

from tablemend.operators import strategies as ST
from tablemend.operators.headers import periodicity_strength
from tablemend.operators.profile import active_rows, profile_rows
from tablemend.plans.manifest import PASS_THROUGH_CONFIDENCE, manifest_report
from tablemend.plans.reconstruct import confidences, reconstruct
from tablemend.session import cut
from tablemend.streaming.jobs import batch_log
from tests.test_blocks import exchanges

PLOTS = ((31, "Loam", "Barley", "Low"), (32, "Clay", "Barley", "Low"), (33, "Sand", "Oats", "High"), (34, "Loam", "Rye", "Low"))
TABLES = {
    "segmented": (
        ["ID", "Person", "Joined", "Points", "Remark"],
        [["7", "Nadia", "2021-05-04", "61", "Slow start"], ["8", "Tomas", "2021-06-09", "74", "Steady climb"]],
    ),
    "positional": (
        ["ID", "Person", "missing_header_1", "missing_header_1_1"],
        [["7", "Nadia", "61", "2021-05-04"], ["8", "Tomas", "74", "2021-06-09"]],
    ),
    "scientific": (
        ["plot_id", "depth", "soil", "rain_mm", "sun_hours", "runoff", "humidity", "crop_name", "canopy_index", "root_index",
         "yield_kg", "pest_score", "risk_level", "quality"],
        [
            [str(n), str(n - 13), soil, *(f"{n * x:.2f}" for x in (0.13, 0.21, 0.17, 2.07)), crop, f"{n * 0.09:.2f}", f"{n * 0.3:.1f}",
             f"{n * 8.51:.2f}", f"{n * 0.37:.2f}", risk, f"{n * 1.93:.2f}"]
            for n, soil, crop, risk in PLOTS
        ],
    ),
}


def result(r):
    names = {x["file_id"]: x["names"] for x in r.names.collect()}
    records: dict = {}
    for x in sorted(r.records.collect(), key=lambda x: (x["file_id"], x["record_id"])):
        records.setdefault(x["file_id"], []).append(x["values"])
    return names, records


@pytest.fixture(scope="module")
def whole(spark, fixture_rows):
    return reconstruct(fixture_rows)


def test_fixture_tables(whole):
    names, records = result(whole)
    for file_id, (want_names, want_records) in TABLES.items():
        assert names[file_id] == want_names
        assert records[file_id] == want_records


def test_headers_of_fixtures(whole):
    starts = {r["file_id"]: r["data_start"] for r in whole.structure.files.collect()}
    assert starts == {"segmented": 3, "positional": 1, "streamed": 1, "scientific": 3, "anchored": 2, "clean": 1, "chaotic": 3}


def test_confidences_are_fractions_and_every_file_has_a_strategy(whole):
    report = whole.report.collect()
    assert {r["file_id"] for r in report} == {"segmented", "positional", "streamed", "scientific", "anchored", "clean", "chaotic"}
    assert all(0 <= r["global_confidence"] <= 1 and 0 <= r["confidence_score"] <= 100 for r in report)
    assert all(0 <= v <= 1 for r in report for v in r["layers"].values())


def test_manifest_report_takes_the_confidence_of_rebuilt_tables(fixture_rows, whole):
    _, records = result(whole)
    fixed = {
        r["file_id"]: (r["correction"]["confidence"] * 100 if r["correction"] else r["confidence_score"])
        for r in whole.report.collect()
    }
    want = {
        f: (fixed[f] / 100 if fixed[f] > 1 else fixed[f]) if len(records.get(f, [])) > 1 else PASS_THROUGH_CONFIDENCE
        for f in {r["file_id"] for r in fixture_rows.select("file_id").distinct().collect()}
    }
    measured = confidences(whole)
    got = {r["file_id"]: r["confidence"] for r in manifest_report(fixture_rows, measured).collect()}
    assert set(got) <= set(want) and {"clean", "chaotic"} <= set(got)
    assert got == pytest.approx({f: want[f] for f in got})
    assert any(c != PASS_THROUGH_CONFIDENCE for c in got.values())
    one = measured.filter("file_id = 'clean'")
    rest = {r["file_id"]: r["confidence"] for r in manifest_report(fixture_rows, one).collect()}
    assert {rest[f] for f in rest if f != "clean"} == {PASS_THROUGH_CONFIDENCE}
    assert "reconstruction_confidence" in str(batch_log(fixture_rows, measured=measured).schema)


def test_block_size_and_partitioning_do_not_matter(spark, fixture_rows, whole):
    again = reconstruct(fixture_rows.repartition(7), block_rows=16)
    assert result(again) == result(whole)


def test_streaming_strategy_rechunks(spark, fixture_rows, whole):
    used = {(r["file_id"], r["strategy"]): r["base"] for r in whole.strategies.collect()}
    assert used["streamed", "StreamingStrategy"] == "stream"
    assert used["segmented", "StreamingStrategy"] == "blueprint"


def test_registered_strategy_competes(spark, fixture_rows):
    def first_cells(ctx):
        return ctx.data.select("file_id", F.col("j").alias("record_id"), F.slice("cells", 1, 1).alias("values"))

    ST.register_strategy("FirstCell", first_cells)
    try:
        r = reconstruct(fixture_rows.filter("file_id = 'segmented'"))
        assert {x["strategy"] for x in r.strategies.collect()} == set(ST.STRATEGIES) | {"FirstCell"}
        with pytest.raises(ValueError):
            ST.register_strategy("FirstCell", first_cells)
    finally:
        ST.unregister_strategy("FirstCell")


def naive_strength(signatures, start):
    """Search every chunking of the suffix."""
    tail = signatures[start:]
    for span in range(2, min(8, len(tail)) + 1):
        if len(tail) < 2 * span:
            return 0.0
        shares = []
        for offset in range(span):
            blocks = [tuple(tail[i : i + span]) for i in range(offset, len(tail) - span + 1, span)]
            top = max(map(blocks.count, blocks)) if len(blocks) >= 2 else 0
            shares.append(top / len(blocks) if blocks else 0.0)
        if any(s > 0.6 for s in shares):
            return shares[0] * 35.0
    return 0.0


def test_periodicity_against_search(spark, fixture_rows):
    active = active_rows(profile_rows(fixture_rows), block_rows=16).cache()
    by_file: dict = {}
    for r in sorted(active.collect(), key=lambda r: (r["file_id"], r["seq"])):
        by_file.setdefault(r["file_id"], []).append(r["signature"])
    got = {(r["file_id"], r["seq"]): r["periodic"] for r in periodicity_strength(active, block_rows=16).collect()}
    for file_id, signatures in by_file.items():
        for start in range(len(signatures)):
            assert got.get((file_id, start), 0.0) == pytest.approx(naive_strength(signatures, start))


def test_suffixes_are_dealt_once(spark, fixture_rows):
    """Rows become one per span only after they are dealt, also where blocks of long files hand counts on."""
    active = cut(active_rows(profile_rows(fixture_rows)))
    whole = periodicity_strength(active)
    keys = exchanges(whole)
    assert keys.count("file_id, _blk") == 1 and not any("span" in k or "seq" in k for k in keys)
    told = lambda df: sorted((r["file_id"], r["seq"], r["periodic"]) for r in df.collect())
    assert told(whole) == told(periodicity_strength(active, block_rows=8)) != []
