import pytest
from pyspark.sql import functions as F

from tablemend.functions import cells as C, rows as R, values as V

CLASSES = {
    "D": ["1989", "2024", "20240101", "2023-01-01", "2023-01-01 10:30", "2023-01-01T10:30:00Z", "01/02/2023", "10:30"],
    "N": ["8", "23", "250", "4.78", "12345", "123456", "1e5", "$5", "1,200", "-3", "inf", "99999999", "1500"],
    "T": ["May", "12 May", "SHP-1001", "now", "2023-02-30x", "été"],
    "M": ["#", "--", "2023-02-30", "12-34", "1.5.2"],
    "E": [None, ""],
}


def test_classify_cell(spark):
    rows = [(v, k) for k, vs in CLASSES.items() for v in vs]
    df = spark.createDataFrame(rows, "v string, want string")
    bad = df.withColumn("got", C.classify_cell(F.col("v"))).filter("got <> want").collect()
    assert bad == []


def test_split_line_ignores_quotes_and_maps_missing_tokens(spark):
    df = spark.createDataFrame([('"a,b"\tN/A; x |null|',)], "line string")
    assert df.select(C.split_line(F.col("line"))).first()[0] == ['"a', 'b"', None, "x", None, None]


def test_roll_by_width_is_identity(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "c array<string>")
    for shift, want in [(0, "abc"), (1, "cab"), (-1, "bca"), (3, "abc"), (-6, "abc"), (4, "cab")]:
        assert "".join(df.select(R.roll(F.col("c"), F.lit(shift))).first()[0]) == want


@pytest.mark.parametrize(
    "raw, weight, delay",
    [("12.5", 12.5, 12.5), ("-1", 250.0, 0.0), ("", 250.0, 0.0), (None, 250.0, 0.0), ("nan", 250.0, 0.0), ("inf", 250.0, 0.0),
     ("1d", 250.0, 0.0), (" 7 ", 7.0, 7.0), ("0", 0.0, 0.0)],
)
def test_weight_and_delay(spark, raw, weight, delay):
    df = spark.createDataFrame([(raw,)], "v string")
    assert tuple(df.select(V.to_weight(F.col("v")), V.to_delay(F.col("v"))).first()) == (weight, delay)


def test_display_forms(spark):
    df = spark.createDataFrame([(30.0, "originHub_name", 1_234_567, None)], "h double, k string, b long, x string")
    got = df.select(
        V.format_delay(F.col("h")), V.format_key(F.col("k")), V.format_bytes(F.col("b")), V.format_bytes(F.col("b"), 2, 1),
        V.short_ext_id(F.col("x")), V.risk_band(F.col("h")), V.format_delay(F.lit(12.5)), V.format_delay(F.lit(4.0)),
        V.display_null(F.lit("—")), V.truncate_label(F.lit("x" * 30)), V.pct_1dp(F.lit(0.28749)),
    ).first()
    assert tuple(got) == (
        "1d 6h", "Origin Hub Name", "1.2 MB", "1.23 MB", "...", "red", "12.5 hrs", "4 hrs", "Not Provided", "x" * 28 + "…", 28.7,
    )


def test_imputed_fields(spark):
    df = spark.createDataFrame([('["a","b","c"]',), ('{"k": 1}',), ("oops",), (None,), ("[1",)], "v string")
    assert [r[0] for r in df.select(V.parse_imputed(F.col("v"))).collect()] == [["a", "b", "c"], [], [], [], []]


def test_brackets_may_overlap(spark):
    df = spark.createDataFrame([(5.0, "high_delay"), (2.0, "failed"), (3.0, "x")], "h double, s string")
    got = df.select(*[V.in_bracket(F.col("h"), F.col("s"), b) for b in ("on_time", "minor_delay", "high_delay")]).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (False, False, True), (True, False, False)]
