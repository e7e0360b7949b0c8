"""Logistics queries on tables built here."""

from queries import registry


def test_sums_beyond_a_long_end_no_file(spark, tmp_path):
    """Row indices of one file may add up to more than a BIGINT holds; the other files keep their sums."""
    keys = [60_000_000_000, 60_000_001_000, 7]
    tables = {
        "lineitem": ([(k, 1, 2, 1, 5.0, "R", "O", "1995-01-01") for k in keys],
                     "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long, l_quantity double, "
                     "l_returnflag string, l_linestatus string, l_shipdate string"),
        "part": ([(1, "STEEL", 3)], "p_partkey long, p_type string, p_size long"),
        "supplier": ([(2, 0)], "s_suppkey long, s_nationkey long"),
        "orders": ([(k, 1) for k in keys], "o_orderkey long, o_custkey long"),
        "customer": ([(1, 0)], "c_custkey long, c_nationkey long"),
        "nation": ([(0, "NATION_0")], "n_nationkey long, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = registry()["new_shipments_first_copy"].run(spark, str(tmp_path))
    assert dict(found.dtypes)["s"] == "bigint"
    assert {r["file_id"]: (r["n"], r["s"]) for r in found.collect()} == {0: (2, None), 7: (1, 701 * 1_000_000 + 2)}
