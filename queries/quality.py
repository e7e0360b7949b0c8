"""Queries on the quality of candidate tables: types, alignment, coherence, shifts, choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.operators import align as A, records as K, strategies as ST, validate as V
from tablemend.plans import reconstruct as RC

from . import Query
from . import inputs as I
from .inputs import class_sql, number_sql
from .matrix import DATE_WORDS, KEY_WORDS, NUM_WORDS, anchor_hit_sql, near

# orders as candidate tables of 24 files; odd files hold their columns rotated by one
BASE = """
SELECT CAST(o_orderkey % 24 AS VARCHAR(20)) AS file_id, o_orderkey % 2 AS odd, CAST(floor(o_orderkey / 24) AS BIGINT) AS record_id,
  concat('ORD-', o_orderkey % 4000) AS a,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS b,
  CASE WHEN o_orderkey % 24 < 3 AND o_orderkey % 5 = 0 THEN 'n.a.' ELSE concat(CAST(o_totalprice AS DECIMAL(18,2)), '') END AS c,
  o_orderpriority AS d, CAST(NULL AS VARCHAR(20)) AS e
FROM {orders}
"""
NAMES = ["order id", "order date", "total price", "order date", "remark"]
PLAIN = "SELECT file_id, record_id, a AS v0, b AS v1, c AS v2, d AS v3, e AS v4 FROM ({})"
ROTATED = (
    "SELECT file_id, record_id, CASE WHEN odd = 1 THEN e ELSE a END AS v0, CASE WHEN odd = 1 THEN a ELSE b END AS v1, "
    "CASE WHEN odd = 1 THEN b ELSE c END AS v2, CASE WHEN odd = 1 THEN c ELSE d END AS v3, CASE WHEN odd = 1 THEN d ELSE e END AS v4 FROM ({})"
)


def _table(spark, sf_dir, sql, variant):
    wide = I.spark_view(spark, sf_dir, sql.format(BASE), "orders")
    return wide.select("file_id", F.lit(variant).alias("variant"), "record_id", F.array(*[f"v{i}" for i in range(5)]).alias("values"))


def _tables(spark, sf_dir):
    return _table(spark, sf_dir, PLAIN, "plain").unionByName(_table(spark, sf_dir, ROTATED, "rotated"))


def _names(tables):
    return tables.select("file_id", "variant").distinct().withColumn("names", F.array(*[F.lit(n) for n in NAMES]))


def _long(sql, variant):
    return " UNION ALL ".join(
        f"SELECT file_id, '{variant}' AS variant, record_id, CAST({i} AS BIGINT) AS col, '{NAMES[i]}' AS name, v{i} AS val FROM ({sql})" for i in range(5)
    )


MATCH = (
    "CASE cls WHEN 'E' THEN 0.5 WHEN 'D' THEN (CASE WHEN h = 'datetime' THEN 1.0 ELSE 0.0 END) "
    "WHEN 'N' THEN (CASE h WHEN 'numeric' THEN 1.0 WHEN 'categorical' THEN 0.8 ELSE 0.0 END) ELSE (CASE WHEN h = 'categorical' THEN 1.0 ELSE 0.0 END) END"
)
INTERNAL = (
    "CASE WHEN cls = 'E' OR (cls = 'D' AND h = 'datetime') OR (cls = 'N' AND h = 'numeric') OR (cls IN ('T', 'M') AND h = 'categorical') THEN 1.0 "
    "WHEN h = 'categorical' THEN 0.5 ELSE 0.0 END"
)
H = f"CASE WHEN regexp_matches(lower(name), {DATE_WORDS}) THEN 'datetime' WHEN regexp_matches(lower(name), {NUM_WORDS}) THEN 'numeric' ELSE 'categorical' END"

CELLS = f"""
raw AS ({_long(PLAIN.format(I.duck(BASE)), 'plain')} UNION ALL {_long(ROTATED.format(I.duck(BASE)), 'rotated')}),
t AS (SELECT *, {class_sql('val')} AS cls, {H} AS h FROM raw),
m AS (SELECT *, {MATCH} AS match, {INTERNAL} AS inner_match FROM t),
cs AS (SELECT file_id, variant, col, any_value(name) AS name, count(*) AS n, count(val) AS nn, sum(CASE WHEN val IS NOT NULL AND {number_sql('val')} THEN 1 ELSE 0 END) AS plain,
  sum(CASE WHEN cls = 'D' THEN 1 ELSE 0 END) AS nd, sum(CASE WHEN cls = 'N' THEN 1 ELSE 0 END) AS nnum, sum(CASE WHEN cls = 'T' THEN 1 ELSE 0 END) AS nt,
  sum(CASE WHEN cls = 'M' THEN 1 ELSE 0 END) AS nm, CASE WHEN count(val) = 0 THEN 0.5 ELSE sum(CASE WHEN val IS NOT NULL THEN match ELSE 0 END) / count(val) END AS fit FROM m GROUP BY ALL),
sem AS (SELECT file_id, variant, avg(fit) AS semantic, count(*) FILTER (WHERE fit < 0.5) AS bad FROM cs GROUP BY ALL),
rw AS (SELECT file_id, variant, record_id, avg(match) AS ra, least(1.0, avg(inner_match) + max(CASE WHEN col = 0 AND {anchor_hit_sql('val')} THEN 0.1 ELSE 0 END)) AS ic FROM m GROUP BY ALL),
ral AS (SELECT file_id, variant, avg(ra) AS ra, avg(ic) AS ic FROM rw GROUP BY ALL),
dup AS (SELECT file_id, variant, val, count(*) AS copies FROM t WHERE col = 0 AND val IS NOT NULL GROUP BY ALL),
uq AS (SELECT file_id, variant, count(*) / CAST(sum(copies) AS DOUBLE) AS u, count(*) FILTER (WHERE copies > 1) AS d FROM dup GROUP BY ALL),
shp AS (SELECT file_id, variant, max(n) AS row_count, count(*) AS col_count, 1.0 - sum(nn) / CAST(sum(n) AS DOUBLE) AS nr, count(*) FILTER (WHERE nn > 0 AND plain = nn) AS numeric_cols,
  coalesce(avg(greatest(nd, nnum, nt, nm) / CAST(nn AS DOUBLE)) FILTER (WHERE nn > 0), 0.0) AS sig FROM cs GROUP BY ALL),
rep AS (SELECT s.file_id, s.variant, semantic, bad, ra, ic, coalesce(u, 1.0) AS u, coalesce(d, 0) AS d, row_count, col_count, nr, numeric_cols, sig,
  0.4 * ra + 0.3 * coalesce(u, 1.0) + 0.3 * ic AS coherence FROM sem s JOIN ral USING (file_id, variant) JOIN shp USING (file_id, variant) LEFT JOIN uq USING (file_id, variant)),
sco AS (SELECT *, round(least(1.0, greatest(0.0, 0.22 * (CASE WHEN semantic < 0.45 THEN semantic * 0.5 ELSE semantic END) + 0.18 * coherence + 0.14 * sig + 0.12 * (1 - 0.85 * nr)
  + 0.10 * (1 - nr) + 0.12 * numeric_cols / col_count + 0.07 * u + 0.05 * greatest(0.0, 1 - 0.15 * d))) * 100.0, 2) AS score FROM rep),
sh AS (SELECT a.file_id, a.variant, s.s, avg(CASE WHEN b.nn = 0 THEN 0.5 ELSE f.x / b.nn END) AS semantic, sum(f.x + 0.5 * (b.n - b.nn)) / sum(b.n) AS base FROM cs a
  CROSS JOIN (SELECT unnest(range(-4, 5)) AS s) s JOIN cs b ON b.file_id = a.file_id AND b.variant = a.variant AND b.col = (a.col - s.s + 10) % 5,
  LATERAL (SELECT {H.replace('name', 'a.name')} AS h) hh, LATERAL (SELECT CASE hh.h WHEN 'datetime' THEN b.nd WHEN 'numeric' THEN b.nnum ELSE b.nt + b.nm + 0.8 * b.nnum END AS x) f GROUP BY ALL),
bs AS (SELECT file_id, variant, s AS shift, round(least(1.0, 0.6 * semantic + 0.4 * base), 12) AS score,
  row_number() OVER (PARTITION BY file_id, variant ORDER BY round(least(1.0, 0.6 * semantic + 0.4 * base), 12) DESC, CASE WHEN s = 0 THEN 0 ELSE 1 END, s) AS rn FROM sh)
"""


def _sql(body: str) -> str:
    return f"WITH {CELLS} {body}"


def _report(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return V.strategy_score(V.validate(t, _names(t)))


def _counted(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return V.table_columns(V.column_counts(t)).join(_names(t), V.KEYS)


def _keys(df):
    """Identifier column of each table by name."""
    return df.select(*V.KEYS, F.get(V.anchor_positions(F.col("names")), F.lit(0)).alias("anchor_col"))


def _scored_variants(spark, sf_dir):
    return _report(spark, sf_dir).select(
        "file_id", F.when(F.col("variant") == "plain", 0).otherwise(1).alias("ordinal"), F.col("variant").alias("strategy"),
        F.col("variant").alias("base"), "confidence_score",
    )


def _aligned_tables(spark, sf_dir):
    t = _table(spark, sf_dir, ROTATED, "rotated")
    counted = V.table_columns(V.column_counts(t))
    extracted = t.select("file_id").distinct().withColumn("header_names", F.array(*[F.lit(n) for n in NAMES[:4]]))
    named = A.align_names(counted, extracted)
    return A.shift_columns(t, named).join(named.select(*V.KEYS, "names"), V.KEYS).select(
        "file_id", "record_id", F.array_join("names", "|").alias("names"), F.array_join("values", "|", "~").alias("joined")
    )


def _doc_strategies(spark, sf_dir):
    r = RC.reconstruct(I.doc_rows(spark, sf_dir))
    return r.strategies.select("file_id", "strategy", "base", "confidence_score")


def _doc_records(spark, sf_dir):
    r = RC.reconstruct(I.doc_rows(spark, sf_dir))
    return r.records.select("file_id", "record_id", F.array_join("values", "|", "~").alias("joined"))


def _is_key(name: str) -> str:
    flat = f"replace({name}, ' ', '_')"
    return f"(regexp_matches({flat}, {KEY_WORDS}) AND regexp_matches({flat}, 'id|txn|transaction|uuid'))"


ANCHOR_NAMES_SQL = (
    f"SELECT p_partkey, array_to_string(list_filter([CASE WHEN {_is_key('n1')} THEN 0 END, CASE WHEN {_is_key('n2')} THEN 1 END, 2], "
    "lambda x: x IS NOT NULL)[1:2], ',') AS cols FROM (SELECT p_partkey, concat(lower(p_type), CASE p_partkey % 4 WHEN 0 THEN ' id' "
    "WHEN 1 THEN ' order id' WHEN 2 THEN ' txn' ELSE '' END) AS n1, lower(p_name) AS n2 FROM part)"
)


QUERIES: dict[str, Query] = {
    "column_types": Query(
        lambda sp, d: V.column_types(V.column_counts(_tables(sp, d))).select(
            "file_id", "variant", F.col("col").cast("long").alias("col"), "n", "nn", "inferred_type"
        ),
        _sql(
            "SELECT file_id, variant, col, n, nn, CASE WHEN nn = 0 THEN 'empty' WHEN plain = nn THEN 'numeric' WHEN nd = nn THEN 'datetime' "
            "ELSE 'categorical_or_text' END AS inferred_type FROM cs"
        ),
    ),
    "table_shape": Query(
        lambda sp, d: V.table_columns(V.column_counts(_tables(sp, d))).withColumns(V.shape_report()).select(
            "file_id", "variant", "row_count", F.col("col_count").cast("long").alias("col_count"), near("null_ratio", 6).alias("null_ratio"),
            F.col("numeric_col_count").cast("long").alias("numeric_cols"), near("signature_consistency", 6).alias("consistency"),
        ),
        _sql("SELECT file_id, variant, row_count, col_count, round(nr + 1e-9, 6) AS null_ratio, numeric_cols, round(sig + 1e-9, 6) AS consistency FROM shp"),
    ),
    "semantic_alignment": Query(
        lambda sp, d: V.semantic_alignment(_counted(sp, d)).select(
            "file_id", "variant", near("semantic_alignment_score", 6).alias("semantic"), F.col("n_misaligned").cast("long").alias("bad"),
            near("row_alignment", 6).alias("row_alignment"),
        ),
        _sql("SELECT file_id, variant, round(semantic + 1e-9, 6) AS semantic, bad, round(ra + 1e-9, 6) AS row_alignment FROM rep"),
    ),
    "row_alignment": Query(
        lambda sp, d: V.row_alignments(_tables(sp, d), _names(_tables(sp, d))).select(
            "file_id", "variant", "record_id", near("row_alignment", 6).alias("row_alignment")
        ),
        _sql("SELECT file_id, variant, record_id, round(ra + 1e-9, 6) AS row_alignment FROM rw"),
    ),
    "anchor_names": Query(
        lambda sp, d: I.spark_view(sp, d, "SELECT p_partkey, concat(lower(p_type), CASE p_partkey % 4 WHEN 0 THEN ' id' WHEN 1 THEN ' order id' WHEN 2 THEN ' txn' ELSE '' END) AS n1, lower(p_name) AS n2, 'uuid' AS n3 FROM {part}").select(
            "p_partkey", F.array_join(V.anchor_positions(F.array("n1", "n2", "n3")).cast("array<string>"), ",").alias("cols")
        ),
        ANCHOR_NAMES_SQL,
    ),
    "duplicate_anchors": Query(
        lambda sp, d: V.anchor_duplicates(_tables(sp, d), _keys(_names(_tables(sp, d)))),
        _sql("SELECT file_id, variant, val AS value, copies FROM dup WHERE copies > 1"),
    ),
    "record_coherence": Query(
        lambda sp, d: _report(sp, d).select(
            "file_id", "variant", near("record_coherence_score", 6).alias("coherence"), near("anchor_uniqueness", 6).alias("uniqueness"),
            "n_duplicate_anchors", near("internal_coherence", 6).alias("internal"),
        ),
        _sql(
            "SELECT file_id, variant, round(coherence + 1e-9, 6) AS coherence, round(u + 1e-9, 6) AS uniqueness, d AS n_duplicate_anchors, "
            "round(ic + 1e-9, 6) AS internal FROM rep"
        ),
    ),
    "table_scores": Query(
        lambda sp, d: _report(sp, d).select("file_id", "variant", "confidence_score"),
        _sql("SELECT file_id, variant, score AS confidence_score FROM sco"),
    ),
    "best_strategy": Query(
        lambda sp, d: ST.best_strategy(_scored_variants(sp, d)),
        _sql(
            "SELECT file_id, variant AS strategy, variant AS base, score AS confidence_score FROM (SELECT *, row_number() OVER "
            "(PARTITION BY file_id ORDER BY score DESC, variant) AS rn FROM sco) WHERE rn = 1"
        ),
    ),
    "rank_hypotheses": Query(
        lambda sp, d: ST.rank_hypotheses(_scored_variants(sp, d), ["file_id"]).select(
            "file_id", "strategy", F.col("rank").cast("long").alias("rank"), near("margin", 4).alias("margin")
        ),
        _sql(
            "SELECT file_id, variant AS strategy, row_number() OVER w AS rank, round(score - lead(score) OVER w + 1e-9, 4) AS margin FROM sco "
            "WINDOW w AS (PARTITION BY file_id ORDER BY score DESC, variant)"
        ),
    ),
    "best_shifts": Query(
        lambda sp, d: A.best_shifts(_counted(sp, d)).select(
            "file_id", "variant", F.col("shift").cast("long").alias("shift"), near("shift_score", 6).alias("score")
        ),
        _sql("SELECT file_id, variant, shift, round(score + 1e-9, 6) AS score FROM bs WHERE rn = 1"),
    ),
    "aligned_tables": Query(
        _aligned_tables,
        _sql(
            "SELECT r.file_id, r.record_id, 'order id|order date|total price|order date_1|unknown_col_5' AS names, string_agg(coalesce(val, '~'), '|' "
            "ORDER BY (r.col + g.shift + 10) % 5) AS joined FROM raw r JOIN (SELECT s.file_id, CASE WHEN (s.semantic < 0.88 OR s.bad > 0) AND b.shift <> 0 "
            "AND b.score > s.semantic THEN b.shift ELSE 0 END AS shift FROM sem s JOIN bs b ON b.file_id = s.file_id AND b.variant = s.variant AND rn = 1 "
            "WHERE s.variant = 'rotated') g ON g.file_id = r.file_id WHERE r.variant = 'rotated' GROUP BY ALL"
        ),
    ),
    "pad_records": Query(
        lambda sp, d: K.pad_records(
            I.doc_rows(sp, d).select("file_id", F.col("row_idx").alias("record_id"), F.col("cells").alias("values"))
        ).select("file_id", "record_id", F.array_join("values", "|", "~").alias("joined")),
        f"WITH {I.DOC_CELLS}, r AS (SELECT file_id, row_idx AS record_id, string_agg(coalesce(val, '~'), '|' ORDER BY col_idx) AS s, count(*) AS n FROM cells GROUP BY ALL) "
        "SELECT file_id, record_id, concat(s, repeat('|~', CAST(max(n) OVER (PARTITION BY file_id) - n AS BIGINT))) AS joined FROM r",
    ),
    "strategy_reports_docs": Query(_doc_strategies),
    "reconstruct_docs": Query(_doc_records),
}
