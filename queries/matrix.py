"""Queries over raw cell matrices: documents, shredded customers, shredded orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.functions import cells as C, rows as R, scores as X
from tablemend.operators import profile as P
from tablemend.session import cut

from . import Query
from . import inputs as I
from .inputs import DOC_CELLS, HEADED_CELLS, MATRIX_CELLS, ORDER_CELLS, class_sql, number_sql, similarity_sql, with_cells

# one value of every kind the classifier tells apart
SOUP = """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE (l_orderkey * 7 + l_linenumber) % 20
  WHEN 0 THEN substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10)
  WHEN 1 THEN concat(substr(CAST(l_shipdate AS VARCHAR(30)), 6, 2), '/', substr(CAST(l_shipdate AS VARCHAR(30)), 9, 2), '/', substr(CAST(l_shipdate AS VARCHAR(30)), 1, 4))
  WHEN 2 THEN replace(substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10), '-', '')
  WHEN 3 THEN concat(substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10), 'T10:30:00Z')
  WHEN 4 THEN concat(l_partkey % 30, ':', 10 + l_suppkey % 60)
  WHEN 5 THEN concat(1500 + l_partkey, '')
  WHEN 6 THEN concat('2023-0', 1 + l_linenumber, '-', 25 + l_suppkey % 9)
  WHEN 7 THEN concat(l_orderkey, '')
  WHEN 8 THEN concat('$', l_partkey, ',', 100 + l_suppkey)
  WHEN 9 THEN concat(l_partkey, '.', l_suppkey, 'e', l_linenumber)
  WHEN 10 THEN concat('ORD-', l_orderkey)
  WHEN 11 THEN concat('txn_', l_partkey)
  WHEN 12 THEN 'N/A'
  WHEN 13 THEN '  '
  WHEN 14 THEN concat('-', l_partkey)
  WHEN 15 THEN '#--#'
  WHEN 16 THEN concat('INV', l_partkey)
  WHEN 17 THEN concat('0000000', l_linenumber, '-1a2b-3c4d-5e6f-00000000', 1000 + l_suppkey)
  WHEN 18 THEN concat('été ', l_returnflag)
  ELSE 'inf' END AS raw
FROM {lineitem}
"""

# column names built from words of both semantic kinds
NAMES = """
SELECT p_partkey, concat(lower(p_type), CASE p_partkey % 8 WHEN 0 THEN ' Date' WHEN 1 THEN '_total' WHEN 2 THEN ' id'
  WHEN 3 THEN ' Timestamp' WHEN 4 THEN ' qty' WHEN 5 THEN ' Transaction ID' WHEN 6 THEN '_birthday count' ELSE '' END) AS name,
  CASE p_partkey % 5 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '17.5' WHEN 2 THEN p_brand WHEN 3 THEN '##' ELSE '' END AS val
FROM {part}
"""

DATE_WORDS = "'date|time|stamp|year|month|day'"
NUM_WORDS = "'amount|total|quantity|score|price|value|sum|count|qty|rate|cost'"
KEY_WORDS = "'transaction|invoice|order|customer|student|record_id|uuid|guid|id|txn'"
LABEL_WORDS = (
    "'id|date|amount|score|total|quantity|age|name|category|status|description|price|value|type|index|guid|sum|"
    "customer|transaction|order|invoice|payment|location|discount|item'"
)
HEADER_WORDS = (
    "'id|date|amount|score|total|quantity|age|name|category|status|description|price|value|type|index|guid|sum|"
    "customer|transaction|order|payment|location'"
)


def near(column, digits: int):
    """Rounded for comparison; the nudge keeps exact ties on one side in both engines."""
    return F.round((F.col(column) if isinstance(column, str) else column) + 1e-9, digits)


def _soup(spark, sf_dir):
    return I.spark_view(spark, sf_dir, SOUP, "lineitem").withColumn("v", C.normalize_cell(F.col("raw")))


SOUP_SQL = f"(SELECT *, {I.norm_sql('raw')} AS v FROM ({I.duck(SOUP)}))"
MATCH_SQL = (
    "CASE WHEN regexp_matches(v, '^TXN[_-][A-Z0-9]+', 'i') THEN 'txn_prefix' WHEN regexp_matches(v, '^ORD[_-][A-Z0-9]+', 'i') "
    "THEN 'order_prefix' WHEN regexp_matches(v, '^INV[_-][A-Z0-9]+', 'i') THEN 'invoice_prefix' WHEN "
    "regexp_matches(v, '^CUST[_-][A-Z0-9]+', 'i') THEN 'customer_prefix' WHEN regexp_matches(v, '^STU[_-][A-Z0-9]+', 'i') "
    "THEN 'student_prefix' WHEN regexp_matches(v, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$', 'i') THEN 'uuid' END"
)
HT_SQL = f"CASE WHEN regexp_matches(lower(name), {DATE_WORDS}) THEN 'datetime' WHEN regexp_matches(lower(name), {NUM_WORDS}) THEN 'numeric' ELSE 'categorical' END"
VT_SQL = f"CASE {class_sql('val')} WHEN 'D' THEN 'datetime' WHEN 'N' THEN 'numeric' WHEN 'E' THEN 'empty' ELSE 'categorical' END"


def anchor_hit_sql(x: str) -> str:
    return f"regexp_matches({x}, {I.ANCHOR_SQL}, 'i')"


LABELS_CTE = f"""
labelled AS (SELECT file_id, row_idx, count(val) AS nn,
  coalesce(sum(CASE WHEN {anchor_hit_sql('val')} THEN 1 ELSE 0 END) / nullif(CAST(count(val) AS DOUBLE), 0), 0.0) AS anchor_share,
  coalesce(sum(CASE WHEN val IS NULL OR {anchor_hit_sql('val')} THEN 0.0
     WHEN regexp_matches(replace(lower(val), ' ', '_'), {LABEL_WORDS}) THEN 1.0
     WHEN length(val) < 35 AND regexp_matches(val, '^[a-zA-Z_][a-zA-Z0-9_\\s-]*$') THEN 0.5 ELSE 0.0 END)
     / nullif(CAST(count(val) AS DOUBLE), 0), 0.0) AS label_likelihood,
  sum(CASE WHEN regexp_matches(lower(val), {HEADER_WORDS}) THEN 1 ELSE 0 END) AS header_words
  FROM cells GROUP BY file_id, row_idx)
"""

ROW_STATS_CTE = f"""
stats AS (SELECT file_id, row_idx, count(val) AS nn,
  sum(CASE WHEN regexp_matches(val, '\\p{{L}}') THEN 1 ELSE 0 END) AS n_text,
  sum(CASE WHEN {number_sql(I.strip_sql("replace(val, ',', '')"))} THEN 1 ELSE 0 END) AS n_num,
  sum(length(regexp_replace(val, '[^\\p{{L}}]', '', 'g'))) AS n_alpha, sum(length(val)) AS n_chars,
  min(CASE WHEN val IS NOT NULL THEN col_idx END) AS first_pos, max(CASE WHEN val IS NOT NULL THEN col_idx END) AS last_pos,
  count(DISTINCT val) AS n_unique FROM cells GROUP BY file_id, row_idx)
"""

HEADER_CONF_SQL = """
SELECT file_id, row_idx, CASE WHEN nn = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 100 * (
  CASE WHEN n_text / nn > 0.8 THEN 0.30 WHEN n_text / nn > 0.5 THEN 0.15 ELSE 0 END
  + CASE WHEN n_num / nn < 0.1 THEN 0.20 WHEN n_num / nn > 0.5 THEN -0.35 ELSE 0 END
  + CASE WHEN n_unique / nn > 0.9 THEN 0.15 ELSE 0 END + least(0.30, header_words * 0.10)
  + CASE WHEN n_chars / nn < 15 THEN 0.10 WHEN n_chars / nn > 25 THEN -0.10 ELSE 0 END
  + CASE WHEN nn / length(signature) > 0.3 THEN 0.10 ELSE 0 END
  + CASE WHEN length(replace(replace(replace(replace(signature, 'E', ''), 'D', ''), 'N', ''), 'M', '')) / length(signature) > 0.6 THEN 0.15 ELSE 0 END
  + CASE WHEN length(signature) - length(replace(signature, 'D', '')) > 1 THEN -0.25 ELSE 0 END
  + CASE WHEN contains(signature, 'N') AND n_num / nn > 0.4 THEN -0.20 ELSE 0 END
  + CASE WHEN anchor_share >= 0.2 THEN -0.40 ELSE 0 END))) END AS header_confidence
FROM (SELECT file_id, row_idx, CAST(s.nn AS DOUBLE) AS nn, n_text, n_num, n_unique, n_chars, signature, anchor_share, header_words
      FROM stats s JOIN sigs USING (file_id, row_idx) JOIN labelled USING (file_id, row_idx))
"""

SPAN_SQL = """
seqs AS (SELECT file_id, list(signature ORDER BY seq) AS ls, count(*) AS n FROM act GROUP BY file_id),
starts AS (SELECT file_id, ls, n, unnest(range(0, n)) AS i FROM seqs),
spans AS (SELECT file_id, n, i, unnest(range(2, least(15, n - i) + 1)) AS span, ls FROM starts WHERE n - i >= 2),
blocks AS (SELECT file_id, n, span, i % span AS o, array_to_string(ls[i + 1 : i + span], '|') AS b, i FROM spans),
counts AS (SELECT file_id, n, span, o, b, count(*) AS c, min(i) AS first_i FROM blocks GROUP BY ALL),
shares AS (SELECT file_id, n, span, o, sum(c) AS total, max(c) / CAST(sum(c) AS DOUBLE) AS share,
           arg_max(first_i, c * 1000000 - first_i) AS first_i FROM counts GROUP BY ALL),
hits AS (SELECT file_id, span, o, first_i FROM shares WHERE total >= 2 AND share > 0.6 AND n >= 2 * span),
pattern AS (SELECT h.file_id, h.span, h.o, h.first_i, z.share AS zero_share FROM
  (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY span, o) AS rn FROM hits) h
  JOIN shares z ON z.file_id = h.file_id AND z.span = h.span AND z.o = 0 WHERE rn = 1)
"""

STABILITY_CTE = f"""
pairs AS (SELECT file_id, seq, signature AS b, lag(signature) OVER (PARTITION BY file_id ORDER BY seq) AS a FROM act),
stability AS (SELECT file_id, coalesce(avg(CASE WHEN a IS NOT NULL THEN {similarity_sql('a', 'b')} END), 0.0) AS st, count(*) AS n_active
  FROM pairs GROUP BY file_id)
"""

PROFILE_SQL = f"""
, {ROW_STATS_CTE}, {SPAN_SQL}, {STABILITY_CTE},
den AS (SELECT file_id, row_idx, nn, nn / CAST(length(signature) AS DOUBLE) AS d, length(signature) AS w,
  length(signature) - length(replace(signature, 'D', '')) AS nd FROM sigs),
tot AS (SELECT file_id, count(*) AS total_rows, max(w) AS total_columns, sum(nn) AS nv, sum(nd) AS nd, sum(d) AS sd FROM den GROUP BY file_id),
ent AS (SELECT file_id, -sum(CASE WHEN d > 0 THEN d / sd * log2(d / sd) ELSE 0 END) AS e FROM den JOIN tot USING (file_id) GROUP BY file_id),
txt AS (SELECT file_id, sum(n_text) AS nt, sum(n_num) AS nu FROM stats GROUP BY file_id),
all_of AS (SELECT t.file_id, total_rows, total_columns, nv / CAST(total_rows * total_columns AS DOUBLE) AS row_density,
  CASE WHEN nv > 0 THEN nt / CAST(nv AS DOUBLE) ELSE 0.0 END AS text_ratio, CASE WHEN nv > 0 THEN nu / CAST(nv AS DOUBLE) ELSE 0.0 END AS numeric_ratio,
  CASE WHEN nv > 0 THEN nd / CAST(nv AS DOUBLE) ELSE 0.0 END AS datetime_ratio,
  CASE WHEN sd > 0 THEN coalesce(e, 0.0) ELSE 0.0 END AS structural_entropy, coalesce(p.span, 0) AS span, coalesce(s.st, 0.0) AS st,
  CASE WHEN p.span IS NULL THEN coalesce(s.st, 0.0) * 0.5 ELSE least(1.0, 0.5 * p.zero_share + 0.5 * s.st) END AS seg
  FROM tot t JOIN ent USING (file_id) JOIN txt USING (file_id) LEFT JOIN pattern p USING (file_id) LEFT JOIN stability s USING (file_id))
SELECT file_id, total_rows, total_columns, round(row_density + 1e-9, 6) AS row_density, round(text_ratio + 1e-9, 6) AS text_ratio,
  round(numeric_ratio + 1e-9, 6) AS numeric_ratio, round(datetime_ratio + 1e-9, 6) AS datetime_ratio, round(structural_entropy + 1e-9, 5) AS structural_entropy,
  span AS repeating_signature_span, round(st + 1e-9, 5) AS row_similarity_stability, round(seg + 1e-9, 5) AS segmentation_likelihood,
  round(least(1.0, 0.35 * row_density + 0.25 * st + 0.25 * seg + 0.15 * (1 - least(structural_entropy / 4.0, 1.0))) + 1e-9, 5) AS profile_confidence
FROM all_of
"""


def _profile(rows):
    rows = cut(P.profile_rows(rows))  # read by several steps
    d = P.dataset_profile(rows, cut(P.active_rows(rows)))
    r = lambda c, n: near(c, n).alias(c)
    return d.select(
        "file_id", "total_rows", F.col("total_columns").cast("long").alias("total_columns"),
        r("row_density", 6), r("text_ratio", 6), r("numeric_ratio", 6), r("datetime_ratio", 6), r("structural_entropy", 5),
        F.col("repeating_signature_span").cast("long").alias("repeating_signature_span"),
        r("row_similarity_stability", 5), r("segmentation_likelihood", 5), r("profile_confidence", 5),
    )


def _pattern(rows):
    active = P.active_rows(P.profile_rows(rows))
    hit = P.repeating_pattern(active)
    return P.pattern_signatures(active, hit).join(hit.select("file_id", "offset", "first_seq"), "file_id").select(
        "file_id", F.col("span").cast("long").alias("span"), F.col("offset").cast("long").alias("offset"), "first_seq",
        F.array_join("pattern", "|").alias("pattern"),
    )


PATTERN_SQL = f""", {SPAN_SQL} SELECT p.file_id, p.span, p.o AS "offset", p.first_i AS first_seq,
array_to_string(ls[first_i + 1 : first_i + span], '|') AS pattern FROM pattern p JOIN seqs USING (file_id)"""


def _similarities(spark, sf_dir):
    rows = P.profile_rows(I.doc_rows(spark, sf_dir))
    active = P.active_rows(rows).select(
        "file_id", "seq", F.col("signature").alias("a"), F.col("next_signature").alias("b")
    )
    active = active.filter("b IS NOT NULL").withColumns(
        {"a": R.compact_signature(F.col("a")), "b": R.compact_signature(F.col("b"))}
    )
    a, b = F.col("a"), F.col("b")
    return active.select(
        "file_id", "seq",
        near(R.similarity(a, b), 6).alias("sim"),
        near(R.similarity_with_length_penalty(a, b), 6).alias("penalised"),
        near(R.layout_similarity(a, b), 6).alias("layout"),
        R.class_change(a, b).alias("change"),
    )


SIM_SQL = f""", cmp AS (SELECT file_id, seq, rtrim(signature, 'E') AS a,
 rtrim(lead(signature) OVER (PARTITION BY file_id ORDER BY seq), 'E') AS b FROM act)
SELECT file_id, seq, round({similarity_sql('a', 'b')} + 1e-9, 6) AS sim,
 round({similarity_sql('a', 'b')} * (1.0 - abs(length(a) - length(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE)) + 1e-9, 6) AS penalised,
 round({similarity_sql('a', 'b')} + 1e-9, 6) AS layout,
 (contains(a, 'D') <> contains(b, 'D') OR contains(a, 'N') <> contains(b, 'N') OR contains(a, 'T') <> contains(b, 'T') OR contains(a, 'M') <> contains(b, 'M'))
 AND contains(b, 'N') AND contains(a, 'T') AS change FROM cmp WHERE b IS NOT NULL"""


def _scores(spark, sf_dir):
    v = I.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("s"), (F.col("user_id") % 10 / 10).alias("t"))
    s, t = F.col("s"), F.col("t")
    return v.select(
        "event_id",
        near(X.Weighting({"a": 0.3, "b": 0.2}).sum({"a": s, "b": t}), 6).alias("light"),
        near(X.Weighting({"a": 3.0, "b": 1.0}).sum({"a": s, "b": t}), 6).alias("heavy"),
        near(X.Weighting({}).sum({"a": s, "b": t}), 6).alias("plain"),
        near(X.joint(F.array(s, t)), 6).alias("product"),
        near(X.lead(s, F.when(F.col("event_id") % 3 > 0, t)), 6).alias("margin"),
        near(X.share_of_range(s, 0.1, 0.6), 6).alias("linear"),
        near(
            X.LAYERS.mean(F.create_map(F.lit("profiling"), s, F.lit("semantic"), t, F.lit("periodic"), F.lit(0.9))), 6
        ).alias("overall"),
    )


QUERIES: dict[str, Query] = {
    "scan_matrix": Query(
        lambda sp, d: I.doc_rows(sp, d).select(
            "file_id", "row_idx", F.size("cells").cast("long").alias("n_cells"),
            F.array_join("cells", "|", "~").alias("joined"), F.col("width").cast("long").alias("width"),
        ),
        f"WITH {DOC_CELLS} SELECT file_id, row_idx, n_cells, joined, max(n_cells) OVER (PARTITION BY file_id) AS width FROM "
        "(SELECT file_id, row_idx, count(*) AS n_cells, string_agg(coalesce(val, '~'), '|' ORDER BY col_idx) AS joined FROM cells GROUP BY ALL)",
    ),
    "classify_cells": Query(
        lambda sp, d: _soup(sp, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "v", C.classify_cell(F.col("v")).alias("cls")),
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, v, {class_sql('v')} AS cls FROM {SOUP_SQL}",
    ),
    "cell_predicates": Query(
        lambda sp, d: _soup(sp, d).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
            C.is_numeric(F.col("v")).alias("is_numeric"), C.is_text(F.col("v")).alias("is_text"),
            C.looks_like_id(F.col("v")).alias("is_id"), C.match_anchor(F.col("v")).alias("anchor"),
        ),
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, coalesce({number_sql(I.strip_sql(chr(39).join(['replace(v, ', ',', ', ', '', ')'])))}, false) AS is_numeric, "
        "coalesce(regexp_matches(v, '\\p{L}'), false) AS is_text, "
        f"coalesce(regexp_matches(v, {I.NUMBER_SQL}) AND TRY_CAST(v AS DOUBLE) >= 0 AND TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE)), false) AS is_id, "
        f"{MATCH_SQL} AS anchor FROM {SOUP_SQL}",
    ),
    "semantic_types": Query(
        lambda sp, d: I.spark_view(sp, d, NAMES).select(
            "p_partkey", C.header_type(F.col("name")).alias("h"), C.value_type(F.col("val")).alias("t"),
            C.is_anchor_name(F.col("name")).alias("is_key"),
        ).withColumn("fit", C.type_match(F.col("h"), F.col("t"))),
        f"SELECT *, CAST(CASE WHEN t = 'empty' THEN 0.5 WHEN h = t THEN 1.0 WHEN h = 'categorical' AND t IN ('categorical', 'numeric') THEN 0.8 "
        f"ELSE 0.0 END AS DOUBLE) AS fit FROM (SELECT p_partkey, {HT_SQL} AS h, {VT_SQL} AS t, "
        f"regexp_matches(replace(lower(name), ' ', '_'), {KEY_WORDS}) AND regexp_matches(replace(lower(name), ' ', '_'), 'id|txn|transaction|uuid') AS is_key "
        f"FROM ({I.duck(NAMES)}))",
    ),
    "row_signatures": Query(
        lambda sp, d: I.doc_rows(sp, d).select(
            "file_id", "row_idx", R.full_signature(F.col("cells"), F.col("width")).alias("signature"),
        ).withColumn("compact", R.compact_signature(F.col("signature"))),
        with_cells(
            DOC_CELLS,
            "SELECT file_id, row_idx, signature, CASE WHEN rtrim(signature, 'E') = '' THEN signature ELSE rtrim(signature, 'E') END AS compact FROM sigs",
        ),
    ),
    "row_profiles": Query(
        lambda sp, d: P.profile_rows(I.doc_rows(sp, d)).select(
            "file_id", "row_idx", *[F.col(c).cast("long").alias(c) for c in ("non_null_count", "text_count", "numeric_count", "first_non_null_pos", "last_non_null_pos")],
            *[near(c, 6).alias(c) for c in ("text_ratio", "numeric_ratio", "alpha_ratio", "unique_token_ratio")],
        ),
        f"WITH {DOC_CELLS}, {ROW_STATS_CTE} SELECT file_id, row_idx, nn AS non_null_count, CAST(n_text AS BIGINT) AS text_count, "
        "CAST(n_num AS BIGINT) AS numeric_count, coalesce(first_pos, -1) AS first_non_null_pos, coalesce(last_pos, -1) AS last_non_null_pos, "
        "round(coalesce(n_text / nullif(CAST(nn AS DOUBLE), 0), 0.0) + 1e-9, 6) AS text_ratio, round(coalesce(n_num / nullif(CAST(nn AS DOUBLE), 0), 0.0) + 1e-9, 6) AS numeric_ratio, "
        "round(coalesce(n_alpha / nullif(CAST(n_chars AS DOUBLE), 0), 0.0) + 1e-9, 6) AS alpha_ratio, round(coalesce(n_unique / nullif(CAST(nn AS DOUBLE), 0), 0.0) + 1e-9, 6) AS unique_token_ratio FROM stats",
    ),
    "label_rows": Query(
        lambda sp, d: P.profile_rows(I.doc_rows(sp, d)).select(
            "file_id", "row_idx", near("label_likelihood", 6).alias("label_likelihood"), "is_label",
            R.is_data_row(F.col("anchor_share"), F.col("label_likelihood"), F.col("signature")).alias("is_data"),
        ),
        with_cells(
            DOC_CELLS,
            f", {LABELS_CTE} SELECT file_id, row_idx, round(label_likelihood + 1e-9, 6) AS label_likelihood, anchor_share < 0.25 AND label_likelihood >= 0.4 AS is_label, "
            "anchor_share >= 0.2 OR (regexp_matches(signature, '[ND]') AND contains(signature, 'T') AND label_likelihood < 0.35) AS is_data "
            "FROM labelled JOIN sigs USING (file_id, row_idx)",
        ),
    ),
    "row_header_confidence": Query(
        lambda sp, d: P.profile_rows(I.doc_rows(sp, d)).select("file_id", "row_idx", near("header_confidence", 4).alias("header_confidence")),
        with_cells(DOC_CELLS, f", {LABELS_CTE}, {ROW_STATS_CTE} SELECT file_id, row_idx, round(header_confidence + 1e-9, 4) AS header_confidence FROM ({HEADER_CONF_SQL})"),
    ),
    "roll_cells": Query(
        lambda sp, d: I.doc_rows(sp, d).select(
            "file_id", "row_idx", F.array_join(R.roll(F.col("cells"), F.col("row_idx") % 7 - 3), "|", "~").alias("rolled")
        ),
        f"WITH {DOC_CELLS} SELECT file_id, row_idx, string_agg(coalesce(val, '~'), '|' ORDER BY (col_idx + s) % n) AS rolled FROM "
        "(SELECT *, (((row_idx % 7 - 3) % n) + n) % n AS s FROM (SELECT *, count(*) OVER (PARTITION BY file_id, row_idx) AS n FROM cells)) GROUP BY ALL",
    ),
    "row_layouts": Query(
        lambda sp, d: P.profile_rows(I.doc_rows(sp, d)).filter("non_null_count > 0").select(
            "file_id", "row_idx", F.array_join(R.layout(F.col("cells")).cast("array<string>"), ",").alias("cols"),
            F.size(R.layout(F.col("cells"))).cast("long").alias("n"), R.compact_signature(F.col("signature")).alias("compact"),
            R.mask(F.col("cells")).alias("mask"),
        ),
        with_cells(
            DOC_CELLS,
            "SELECT file_id, row_idx, string_agg(CASE WHEN val IS NOT NULL THEN CAST(col_idx AS VARCHAR) END, ',' ORDER BY col_idx) AS cols, count(val) AS n, "
            "any_value(rtrim(signature, 'E')) AS compact, string_agg(CASE WHEN val IS NULL THEN '0' ELSE '1' END, '' ORDER BY col_idx) AS mask "
            "FROM cells JOIN sigs USING (file_id, row_idx) GROUP BY ALL HAVING count(val) > 0",
        ),
    ),
    "signature_similarity": Query(_similarities, with_cells(DOC_CELLS, SIM_SQL)),
    "confidence_math": Query(
        _scores,
        "SELECT event_id, round(least(1, greatest(0, s * 0.3 + t * 0.2)) + 1e-9, 6) AS light, round(least(1, greatest(0, (s * 3 + t) / 4)) + 1e-9, 6) AS heavy, "
        "round((s + t) / 2 + 1e-9, 6) AS plain, round(least(1, greatest(0.01, s)) * least(1, greatest(0.01, t)) + 1e-9, 6) AS product, "
        "round(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE least(1, greatest(0, 0.5 + (s - t) * 2)) END + 1e-9, 6) AS margin, "
        "round(least(1, greatest(0, (s - 0.1) / 0.5)) + 1e-9, 6) AS linear, round((s * 0.08 + t * 0.18) / 0.26 + 1e-9, 6) AS overall "
        "FROM (SELECT event_id, value / 100 AS s, user_id % 10 / 10 AS t FROM events)",
    ),
    "dataset_profile_docs": Query(lambda sp, d: _profile(I.doc_rows(sp, d)), with_cells(DOC_CELLS, PROFILE_SQL)),
    "dataset_profile_customers": Query(lambda sp, d: _profile(I.headed_matrix(sp, d)), with_cells(HEADED_CELLS, PROFILE_SQL)),
    "dataset_profile_orders": Query(lambda sp, d: _profile(I.order_matrix(sp, d)), with_cells(ORDER_CELLS, PROFILE_SQL)),
    "row_similarity": Query(
        lambda sp, d: P.row_similarity(P.active_rows(P.profile_rows(I.doc_rows(sp, d)))).select(
            "file_id", near("row_similarity_stability", 6).alias("stability"), "n_active"
        ),
        with_cells(DOC_CELLS, f", {STABILITY_CTE} SELECT file_id, round(st + 1e-9, 6) AS stability, n_active FROM stability"),
    ),
    "table_regions": Query(
        lambda sp, d: P.table_regions(P.profile_rows(I.doc_rows(sp, d)), 0.3),
        with_cells(
            DOC_CELLS,
            "SELECT file_id, min(row_idx) AS start, max(row_idx) AS \"end\" FROM (SELECT file_id, row_idx, row_idx - row_number() OVER "
            "(PARTITION BY file_id ORDER BY row_idx) AS island FROM sigs WHERE nn / CAST(length(signature) AS DOUBLE) > 0.3) GROUP BY file_id, island HAVING max(row_idx) > min(row_idx)",
        ),
    ),
    "repeating_pattern_docs": Query(lambda sp, d: _pattern(I.doc_rows(sp, d)), with_cells(DOC_CELLS, PATTERN_SQL)),
    "repeating_pattern_customers": Query(lambda sp, d: _pattern(I.headed_matrix(sp, d)), with_cells(HEADED_CELLS, PATTERN_SQL)),
}
