"""Queries on headers, cycles, record boundaries and reconstruction of matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.functions import cells as C, rows as R
from tablemend.operators import boundaries as B, headers as H, profile as P, records as K, structure as S
from tablemend.plans import reconstruct as RC
from tablemend.session import cut

from . import Query
from . import inputs as I
from .inputs import DOC_CELLS, HEADED_CELLS, ORDER_CELLS, similarity_sql, with_cells
from .matrix import HEADER_CONF_SQL, LABELS_CTE, ROW_STATS_CTE, SPAN_SQL, STABILITY_CTE, anchor_hit_sql, near


def _profiled(rows):
    """Profiled rows and the active ones among them; each is read by several steps, so it is made once."""
    rows = cut(P.profile_rows(rows))
    return rows, cut(P.active_rows(rows))


def _active(rows):
    return cut(P.active_rows(P.profile_rows(rows)))


def _measured(rows, *columns):
    """Rows with the named measures alone: what no step reads is neither taken nor shuffled."""
    return cut(P.profile_rows(rows).select("file_id", "row_idx", "non_null_count", *columns))


def _ordered(rows, *columns):
    """Active rows with the named columns alone."""
    return cut(P.active_rows(rows).select("file_id", "row_idx", "seq", *columns))


def _data(rows, active, *columns, first=0):
    """Data rows with the named columns alone; every file begins at row ``first``."""
    files = rows.select("file_id").distinct().withColumn("data_start", F.lit(first))
    return cut(S.data_rows(active, files).select("file_id", "j", *columns))


def _cell_data(raw, first=0):
    """Measured rows and data rows with their cells; no cell is classified."""
    rows = _measured(raw, "cells")
    # not written in between: the second reading of the order needs no cells
    return rows, _data(rows, P.active_rows(rows), "row_idx", "cells", first=first)


# --- periodic suffixes and data start ------------------------------------------

# every suffix is searched anew: spans 2..8, all chunkings, share of the commonest block
SUFFIX_CTE = """
seqs AS (SELECT file_id, list(signature ORDER BY seq) AS ls, count(*) AS n FROM act GROUP BY file_id),
st8 AS (SELECT file_id, ls, n, unnest(range(0, n)) AS i FROM seqs),
bl8 AS (SELECT file_id, n, i, span, array_to_string(ls[i + 1 : i + span], '|') AS b FROM
  (SELECT *, unnest(range(2, least(8, n - i) + 1)) AS span FROM st8 WHERE n - i >= 2)),
sx AS (SELECT a.file_id, a.i AS a, b.span, (b.i - a.i) % b.span AS o, b.b, count(*) AS c FROM st8 a JOIN bl8 b
  ON a.file_id = b.file_id AND b.i >= a.i AND a.n - a.i >= 2 * b.span GROUP BY ALL),
sh8 AS (SELECT file_id, a, span, o, sum(c) AS total, max(c) / CAST(sum(c) AS DOUBLE) AS share FROM sx GROUP BY ALL),
sp8 AS (SELECT file_id, a, min(span) AS span FROM sh8 WHERE total >= 2 AND share > 0.6 GROUP BY ALL),
per AS (SELECT p.file_id, p.a AS seq, 35.0 * s.share AS periodic FROM sp8 p JOIN sh8 s ON s.file_id = p.file_id AND s.a = p.a AND s.span = p.span AND s.o = 0)
"""


def score_cte() -> str:
    return f"""
{LABELS_CTE}, {ROW_STATS_CTE}, {SUFFIX_CTE}, hc AS ({HEADER_CONF_SQL}),
base AS (SELECT s.file_id, s.row_idx, s.signature AS g, s.nn, l.anchor_share AS an, l.label_likelihood AS la, hc.header_confidence AS h,
   CASE WHEN s.nn > 0 THEN n_num / CAST(s.nn AS DOUBLE) ELSE 0 END AS nr, coalesce(per.periodic, 0.0) AS p,
   lag(s.signature) OVER w AS pg, lead(s.signature) OVER w AS ng, lag(hc.header_confidence) OVER w AS ph, l.anchor_share < 0.25 AND l.label_likelihood >= 0.4 AS is_label,
   max(CASE WHEN s.nn > 0 THEN s.row_idx END) OVER (PARTITION BY s.file_id ORDER BY s.row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_full
   FROM sigs s JOIN labelled l USING (file_id, row_idx) JOIN stats t USING (file_id, row_idx) JOIN hc USING (file_id, row_idx)
   LEFT JOIN act USING (file_id, row_idx) LEFT JOIN per ON per.file_id = act.file_id AND per.seq = act.seq
   WINDOW w AS (PARTITION BY s.file_id ORDER BY s.row_idx)),
scored AS (SELECT *, CASE WHEN nn = 0 THEN 0.0 ELSE round(greatest(0.0, an * 100 + la * 100 + CASE WHEN nr > 0.35 THEN nr * 40 ELSE 0 END
  + CASE WHEN regexp_matches(g, '[DN]') THEN 20 ELSE 0 END + CASE WHEN la < 0.3 AND an > 0.2 THEN 30 ELSE 0 END + p
  + CASE WHEN pg IS NOT NULL AND {similarity_sql('pg', 'g')} > 0.7 AND an > 0.15 THEN 15 ELSE 0 END
  + CASE WHEN pg IS NOT NULL AND {similarity_sql('pg', 'g')} < 0.35 AND an > 0.1 THEN 12 ELSE 0 END
  + CASE WHEN ng IS NOT NULL AND {similarity_sql('g', 'ng')} > 0.65 THEN 18 ELSE 0 END
  + CASE WHEN an >= 0.2 OR (regexp_matches(g, '[ND]') AND contains(g, 'T') AND la < 0.35) THEN 25 ELSE 0 END - round(h, 9) * 0.25), 9) END AS score FROM base),
judged AS (SELECT *, nn > 0 AND (((an * 100 >= 25 OR p >= 20) AND la * 100 < 15) OR (score >= 57 AND NOT is_label)) AS strong,
  coalesce(prev_full + 1, 0) AS gap FROM scored),
facts AS (SELECT file_id, count(*) AS n_rows, min(CASE WHEN NOT is_label AND score >= 42 AND strong THEN row_idx END) AS s1,
  min(CASE WHEN NOT is_label AND score >= 42 THEN row_idx END) AS s2, min(CASE WHEN nn > 0 AND an >= 0.25 THEN row_idx END) AS anchor_start,
  arg_max(row_idx, round(score - 0.4 * round(ph, 9), 9) - row_idx * 1e-12) FILTER (WHERE row_idx >= 1) AS fb FROM judged GROUP BY file_id),
pstart AS (SELECT file_id, pr AS periodicity_start, ps FROM (SELECT file_id, CASE WHEN gap < row_idx THEN gap ELSE row_idx END AS pr, strong AND gap >= row_idx AS ps,
  row_number() OVER (PARTITION BY file_id ORDER BY round(p, 9) DESC, row_idx) AS rn FROM judged WHERE nn > 0 AND p >= 18 AND (gap < row_idx OR NOT is_label)) WHERE rn = 1),
pick AS (SELECT f.file_id, n_rows, anchor_start, periodicity_start,
  coalesce(least(s1, CASE WHEN a.strong THEN anchor_start END, CASE WHEN ps THEN periodicity_start END), least(s2, anchor_start, periodicity_start)) AS cand, fb
  FROM facts f LEFT JOIN pstart USING (file_id) LEFT JOIN judged a ON a.file_id = f.file_id AND a.row_idx = f.anchor_start),
resolved AS (SELECT k.file_id, k.n_rows, anchor_start, periodicity_start, coalesce(cand, (SELECT min(j.row_idx) FROM judged j WHERE j.file_id = k.file_id
  AND NOT j.is_label AND j.row_idx >= CASE WHEN k.n_rows <= 1 THEN k.n_rows ELSE k.fb END), k.n_rows) AS data_start FROM pick k)
"""


def _scores(rows):
    return H.data_start_scores(*_profiled(rows))


def _resolve(rows):
    return H.resolve_data_start(cut(_scores(rows))).select("file_id", "n_rows", "anchor_start", "periodicity_start", "data_start")


SCORE_SELECT = "SELECT file_id, row_idx, round(score + 1e-9, 4) AS score, round(p + 1e-9, 4) AS periodic, strong, is_label FROM judged"
RESOLVE_SELECT = "SELECT file_id, n_rows, anchor_start, periodicity_start, data_start FROM resolved"


# --- cycles --------------------------------------------------------------------

CYCLE_CTE = f"""
cd AS (SELECT file_id, seq AS j, n_active AS n, rtrim(signature, 'E') AS g, length(replace(signature, 'E', '')) AS w FROM act WHERE n_active >= 4),
cyc AS (SELECT *, unnest(range(2, least(12, n // 2) + 1)) AS c FROM cd),
tpl AS (SELECT a.*, a.j // a.c AS b, t.g AS tg, t.w AS tw FROM cyc a JOIN cd t ON t.file_id = a.file_id AND t.j = a.j % a.c WHERE (a.j // a.c) * a.c + a.c <= a.n),
blk AS (SELECT file_id, c, b, avg({similarity_sql('g', 'tg')}) AS s, bool_and(abs(w - tw) <= 1) AS same FROM tpl GROUP BY ALL),
rep AS (SELECT file_id, c, avg(CASE WHEN s >= 0.72 - 1e-12 THEN 1.0 ELSE 0.0 END) AS sr, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS wr FROM blk GROUP BY ALL),
stp AS (SELECT a.file_id, a.c, a.j % a.c AS r, avg({similarity_sql('a.g', 'b.g')}) AS s FROM cyc a JOIN cd b ON b.file_id = a.file_id AND b.j = a.j + a.c GROUP BY ALL),
cs AS (SELECT file_id, c, avg(s) AS cs FROM stp GROUP BY ALL),
scores AS (SELECT file_id, c AS cycle, sr AS signature_repeat, wr AS width_repeat, cs AS cyclic_sim, round(least(1.0, 0.45 * sr + 0.30 * wr + 0.25 * cs), 9) AS score FROM rep JOIN cs USING (file_id, c))
"""


def _cycle_scores(rows):
    active = _ordered(_measured(rows, "signature"), "signature")
    return S.cycle_scores(_data(active, active, "n_data", "sig")).select(
        "file_id", F.col("cycle").cast("long").alias("cycle"),
        *[near(c, 5).alias(c) for c in ("signature_repeat", "width_repeat", "cyclic_sim", "score")],
    )


CYCLE_SELECT = (
    "SELECT file_id, cycle, round(signature_repeat + 1e-9, 5) AS signature_repeat, round(width_repeat + 1e-9, 5) AS width_repeat, "
    "round(cyclic_sim + 1e-9, 5) AS cyclic_sim, round(score + 1e-9, 5) AS score FROM scores"
)


def _best_cycles(spark, sf_dir):
    rows = _measured(I.doc_rows(spark, sf_dir), "width", "text_count", "numeric_count", "signature")
    active = _ordered(rows, "signature", "next_signature")
    strength = F.col("n_data") % 10 / 10
    best = S.best_cycle(_data(active, active, "n_data", "sig"), P.dataset_profile(rows, active))
    return best.select(
        "file_id", F.col("cycle").cast("long").alias("cycle"), near("score", 5).alias("score"),
        S.choose_mode(F.col("score"), strength).alias("mode"),
    )


BEST_CYCLE_SELECT = """
, best AS (SELECT file_id, cycle, score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, cycle) AS rn FROM scores WHERE score > 0) WHERE rn = 1),
size AS (SELECT file_id, count(*) AS n FROM act GROUP BY file_id),
seg AS (SELECT s.file_id, CASE WHEN p.span IS NULL THEN s.st * 0.5 ELSE least(1.0, 0.5 * p.zero_share + 0.5 * s.st) END AS l FROM stability s LEFT JOIN pattern p USING (file_id)),
fin AS (SELECT size.file_id, n, CASE WHEN w AND cp.span IS NOT NULL THEN cp.span ELSE coalesce(b.cycle, 0) END AS cycle,
  CASE WHEN w AND cp.span IS NOT NULL THEN greatest(coalesce(b.score, 0.0), l) ELSE coalesce(b.score, 0.0) END AS score FROM
  (SELECT size.*, n >= 4 AND (coalesce(best.cycle, 0) <= 1 OR coalesce(best.score, 0) < 0.45) AS w FROM size LEFT JOIN best USING (file_id)) size
  LEFT JOIN best b USING (file_id) LEFT JOIN seg USING (file_id) LEFT JOIN cpattern cp USING (file_id))
SELECT file_id, cycle, round(score + 1e-9, 5) AS score, CASE WHEN score >= 0.55 AND score > t + 0.15 THEN 'periodic' WHEN t >= 0.5 AND score < 0.45 THEN 'anchor'
  WHEN score >= 0.4 AND t >= 0.4 THEN 'hybrid' WHEN score >= t THEN 'periodic' ELSE 'anchor' END AS mode FROM (SELECT *, n % 10 / 10 AS t FROM fin)
"""

# the same pattern search on compact signatures
COMPACT_SPAN_SQL = (
    SPAN_SQL.replace("list(signature ORDER BY seq)", "list(rtrim(signature, 'E') ORDER BY seq)")
    .replace("seqs", "cseqs").replace("starts", "cstarts").replace("spans", "cspans").replace("blocks", "cblocks")
    .replace("counts", "ccounts").replace("shares", "cshares").replace("hits", "chits").replace("pattern AS", "cpattern AS")
)


# --- boundaries ----------------------------------------------------------------


def _anchor_stats(spark, sf_dir):
    rows = P.profile_rows(I.order_matrix(spark, sf_dir))
    files = rows.select("file_id").distinct().withColumn("data_start", F.lit(1))
    stats = S.column_values(rows, files)
    bp = F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(2), F.lit(3)))
    names = F.array(*[F.lit(n) for n in ("order_id", "priority name", "total price", "order date")])
    return S.anchor_columns(stats, files.withColumns({"bp": bp, "names": names}), "names").select(
        "file_id", F.col("col").cast("long").alias("col"), F.col("global_idx").cast("long").alias("global_idx"), "label", "pattern",
        near("confidence", 5).alias("confidence"), F.col("segment_offset").cast("long").alias("segment_offset"),
    )


ANCHOR_COLUMNS_SQL = f"""
, cv AS (SELECT file_id, col_idx, count(*) AS n, count(DISTINCT val) AS d, sum(CASE WHEN {anchor_hit_sql('val')} THEN 1 ELSE 0 END) AS pat,
  sum(CASE WHEN cls = 'N' AND TRY_CAST(val AS DOUBLE) >= 0 AND TRY_CAST(val AS DOUBLE) = floor(TRY_CAST(val AS DOUBLE)) THEN 1 ELSE 0 END) AS ids
  FROM classed WHERE row_idx >= 1 AND val IS NOT NULL GROUP BY ALL),
sc AS (SELECT *, ['order_id', 'priority name', 'total price', 'order date'][col_idx + 1] AS label FROM cv)
SELECT file_id, col_idx AS col, col_idx AS global_idx, label, CASE WHEN pat > 0 THEN 'order_prefix' ELSE 'generic_id' END AS pattern,
  round(conf + 1e-9, 5) AS confidence, CASE WHEN col_idx < 2 THEN CAST(0 AS BIGINT) ELSE 1 END AS segment_offset FROM (SELECT *, least(1.0,
  CASE WHEN regexp_matches(label, 'order|id') THEN 0.35 ELSE 0 END + CASE WHEN col_idx < 2 THEN 0.15 ELSE 0 END
  + CASE WHEN d / CAST(n AS DOUBLE) > 0.85 THEN 0.25 WHEN d / CAST(n AS DOUBLE) > 0.6 THEN 0.1 ELSE 0 END
  + CASE WHEN pat / CAST(n AS DOUBLE) > 0.5 THEN 0.35 WHEN pat / CAST(n AS DOUBLE) > 0.2 THEN 0.15 ELSE 0 END
  + CASE WHEN ids / CAST(n AS DOUBLE) > 0.7 AND d / CAST(n AS DOUBLE) > 0.7 THEN 0.15 ELSE 0 END) AS conf FROM sc) WHERE conf >= 0.45 - 1e-9
"""


def _doc_data(spark, sf_dir):
    return _cell_data(I.doc_rows(spark, sf_dir))[1]


def _doc_plan(data):
    """A two-row blueprint for every document: columns 0..2, then 0..1; identifiers in column 0."""
    bp = F.array(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(1)))
    anchors = F.array(F.struct(F.lit(0).alias("col"), F.lit(0).alias("segment_offset"), F.lit("generic_id").alias("pattern")))
    return data.select("file_id").distinct().withColumns(
        {
            "bp": bp, "bp0": F.get(bp, F.lit(0)), "anchors": anchors, "rep_span": F.lit(3), "data_start": F.lit(1), "method": F.lit("scored"),
        }
    )


def _boundary_rows(spark, sf_dir):
    """What the features of boundaries read: rows, and data rows with signature and cells."""
    rows = _measured(I.doc_rows(spark, sf_dir), "signature", "cells")
    return rows, _data(rows, _ordered(rows, "signature", "cells"), "row_idx", "signature", "cells")


def _doc_features(spark, sf_dir):
    rows, data = _boundary_rows(spark, sf_dir)
    return B.boundary_features(data, _doc_plan(data), rows)


def penalised_sql(a: str, b: str) -> str:
    return f"({similarity_sql(a, b)} * (1.0 - abs(length({a}) - length({b})) / CAST(greatest(length({a}), length({b})) AS DOUBLE)))"


# features of every row, and the two greedy rules as recursion over the rows of a file
FEATURE_CTE = f"""
colset AS (SELECT file_id, row_idx, list(col_idx ORDER BY col_idx) FILTER (WHERE val IS NOT NULL) AS cs, max(CASE WHEN col_idx = 0 THEN val END) AS v0 FROM cells GROUP BY ALL),
r0 AS (SELECT file_id, signature AS t FROM sigs WHERE row_idx = 0),
ft0 AS (SELECT a.file_id, a.seq AS j, a.row_idx, a.signature AS g, lag(a.signature) OVER (PARTITION BY a.file_id ORDER BY a.seq) AS pg, t, cs, v0,
   len(list_intersect(cs, [0, 1, 2])) AS o0, len(list_intersect(cs, [0, 1])) AS o1 FROM act a JOIN colset USING (file_id, row_idx) JOIN r0 USING (file_id)),
ft AS (SELECT file_id, j, row_idx, o0 * 2 >= 3 AS f0, o1 * 2 >= 2 AND o1 > 0 AS f1, CASE WHEN o1 * 2.0 > o0 + o0 * 2.0 / 3 THEN 1 ELSE 0 END AS best,
   coalesce({anchor_hit_sql('v0')} OR (regexp_matches(v0, {I.NUMBER_SQL}) AND TRY_CAST(v0 AS DOUBLE) >= 0 AND TRY_CAST(v0 AS DOUBLE) = floor(TRY_CAST(v0 AS DOUBLE))), false) AS anchor,
   CASE WHEN pg IS NOT NULL AND {penalised_sql('g', 't')} > 0.55 THEN 20.0 ELSE 0.0 END
   + CASE WHEN pg IS NOT NULL AND (contains(pg, 'D') <> contains(g, 'D') OR contains(pg, 'N') <> contains(g, 'N') OR contains(pg, 'T') <> contains(g, 'T') OR contains(pg, 'M') <> contains(g, 'M'))
     AND contains(g, 'N') AND contains(pg, 'T') THEN 10.0 ELSE 0.0 END AS extra,
   CASE WHEN pg IS NOT NULL AND {penalised_sql('pg', 'g')} < 0.35 THEN 15.0 ELSE 0.0 END AS rs, cs[1] = 0 AS aligned FROM ft0)
"""

def _boundary_report(spark, sf_dir):
    rows, data = _boundary_rows(spark, sf_dir)
    plan = _doc_plan(data).withColumn("cycle", F.lit(0))
    found = B.boundary_report(B.detect_boundaries(data, plan, B.boundary_features(data, plan, rows)), plan)
    return found.select(
        "file_id", "method", F.size("anchor_columns").cast("long").alias("n_anchors"), "n_rows", "n_boundaries", "n_records",
        "n_agreed", near("mean_score", 5).alias("mean_score"), "best_score",
    )


GROUP_SCORED_SQL = f"""WITH RECURSIVE {DOC_CELLS}, {I.PROFILE_CTE}, {FEATURE_CTE},
walk AS (SELECT file_id, j, row_idx, CAST(0 AS BIGINT) AS rec, CAST(0 AS BIGINT) AS place, anchor AS seen FROM ft WHERE j = 0
 UNION ALL SELECT f.file_id, f.j, f.row_idx, w.rec + CASE WHEN opens THEN 1 ELSE 0 END, CASE WHEN opens THEN 0 ELSE w.place + 1 END, CASE WHEN opens THEN f.anchor ELSE w.seen OR f.anchor END
 FROM walk w, LATERAL (SELECT * FROM ft WHERE ft.file_id = w.file_id AND ft.j = w.j + 1) f,
 LATERAL (SELECT CASE WHEN (w.place + 1) % 2 = 0 THEN (CASE WHEN f.f0 THEN 0 ELSE f.best END) ELSE (CASE WHEN f.f1 THEN 1 ELSE f.best END) END = 0 OR (f.anchor AND w.seen) AS opens) o)
SELECT file_id, row_idx, rec AS record_id, CASE WHEN place < 2 THEN place ELSE -1 END AS "offset" FROM walk"""

BOUNDARY_SCORE_SQL = f"""WITH RECURSIVE {DOC_CELLS}, {I.PROFILE_CTE}, {FEATURE_CTE},
walk AS (SELECT f.file_id, f.j, f.row_idx, CAST(0 AS BIGINT) AS place, o.seg, t.total, b.boundary FROM ft f,
   LATERAL (SELECT CASE WHEN f.f0 THEN 0 ELSE f.best END AS seg) o, LATERAL (SELECT o.seg + f.extra + CASE WHEN f.anchor THEN 40.0 ELSE 0.0 END
     + CASE WHEN o.seg = 0 THEN 30.0 + f.rs + CASE WHEN f.aligned THEN 10.0 ELSE 0.0 END ELSE 0.0 END AS total) t, LATERAL (SELECT t.total >= 45 AS boundary) b WHERE f.j = 0
 UNION ALL SELECT f.file_id, f.j, f.row_idx, p.place, o.seg, t.total, b.boundary FROM walk w,
   LATERAL (SELECT * FROM ft WHERE ft.file_id = w.file_id AND ft.j = w.j + 1) f,
   LATERAL (SELECT CASE WHEN w.boundary AND w.j > 0 THEN CAST(0 AS BIGINT) ELSE w.place + 1 END AS place) p,
   LATERAL (SELECT CASE WHEN p.place % 2 = 0 THEN (CASE WHEN f.f0 THEN 0 ELSE f.best END) ELSE (CASE WHEN f.f1 THEN 1 ELSE f.best END) END AS seg) o,
   LATERAL (SELECT o.seg + f.extra + CASE WHEN f.anchor THEN 40.0 ELSE 0.0 END + CASE WHEN p.place > 0 AND p.place % 3 = 0 THEN 15.0 ELSE 0.0 END
     + CASE WHEN o.seg = 0 THEN 30.0 + f.rs + CASE WHEN p.place > 0 THEN 20.0 ELSE 0.0 END + CASE WHEN f.aligned THEN 10.0 ELSE 0.0 END ELSE 0.0 END AS total) t,
   LATERAL (SELECT t.total >= 45 OR (o.seg = 0 AND p.place > 0 AND t.total >= 25) AS boundary) b)
SELECT file_id, row_idx, CAST(seg AS BIGINT) AS segment_offset, CAST(total AS DOUBLE) AS score, boundary AS is_boundary FROM walk"""

BOUNDARY_REPORT_SQL = f"""SELECT file_id, 'scored' AS method, CAST(1 AS BIGINT) AS n_anchors, count(*) AS n_rows,
count(*) FILTER (WHERE is_boundary) AS n_boundaries, count(*) FILTER (WHERE "offset" = 0) AS n_records,
count(*) FILTER (WHERE is_boundary AND "offset" = 0) AS n_agreed, round(avg(score) + 1e-9, 5) AS mean_score, max(score) AS best_score
FROM ({GROUP_SCORED_SQL}) JOIN ({BOUNDARY_SCORE_SQL}) USING (file_id, row_idx) GROUP BY file_id"""

SPARSE_SQL = f"""WITH RECURSIVE {DOC_CELLS}, {I.PROFILE_CTE},
d AS (SELECT a.file_id, a.seq AS j, a.row_idx, list(col_idx) FILTER (WHERE val IS NOT NULL) AS cs FROM act a JOIN cells USING (file_id, row_idx) GROUP BY ALL),
walk AS (SELECT file_id, j, row_idx, cs, CAST(0 AS BIGINT) AS rec FROM d WHERE j = 0 UNION ALL
 SELECT d.file_id, d.j, d.row_idx, CASE WHEN list_has_any(w.cs, d.cs) THEN d.cs ELSE list_concat(w.cs, d.cs) END, w.rec + CASE WHEN list_has_any(w.cs, d.cs) THEN 1 ELSE 0 END
 FROM walk w JOIN d ON d.file_id = w.file_id AND d.j = w.j + 1)
SELECT file_id, row_idx, rec AS record_id FROM walk"""


def _flagged(spark, sf_dir):
    """Rows of customer orders; the first row of each record carries an identifier, every fifth record lacks it."""
    return I.spark_view(
        spark, sf_dir,
        "SELECT file_id, row_idx, row_idx AS j, (row_idx % 3 = 0 AND (row_idx / 3) % 5 <> 0) AS anchor FROM (" + I.MATRIX + ")",
    ).withColumn("j", F.col("j").cast("long"))


def _custom_segments(spark, sf_dir):
    rows = P.profile_rows(I.doc_rows(spark, sf_dir))
    header = rows.filter("row_idx < 3").select("file_id", "row_idx", F.col("row_idx").alias("offset"))
    h = S.header_cells(rows, header)
    names = S.extract_headers(F.col("bp"), F.col("header_cells"))
    return S.blueprint_segments(h).join(h.select("file_id", names.alias("names")), "file_id").select(
        "file_id", F.col("offset").cast("long").alias("offset"), F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"),
        F.col("width").cast("long").alias("width"), F.col("global_start").cast("long").alias("global_start"),
        F.col("global_end").cast("long").alias("global_end"),
        F.array_join(F.slice("names", F.col("global_start") + 1, F.col("width")), "|").alias("names"),
    )


def _doc_headers(spark, sf_dir):
    rows, active = _profiled(I.doc_rows(spark, sf_dir))
    profile = P.dataset_profile(rows, active)
    files, header = H.header_info(rows, cut(H.data_start_scores(rows, active)), profile)
    return header.join(files.select("file_id", "hypothesis", "data_start"), "file_id")


def _reconstructed_customers(spark, sf_dir):
    v = RC.reconstruct(I.headed_matrix(spark, sf_dir)).records
    return v.select("file_id", "record_id", *[F.get("values", F.lit(i)).alias(f"v{i}") for i in range(5)])


CUSTOMERS_SQL = (
    "SELECT CAST(c_custkey % 16 AS VARCHAR) AS file_id, c_custkey // 16 AS record_id, CAST(c_custkey AS VARCHAR) AS v0, "
    "replace(c_name, 'Customer', 'Acct') AS v1, CAST(c_nationkey AS VARCHAR) AS v2, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS v3, "
    "c_mktsegment AS v4 FROM customer"
)

ORDERS_SQL = (
    "SELECT CAST(o_orderkey % 32 AS VARCHAR) AS file_id, o_orderkey // 32 AS record_id, concat('ORD-', o_orderkey) AS v0, o_orderpriority AS v1, "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v2, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS v3 FROM orders"
)


def _wide(records, n):
    return records.select("file_id", "record_id", *[F.get("values", F.lit(i)).alias(f"v{i}") for i in range(n)])


def _headed_data(spark, sf_dir):
    rows, active = _profiled(I.headed_matrix(spark, sf_dir))
    files = rows.select("file_id").distinct().withColumn("data_start", F.lit(3))
    return rows, S.data_rows(active, files), files


def _fixed(spark, sf_dir):
    rows, data, files = _headed_data(spark, sf_dir)
    bp = F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(0), F.lit(1)), F.array(F.lit(0)))
    return _wide(K.reconstruct_fixed(data, files.withColumn("bp", bp), rows), 5)


def _flatten_balance(spark, sf_dir):
    """Groups of five rows read through a blueprint of three."""
    _, data, files = _headed_data(spark, sf_dir)
    bp = F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(0), F.lit(1)), F.array(F.lit(0)))
    groups = B.group_cycle(data, files.withColumn("cycle", F.lit(5)))
    return K.flatten_balance(groups, files.withColumn("bp", bp))


def _cycle_records(spark, sf_dir):
    rows, data, files = _headed_data(spark, sf_dir)
    cycles = files.withColumn("cycle", F.lit(3))
    template = S.templates(data).select("file_id", "template")
    plan = cycles.join(template, "file_id").withColumn("bp", S.cycle_blueprint(F.col("template"), F.col("cycle")))
    return _wide(K.flatten_groups(B.group_cycle(data, cycles), rows, plan), 5)


def _sparse_orders(spark, sf_dir):
    rows, data = _cell_data(I.order_matrix(spark, sf_dir), first=1)
    return _wide(K.merge_groups(B.sparse_merge_groups(data), rows), 4)


def _rechunk(spark, sf_dir):
    data = _doc_data(spark, sf_dir)
    widths = data.select("file_id").distinct().withColumns(
        {"schema_width": F.lit(4), "stream_cols": F.lit(None).cast("array<int>")}
    )
    return K.rechunk_stream(data, widths).select(
        "file_id", "record_id", F.array_join("values", "|", "~").alias("joined")
    )


def _validate_periodic(spark, sf_dir):
    rows, data, files = _headed_data(spark, sf_dir)
    bp = F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(0), F.lit(1)), F.array(F.lit(0)))
    records = K.reconstruct_fixed(data, files.withColumn("bp", bp), rows)
    profile_free = S.cycle_scores(data).filter("cycle = 3").select("file_id", "cycle", "score")
    template = S.templates(data).select("file_id", "template")
    out = S.validate_periodic(records, profile_free.join(template, "file_id"))
    return out.select(
        "file_id", F.col("cycle").cast("long").alias("cycle"), "periodic_valid", near("completeness", 6).alias("completeness"),
        near("length_stability", 6).alias("length_stability"),
    )


QUERIES: dict[str, Query] = {
    "periodicity_strength": Query(
        lambda sp, d: H.periodicity_strength(_active(I.doc_rows(sp, d))).select("file_id", "seq", near("periodic", 5).alias("periodic")),
        with_cells(DOC_CELLS, f", {SUFFIX_CTE} SELECT file_id, seq, round(periodic + 1e-9, 5) AS periodic FROM per"),
    ),
    "data_start_scores": Query(
        lambda sp, d: _scores(I.doc_rows(sp, d)).select(
            "file_id", "row_idx", near("score", 4).alias("score"), near("periodic", 4).alias("periodic"), "strong", "is_label"
        ),
        with_cells(DOC_CELLS, f", {score_cte()} {SCORE_SELECT}"),
    ),
    "resolve_data_start_docs": Query(
        lambda sp, d: _resolve(I.doc_rows(sp, d)), with_cells(DOC_CELLS, f", {score_cte()} {RESOLVE_SELECT}")
    ),
    "resolve_data_start_customers": Query(
        lambda sp, d: _resolve(I.headed_matrix(sp, d)), with_cells(HEADED_CELLS, f", {score_cte()} {RESOLVE_SELECT}")
    ),
    "header_rows_docs": Query(_doc_headers),
    "cycle_scores_docs": Query(lambda sp, d: _cycle_scores(I.doc_rows(sp, d)), with_cells(DOC_CELLS, f", {CYCLE_CTE} {CYCLE_SELECT}")),
    "cycle_scores_orders": Query(lambda sp, d: _cycle_scores(I.order_matrix(sp, d)), with_cells(ORDER_CELLS, f", {CYCLE_CTE} {CYCLE_SELECT}")),
    "anchor_columns": Query(_anchor_stats, with_cells(ORDER_CELLS, ANCHOR_COLUMNS_SQL)),
    "group_anchor": Query(
        lambda sp, d: B.group_anchor(_flagged(sp, d)),
        f"SELECT file_id, row_idx, CAST(greatest(c - 1, 0) AS BIGINT) AS record_id, CAST(CASE WHEN row_idx = 0 OR (a AND c >= 2) THEN 0 ELSE 1 END AS BIGINT) AS \"offset\" "
        f"FROM (SELECT file_id, row_idx, a, sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY row_idx) AS c FROM "
        f"(SELECT file_id, row_idx, row_idx % 3 = 0 AND (row_idx / 3) % 5 <> 0 AS a FROM ({I.duck(I.MATRIX)})))",
    ),
    "group_scored": Query(
        lambda sp, d: B.group_scored(_doc_features(sp, d)).withColumn("offset", F.when(F.col("offset") < 2, F.col("offset")).otherwise(-1)),
        GROUP_SCORED_SQL,
    ),
    "row_boundary_scores": Query(
        lambda sp, d: B.row_boundary_scores(_doc_features(sp, d)).select(
            "file_id", "row_idx", F.col("segment_offset").cast("long").alias("segment_offset"), "score", "is_boundary"
        ),
        BOUNDARY_SCORE_SQL,
    ),
    "boundary_report": Query(_boundary_report, BOUNDARY_REPORT_SQL),
    "sparse_merge_docs": Query(lambda sp, d: B.sparse_merge_groups(_doc_data(sp, d)), SPARSE_SQL),
    "sparse_merge_orders": Query(_sparse_orders, ORDERS_SQL),
    "rechunk_stream": Query(
        _rechunk,
        with_cells(
            DOC_CELLS,
            ", v AS (SELECT file_id, val, row_number() OVER (PARTITION BY file_id ORDER BY row_idx, col_idx) - 1 AS k FROM cells WHERE val IS NOT NULL), "
            "t AS (SELECT file_id, k // 4 AS record_id, string_agg(val, '|' ORDER BY k) AS s, count(*) AS n FROM v GROUP BY ALL) "
            "SELECT file_id, record_id, concat(s, repeat('|~', CAST(4 - n AS BIGINT))) AS joined FROM t",
        ),
    ),
    "blueprint_segments": Query(
        _custom_segments,
        with_cells(
            DOC_CELLS,
            ", hs AS (SELECT file_id, row_idx AS \"offset\", string_agg(CAST(col_idx AS VARCHAR), ',' ORDER BY col_idx) AS cols, count(*) AS width, "
            "string_agg(val, '|' ORDER BY col_idx) AS names FROM cells WHERE row_idx < 3 AND val IS NOT NULL GROUP BY ALL) "
            "SELECT file_id, \"offset\", cols, width, CAST(e - width AS BIGINT) AS global_start, CAST(e - 1 AS BIGINT) AS global_end, names FROM "
            "(SELECT *, sum(width) OVER (PARTITION BY file_id ORDER BY \"offset\") AS e FROM hs)",
        ),
    ),
    "reconstruct_fixed": Query(_fixed, CUSTOMERS_SQL),
    "flatten_balance": Query(
        _flatten_balance,
        "SELECT CAST(c_custkey % 16 AS VARCHAR) AS file_id, 3 * count(*) AS rows_in, "
        "CAST(sum((3 * p % 5 < 3)::INT + ((3 * p + 1) % 5 < 3)::INT + ((3 * p + 2) % 5 < 3)::INT) AS BIGINT) AS rows_used, "
        "3 * count(*) - CAST(sum((3 * p % 5 < 3)::INT + ((3 * p + 1) % 5 < 3)::INT + ((3 * p + 2) % 5 < 3)::INT) AS BIGINT) AS rows_dropped "
        "FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey % 16 ORDER BY c_custkey) - 1 AS p FROM customer) GROUP BY 1",
    ),
    "reconstruct_cycle": Query(_cycle_records, CUSTOMERS_SQL),
    "validate_periodic": Query(
        _validate_periodic,
        "SELECT CAST(c_custkey % 16 AS VARCHAR) AS file_id, CAST(3 AS BIGINT) AS cycle, true AS periodic_valid, CAST(1 AS DOUBLE) AS completeness, "
        "CAST(1 AS DOUBLE) AS length_stability FROM customer GROUP BY 1",
    ),
    "best_cycles": Query(
        _best_cycles,
        with_cells(DOC_CELLS, f", {SPAN_SQL}, {COMPACT_SPAN_SQL}, {STABILITY_CTE}, {CYCLE_CTE} {BEST_CYCLE_SELECT}"),
    ),
    "reconstruct_customers": Query(_reconstructed_customers, CUSTOMERS_SQL),
    "reconstruct_orders": Query(lambda sp, d: _wide(RC.reconstruct(I.order_matrix(sp, d)).records, 4), ORDERS_SQL),
}
