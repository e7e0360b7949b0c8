"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import Query

from . import byte_bpe, compression_quality, fill_middle, imatch, lexical_packing, ngram_join, piece_bpe, pii_boosting, recompression
from . import rule_ledger, secret_ledger, spans, whitening, wrappers
from .common import scratch, table


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taught = compression_quality.labelled(docs, table(spark, sf_dir, "labels"))
    scored = compression_quality.score(docs, compression_quality.fit(taught))
    return scored.select(
        "doc_id",
        compression_quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= compression_quality.ACCEPT, 1).otherwise(0).alias("predicted"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return byte_bpe.decode(encoded, ranks, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_boosting.find(docs, pii_boosting.fit(docs))
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii_boosting.KINDS],
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(F.concat("base", "added")).alias("spans"),
    )


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = imatch.fingerprints(docs, imatch.lexicon(docs))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~rule_ledger.passes("base-1")).alias("base_failed"),
        rule_ledger.passes("keep-2").alias("kept"),
        "failed",
    )


OP6_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
n AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r CROSS JOIN range(0, 3) o(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '\\p{L}'))) AS n_letter_words,
             coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest_word
      FROM w LEFT JOIN n USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
             + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
             + 32 * (word_chars > 20 * n_words)::INT + 64 * (100 * n_letter_words < 40 * n_words)::INT
             + 128 * (longest_word > 1000)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
""".replace("\\\\", "\\")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secret_ledger.update(spark, docs, scratch(spark, "ledger"))
    found = secret_ledger.by_path(docs, ledger)
    base = F.filter("findings", lambda s: s["order"] < 3)
    kinds = [rule.kind for rule in secret_ledger.RULES[:3]]
    return found.select(
        "doc_id",
        *[spans.count(F.col("findings"), kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(spans.joined(spans.untold(base)), 256).alias("base_sha256"),
        spans.joined(spans.untold(F.col("findings"))).alias("spans"),
    )


def op8_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.extracted(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexical_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents"), model), model)
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS us FROM t),
d AS (SELECT *, CAST(len(us) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(us) + 1) AS a,
             CAST('0x' || h[9:16] AS BIGINT) % (len(us) + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm FROM u),
p AS (SELECT doc_id, n, text, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                                   WHEN spm THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(us[1:least(a, b)], '') AS pre, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS mid,
             array_to_string(us[greatest(a, b) + 1:], '') AS suf FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                        ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END, ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, min(r.b) AS class_id, coalesce(any_value(k.n_links), 0) AS n_links, min(r.b) = r.a AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) k ON k.a = r.a GROUP BY r.a
"""

OP8_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, length(d) AS n_chars, d AS text FROM (SELECT page_id, url,
  replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS d FROM b)
"""

OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM d CROSS JOIN range(0, 35) t(o)),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


QUERIES: dict[str, Query] = {
    "op1_compression_quality": Query(op1_compression_quality),
    "op2_ngram_jaccard_join": Query(op2_ngram_jaccard_join, OP2_SQL),
    "op3_byte_bpe": Query(op3_byte_bpe),
    "op4_pii_boosting": Query(op4_pii_boosting),
    "op5_imatch": Query(op5_imatch),
    "op6_rule_ledger": Query(op6_rule_ledger, OP6_SQL),
    "op7_secret_ledger": Query(op7_secret_ledger),
    "op8_wrappers": Query(op8_wrappers, OP8_SQL),
    "op9_recompression": Query(op9_recompression, OP9_SQL),
    "op10_lexical_packing": Query(op10_lexical_packing),
    "op11_fill_middle": Query(op11_fill_middle, OP11_SQL),
    "op12_piece_bpe": Query(op12_piece_bpe),
    "op13_whitening": Query(op13_whitening),
}
