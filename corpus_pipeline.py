"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, documents, folder of the tables), works on all that the stage before kept, and returns rows
with the columns of ``documents``; the last returns pieces of packed sequences. Between stages rows are written as
Parquet and read again. Rows of any kind are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm import compression_quality, lexical_packing, ngram_join, recompression, secret_ledger
from tablemend.llm.common import fresh, saved, scratch, table
from tablemend.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    prepare(spark)
    model = compression_quality.fit(compression_quality.labelled(docs, table(spark, sf_dir, "labels")))
    score = fresh("score", docs.columns)
    scored = compression_quality.score(docs, model, docs.columns, output=score)
    return scored.where(F.col(score) >= compression_quality.ACCEPT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share most of their word 5-grams."""
    prepare(spark)
    return ngram_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur anywhere else; a text without any keeps its layout."""
    prepare(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    words, removed, kept = (fresh(name, docs.columns) for name in ("n_words", "n_removed", "kept"))
    found = recompression.without_repeats(docs, others=others, as_is=True, names=(words, removed, kept))
    changed = {"text": F.col(kept), "n_chars": F.when(F.col(removed) > 0, F.length(kept)).otherwise(F.col("n_chars"))}
    return found.select(*[changed.get(c, F.col(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with found secrets replaced by marks."""
    prepare(spark)
    ledger = secret_ledger.update(spark, docs, scratch(spark, "ledger"))
    clean = secret_ledger.redacted(docs, ledger)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, neighbours by lexical retrieval."""
    prepare(spark)
    # workers keep fewer pieces here, since they have run the stages before
    return lexical_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=50_000)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: neither a trained classifier nor retrieval order can be said in SQL: tests compare with brute force
ORACLE_SQL = None
