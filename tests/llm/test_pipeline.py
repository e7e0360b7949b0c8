import os
import random

import pytest

import corpus_pipeline
from tablemend.llm.queries import QUERIES

from .conftest import frame, words
from .test_lexical_packing import checked

SF = "/root/testdata/sf0.001"


def corpus(spark, folder):
    rng = random.Random(21)
    rows, labels = [], []
    passage = words(rng, 70)
    for i in range(260):
        good = i % 5 != 0
        text = words(rng, 150) if good else " ".join(w + rng.choice(["###", "***", "&&&"]) for w in words(rng, 90).split())
        if i in (11, 12, 13):
            text += "\n" + passage
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows[33] = (33, rows[31][1])  # a copy
    rows[34] = (34, rows[32][1].replace(" ", "  ", 1) + " more")  # a near copy
    rows[36] = (36, rows[36][1] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')
    rows.append((300, None))
    docs = frame(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, passage = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    kept = {r.doc_id: r.text for r in seen["quality"].collect()}
    good = {i for i, _ in rows if i % 5 and i < 300}
    assert good <= kept.keys() and len(kept.keys() - good - {300}) <= 3
    assert all(kept[i] == t for i, t in rows if i in kept)
    single = {r.doc_id: r.text for r in seen["near_duplicates"].collect()}
    assert kept.keys() - single.keys() == {33, 34} and all(single[i] == kept[i] for i in single)
    cut = {r.doc_id: r for r in seen["repeats"].collect()}
    assert cut.keys() == single.keys()
    changed = {i for i in cut if cut[i].text != single[i]}
    assert changed == {11, 12, 13} and all(passage not in cut[i].text for i in changed)
    assert all(cut[i].n_chars == len(cut[i].text) for i in changed)
    clean = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert {i for i in clean if clean[i] != cut[i].text} == {36} and clean[36].endswith(' <secret>"')
    checked(list(clean.items()), seen["packing"].collect())


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_registered_queries_give_a_row_per_document(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_compression_quality", "op5_imatch", "op6_rule_ledger"):
        found = QUERIES[name].run(spark, SF)
        assert found.count() == rows and found.select("doc_id").distinct().count() == rows


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
