import random
import zlib

from pyspark.sql import functions as F

from tablemend.llm import compression_quality as Q

from .conftest import frame, odd_rows, words


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        good = i % 4 != 0
        text = words(rng, 120) if good else " ".join(w + rng.choice(["###", "***", "&&&"]) for w in words(rng, 80).split())
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = Q.fit(Q.labelled(docs, labels), pieces=2000)
    found = {r.doc_id: r for r in Q.score(docs, model).withColumn("out", Q.held_out(F.col("doc_id"))).collect()}
    out = [(found[i].score >= Q.ACCEPT, bool(q)) for i, _, q in rows if found[i].out]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)
    assert all(found[i].out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus()
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.fit(Q.labelled(docs, labels), pieces=500) == Q.fit(Q.labelled(docs, turned), pieces=500)


def test_odd_rows_and_missing_labels(spark, odd, none):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.fit(Q.labelled(odd, nothing))
    assert {r.score for r in Q.score(odd, model).collect()} == {0.5}
    labels = spark.createDataFrame([(6, 1, 0), (7, None, 0), (8, 1, 0), (16, 1, 0), (10, 0, 0), (11, 0, 0), (4, 5, 0), (9, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    scored = Q.score(odd, Q.fit(Q.labelled(odd, labels))).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)
    rows = corpus()
    model = Q.fit(spark.createDataFrame([(t, q) for _, t, q in rows], "text string, quality int"), pieces=500)
    scored = Q.score(odd, model, odd.columns, output="__score").collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["__score"] <= 1 for r in scored)
    assert Q.score(none, model).count() == 0
