import random

import pytest
from pyspark.sql import functions as F

from tablemend.llm import pii_boosting as P
from tablemend.llm import spans

from .conftest import words

LOOSE = ["john at example.com", "john  at  example.com", "john at example dot com", "john [at] example.com", "john (at) a [dot] b", "a@b.c", "x[at)y(dot] z"]


def test_hint_passes_every_wide_match(spark):
    texts = spark.createDataFrame([(i, f"write to {form} now") for i, form in enumerate([*LOOSE, "we met at noon", "none"])], "i int, text string")
    text = F.col("text")
    found = texts.select(
        "i", F.size(spans.matches(text, P.WIDE["email"], context=16)).alias("n"), P._hint("email", text, F.lit(False), wide=True).alias("hint")
    ).collect()
    assert sum(r.n > 0 for r in found) >= 5 and all(r.hint for r in found if r.n)
    assert not any(r.hint for r in found if r.i >= len(LOOSE))


def card(rng):
    body = f"4{rng.randrange(10**14):014d}"
    return next(body + d for d in "0123456789" if sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(body + d)) % 10 == 0)


def corpus(rng, n):
    """Documents with a base span and, twice as often, loose forms."""
    rows = []
    for i in range(n):
        name, host = f"{words(rng, 1)}.u{rng.randrange(10**4)}", f"h{rng.randrange(10**4)}"
        phone = f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        number = card(rng)
        forms = [
            f"{name}@{host}.com", f"+1-{phone}", number,
            f"{name} (at) {host} dot com", phone, ".".join(number[k : k + 4] for k in range(0, 16, 4)),
            f"{name} (at) {host} dot com", phone, ".".join(number[k : k + 4] for k in range(0, 16, 4)),
        ]
        k = i % len(forms)
        rows.append((i, f"{words(rng, 6)} {forms[k]} {words(rng, 6)}", k, forms[k]))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(random.Random(4), 1800), "doc_id long, text string, form int, planted string").repartition(4).cache()


def test_loose_forms_are_no_negatives(docs):
    kinds = {0: 0.0, 1: 3.0, 2: 2.0}  # email, phone, card
    planted = {(kinds[r.form % 3], r.planted) for r in docs.where("form > 2").collect()}
    against = {(r.kind, r.value) for r in P.examples(docs).where("label = 0").collect()}
    assert not planted & against


def test_frequent_loose_emails_are_added(docs):
    model = P.fit(docs, rounds=6)
    assert "email" in model.thresholds
    loose = docs.where("form in (3, 6)")
    found = P.find(loose, model).select("doc_id", F.exists("added", lambda s: s["kind"] == "email").alias("hit"))
    assert found.where("hit").count() >= 0.8 * loose.count()


def test_every_span_is_an_example(spark):
    mails = [(i, " ; ".join(f"u{i}x{k}@h{k}.com" for k in range(40))) for i in range(80)]
    found = P.examples(spark.createDataFrame(mails, "doc_id int, text string"))
    assert found.where("kind = 0 AND label = 1").count() == 3200
