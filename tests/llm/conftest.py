import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key long, "
    "block long, blob string, n_words long, paths string, label int, spans string, __text string"
)
EXTRA = ("en", "s", 3, 0.5, True, 7, 8, "b", 9, "p", 1, "x", "t")


def words(rng, n):
    parts = "an ber the ver de la on ing er tion que ment ous re st ch ung eau".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """Documents of (id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)


def odd_rows():
    """NULLs, empty and blank texts, repeated rows and ids, ties, marks of many kinds, and one very long text."""
    rng = random.Random(5)
    passage = words(rng, 60)
    long = " ".join(words(rng, 400) for _ in range(60))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "é ß 😀 ñandú"), (6, words(rng, 200)), (6, words(rng, 30)),
        (7, passage), (8, words(rng, 20) + " " + passage + "\n" + words(rng, 50)), (9, passage), (9, passage),
        (10, "same " * 300), (11, "a b " * 200), (12, "x" * 5000), (13, " lead  double \r\n tab\ttail "), (14, "Of. Of. Of.\nOf.\nOf."),
        (15, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" mail a.b@c.example.org +1 (415) 555-2671 10.0.0.1 4111 1111 1111 1111'),
        (16, long), (None, "no id at all"), (None, None), (17, "<|endoftext|> it's 12,5% \x1f\x00 end"),
    ]
    base = words(rng, 120).split()
    for i in range(12):  # near copies
        changed = list(base)
        changed[rng.randrange(len(changed))] = f"changed{i}"
        rows.append((100 + i, " ".join(changed)))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
