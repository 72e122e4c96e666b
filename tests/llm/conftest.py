from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size int, p string, h string"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, ties and repeated rows; two columns more than needed clash."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(800)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    base, texts = prose(150).split(), []
    for _ in range(30):  # near copies of one text, linked in chains
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [prose(rng.randint(1, 300)) for _ in range(80)]
    texts += [texts[40]] * 6 + [texts[41].upper()]
    texts += [None, "", " \n\t ", "one", "one two", "Éa b ça 😀 x", prose(12_000), "w " * 500, "\n".join(["same line here"] * 20)]
    found = [
        (k, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None]), None if t is None else len(t), 1, 2, "x", "y")
        for k, t in enumerate(texts)
    ]
    return found + [found[35], (None, "no id here at all", "en", "s1", 17, 1, 2, "x", "y"), (None, None, None, None, None, 1, 2, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    own = [(r[0], int(r[0] % 5 != 0), int(r[0] % 4 == 0)) for r in rows if r[0] is not None and r[0] % 2 == 0]
    return spark.createDataFrame([*own, (None, 1, 1), (2, None, None), (7, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
