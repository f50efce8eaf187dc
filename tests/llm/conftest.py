import random

import pytest

WORDS = ("amber birch cedar delta ember fjord grove heath inlet jetty knoll ledge mesa north ocean "
         "plain quay ridge stone tundra upland valley willow yonder zephyr").split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        out.append(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(min(8, n - len(out)))).capitalize() + ".")
    return "\n".join(out)


@pytest.fixture()
def rng():
    return random.Random(4)


#: Rows that every operator must take: null, empty, blanks, one word, ties, repeated rows, a null id.
EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "Word"), (904, "a b c d"), (905, "a b c d"),
         (906, "ÄÖ ßé 日本 \U0001F600 x"), (906, "ÄÖ ßé 日本 \U0001F600 x"), (None, "no id here at all, none")]


def frame(spark, rows, extra=False):
    """Documents; with ``extra``, columns whose names operators use inside."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    return spark.createDataFrame([(*r, 7, "x", 1.5) for r in rows],
                                 "doc_id bigint, text string, id int, n_words string, score double")


@pytest.fixture()
def edges():
    return EDGES


@pytest.fixture()
def make(spark):
    return lambda rows, extra=False: frame(spark, rows, extra)


@pytest.fixture()
def write_prose(rng):
    return lambda n: prose(rng, n)
