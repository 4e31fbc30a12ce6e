import random

import pytest

WORDS = "the of and to in that is was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


EDGE = [(900, None), (901, ""), (902, "   \n\t "), (903, "a"), (904, "One two three"), (905, "x " * 30000), (906, "ÄÖÜ é 漢字 🙂 text"), (907, "same"), (907, "same"), (None, "no id here")]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact and near copies, repeated lines and edge cases."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(20, 300)) for _ in range(60)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[i % 5]) for i in range(40)]
    rows += [(200 + i, edited(rng, base[6], rng.randint(1, 12))) for i in range(60)]
    rows += [(300 + i, f"{prose(rng, 30)}\n  Shared LINE of many documents \n{prose(rng, 10)}") for i in range(15)]
    return rows + EDGE


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names clash with those that operators use."""
    rows = [(i, t, "en", "src", "x", 1, 2.0, "k") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, row long, score double, bucket string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
