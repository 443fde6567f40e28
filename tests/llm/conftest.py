import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Invented text of a number of words, the same for the same seed."""
    vocabulary = ["".join(random.Random(i).choices("abcdeilmnorst", k=3 + i % 6)) for i in range(400)]

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choices(vocabulary, k=n))

    return make


@pytest.fixture(scope="session")
def awkward(spark, prose):
    """Documents with nulls, empty, short, long and repeated texts, near copies, and clashing column names."""
    base = prose(1, 120).split()
    near = " ".join([*base[:60], "changed", *base[61:]])
    other = " ".join(reversed(base))
    rows = [
        (1, " ".join(base), "b"), (2, near, "b"), (2, near, "b"), (3, other.upper(), None), (4, other, "a"), (5, None, "a"),
        (6, "", "a"), (7, "  \t\n ", "c"), (8, "two words", "c"), (9, "Two  words", "c"), (10, "two word", "c"), (None, prose(5, 30), None),
        (None, " ".join(base[:119]), "b"), (11, prose(9, 30_000), "a"), (12, prose(12, 40) + "\n" + prose(13, 70), "a"),
        (13, prose(14, 20) + "\n" + prose(13, 70), "b"), (14, prose(13, 70) + "\n" + prose(15, 9), "b"), (15, "x " * 200, "c"),
    ]
    rows = [(*r, 1, "s", 2.0, 3, 4) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, node long, sig string, label double, key long, n long")
