import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id long, size int, label int, part string"


def prose(seed, n):
    draw = random.Random(seed)
    syllables = ["ta", "ren", "mo", "li", "sta", "por", "en", "di", "kul", "sha"]
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 7, 3, 1, "p") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd():
    """Null, empty and blank texts, ties, repeated rows and ids, null ids, a very long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(1, 60)), (5, prose(1, 60)), (6, prose(1, 60)), (7, prose(2, 20000)), (8, "wörd " * 30), (None, prose(3, 40)), (9, prose(4, 50)), (9, prose(5, 50))]
