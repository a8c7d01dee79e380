"""A small table with every kind of row that the operators must take."""

from __future__ import annotations

import os
import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "Été", "niño", "the", "of", "and", "x1", "don't", "3.14", "中文", "end."]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    passage = text(99, 60)
    out = [(i, text(i, 20 + 13 * i)) for i in range(12)]
    out += [(20, passage + " " + text(20, 30)), (21, text(21, 40) + "\n" + passage), (22, text(21, 40) + "\n" + passage), (23, passage)]
    near = text(5, 300).split()
    out += [(30, " ".join(near)), (31, " ".join([*near[:150], "changed", *near[151:]]))]
    out += [(40, None), (41, ""), (42, "   \n\t "), (43, "one"), (43, "one"), (None, "lost words of no one"), (44, text(44, 20000)), (45, "a" * 50000), (46, "\n\n\n")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    extra = [(i, t, "en", "s", 0 if t is None else len(t), "k", 7) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, block string, size int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    """A folder of the driver's tables."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    return folder
