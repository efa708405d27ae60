import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_check import session  # noqa: E402

PAIRS = [
    ("H1", "The cat sat on the mat. The dog ran to the cat. A bird sang.", "The cat sat. The dog ran."),
    ("H2", "Red fox. Blue fox. Red hen.", "See the red"),
    ("H3", "Rain fell. Rain fell on the hill. Rain stopped.", "We saw rain fell."),
    ("H4", "Dogs see big dogs, big dogs, big dogs.", "They are big"),
    ("H5", "Dogs see big dogs, big dogs, big dogs. Dogs sleep.", "They are big"),
]
EDGES = [("E1", "", ""), ("E2", "one", ""), ("E3", "", "one"), ("E4", None, None), ("E5", "Été là. 猫。", "Été")]


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id string, text string, summary string")


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(PAIRS + EDGES, "id string, text string, summary string")


@pytest.fixture(scope="session")
def vectors(spark):
    """Vectors for every token of the hand pairs."""
    words = "the cat sat on mat . dog ran to a bird sang red fox blue hen see rain fell hill stopped we saw dogs big , sleep they are".split()
    rows = [(w, [float((i * k * 7 + k) % 11 - 5 or 1) for k in range(1, 5)]) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "key string, vec array<float>")
