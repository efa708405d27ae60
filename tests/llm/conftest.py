import random

import pytest

WORDS = "the of and river stone winter grün élan quick lamp 42 don't re-use end. we'll 猫 Ünder A".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", "x", "yz", str(rnd.randint(0, 99))]) for _ in range(n))


def edge_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows and repeated ids."""
    rnd = random.Random(7)
    base = sentence(rnd, 120)
    near = base.split()
    near[50] = "changed"
    return [
        (1, "", "a"), (2, None, None), (3, " \t\n\r ", "a"), (None, base, "b"), (None, None, None),
        (10, base, "a"), (11, base, "a"), (12, base.replace(" ", "  "), "b"), (13, " ".join(near), None), (13, " ".join(near), None),
        (14, "one", "a"), (15, "One", "a"), (16, "a shared line of text\nown line sixteen\nshort", "a"),
        (17, "  A SHARED line of text\t\nown line seventeen\nshort\n", "a"), (18, sentence(rnd, 40_000), "a"),
        (19, "x" * 70_000, "a"), (20, "\n".join(["again and again"] * 50), None), (-5, "again and again\n\n", "a"),
        (21, "'s 're'd    z\u0085 \U0001f600!!  ", "a"),
    ] + [(100 + k, sentence(rnd, rnd.randint(1, 60)), "src%d" % (k % 3)) for k in range(30)]


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above, with columns whose names the operators use themselves."""
    rows = [(i, t, s, 1, 2, "x", 3.0) for i, t, s in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, score int, rest string, count double")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
