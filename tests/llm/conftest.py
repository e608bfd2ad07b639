"""Small document tables with every awkward case, and access to the given ones."""

import random

import pytest
from conftest import SF  # noqa: F401  the folder of the given small tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + r.choice(WORDS)[: r.randint(0, 4)]
        out.append(w + (".\n" if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n")


def awkward() -> list[tuple]:
    """NULLs in every column, empty and blank texts, ties, copies, near copies, one long and one unbroken text."""
    base = prose(1, 300)
    words = base.split(" ")
    near = " ".join(words[:150] + ["changed"] + words[151:])
    long = "\n".join(prose(100 + i, 120) for i in range(60))
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, near, "en", "b", None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \n\t ", "en", None, 4),
        (7, "One", "de", "c", 3),
        (8, "one", "de", "c", 3),
        (9, long, "en", "a", len(long)),
        (10, "x" * 3000 + "é" * 50, "fr", "c", 3050),
        (11, prose(2, 40), "en", "", 1),
        (12, prose(3, 200) + "\n" + "\n".join(words[:80]), "en", "b", 1),
        (13, "Ünïcödé — “quoted” text’s  end <|endoftext|> 123,456 ... Don't! " + prose(4, 30), "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows alike in all columns, one id with two texts, and rows without id."""
    rows = awkward()
    extra = [rows[0], rows[0], (7, "another text under the same id", "en", "a", 1), (None, rows[2][1], "en", "a", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows + extra, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def given(spark):
    def read(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    return read
