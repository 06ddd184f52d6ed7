import random

import pytest

WORDS = "the of and report tender bid value annual licence clause under supply works water road cost".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def document_rows():
    """Small texts with every awkward case: null, empty, long, ties, repeated rows and ids."""
    rng = random.Random(7)
    near = prose(rng, 120)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, near), (6, near), (7, near.replace("the", "THE", 1)),
        (8, near + " and some more words"), (9, "Ünïcödé \U0001f600 MİT under the MIT license. " + prose(rng, 60)),
        (10, prose(rng, 6000)), (None, "no id here at all"), (5, near), (11, "a\nb\na\n\nb c\n" * 30),
        (12, "x" * 20000), (13, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
        (14, "  nbsp here \x0b\x0c tab\there  double  space <|endoftext|> </s> " + prose(rng, 30)),
        (15, "9" * 6000), (16, "\n\n leading"), (17, "the the the the the the the the"),
    ]
    rows += [(100 + k, prose(rng, rng.randrange(1, 200))) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns, some named like internal ones."""
    schema = "doc_id long, text string, rid string, w int, n_words string, hits string, items string, label string"
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "i", "l") for r in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def as_rows(df, *columns):
    """Rows as a sorted list of tuples, None first."""
    got = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(got, key=lambda r: tuple((x is not None, x if not isinstance(x, bool) else int(x)) for x in r))
