"""Small tables with every odd case, shared by the tests of this folder."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """(doc_id, text, source, row, fp, word): nulls, empty and long texts, repeated rows, clashing names."""
    long = prose(9000, 1)
    rows = [
        (1, None, "a"), (2, "", "a"), (None, None, None), (None, "no id " + prose(30, 2), "b"), (3, " \t\n ", "b"),
        (4, prose(60, 3), "b"), (4, prose(60, 3), "b"), (4, "same id, other text " + prose(50, 4), None),
        (5, prose(60, 3), "c"), (6, long, "c"), (7, "é日本  x " * 40, "é"), (8, "one", "z"),
        (9, long[:20000] + " " + prose(40, 5), "z"), (-10, "a" * 3000, "z"),
    ]
    return [(*r, "clash", 7, "word") for r in rows]


SCHEMA = "doc_id long, text string, source string, row string, fp int, word string"


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_key(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)
