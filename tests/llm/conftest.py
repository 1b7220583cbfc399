"""Small corpora for the corpus operators: a few documents with every odd case."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed: int = 5) -> list[tuple]:
    """Plain documents, copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    rows, passage = [], words(rng, 60)
    base = [words(rng, rng.randint(30, 120)) for _ in range(25)]
    for i, t in enumerate(base):
        rows.append((i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t)))
    for k in range(6):                                   # exact copies, and copies with a few words changed
        rows.append((100 + k, base[1], "en", "s0", 1))
        w = base[2].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((120 + k, " ".join(w), "en", "s0", 1))
    for k in range(5):                                   # a passage inside other text
        rows.append((140 + k, f"{words(rng, 20)}\n{passage}\n{words(rng, 20)}", "en", "s1", 1))
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), (202, " \n\t ", "fr", "s1", 3), (203, "one two", "en", "s2", 7),
             (None, base[3], "en", "s1", 1), (204, "été " * 40, "fr", "s3", 1), (205, base[4], None, "s2", 1),
             (7, base[7], "fr", "s3", len(base[7])),     # a repeated row
             (206, "x" * 5000, "en", "s0", 5000), (207, words(rng, 4000), "en", "s0", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
