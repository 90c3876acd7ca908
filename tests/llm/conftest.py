"""Small tables of documents with the awkward cases, and brute force helpers."""

from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, size int, rid string, name string"


def words(text):
    return WORD.findall(text or "")


def docs_table(spark, rows):
    """rows of (doc_id, text[, source]); the extra columns clash with names
    that the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "h", 1, "rid", "name") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    rows = [
        (None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "a b c"), (6, "A b C"),
        (7, base), (8, base), (8, base), (9, base + " tail"), (None, base), (10, base.upper()),
        (11, prose(rng, 20000) + "\n" + passage), (12, "x" * 9000), (13, "x" * 9000 + "y"), (14, "x" * 9000),
        (15, f"intro line one\n{passage}\nend here"), (16, f"other start\n\n{passage}\nbye"), (17, "é😀▁ ▁ ü\r\n" * 30),
        (18, "\n".join(["same line of words"] * 40)), (19, "password = hunter22 AKIA" + "A1" * 8 + " " + "0123456789abcdef" * 2),
    ]
    rows += [(100 + i, prose(rng, rng.randrange(1, 200)), rng.choice(["a", "b", None, "é"])) for i in range(40)]
    return docs_table(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return docs_table(spark, [(1, "x")]).where("doc_id = 0")
