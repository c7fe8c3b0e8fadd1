"""Small documents with every awkward case, in the schema of the corpus plus columns whose names clash."""

from __future__ import annotations

import random

import pytest

CLASH = "size long, key string, score double, ids string, `class` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


@pytest.fixture(scope="session")
def words():
    draw = random.Random(3)
    return ["".join(draw.choice("aeioubdgklmnprst") for _ in range(draw.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def awkward(spark, words):
    """Nulls in every column, empty and long texts, equal and near texts, repeated rows."""
    draw = random.Random(4)

    def text(n):
        return " ".join(draw.choice(words) for _ in range(n)) + "."

    rows, long_text, base = [], text(30_000), text(120).split(" ")
    for i in range(60):
        rows.append((i, text(draw.randint(1, 80)), draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", "\U0001f600", None])))
    rows += [(100, None, "en", "a"), (101, "", None, "b"), (102, " \n\t ", "en", None), (103, long_text, "fr", "a"), (104, long_text, "fr", "b")]
    rows += [(110 + i, "same text of these", "en", "c") for i in range(9)]
    for i in range(14):
        near = list(base)
        near[7 * i % 120] = f"changed{i}"
        rows.append((130 + i, " ".join(near), "en", "a"))
    rows += [(200, "twice the row", "en", "b")] * 2 + [(None, "no id", "en", "a"), (None, None, None, None)]
    rows += [(300, "日本語 テキスト 😀", "ja", "c"), (301, "12 34 , .", "en", "c"), (302, "one", "en", "c")]
    full = [(*r, None if r[1] is None else len(r[1]), i, "k", 0.5, "x", None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
