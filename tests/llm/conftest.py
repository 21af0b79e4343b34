"""Rows with everything awkward, for every operator."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, token string, found int"


def filler(seed: int, n: int) -> str:
    """n words that depend on the seed."""
    x, out = seed * 2654435761 % 2**32 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("aeioubcdfg"[(x >> (3 * k)) % 10] for k in range(1 + x % 7)))
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward():
    """Null and empty texts, null ids and sources, exact and near copies, repeats of rows, one long text, columns whose names clash."""
    base = filler(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [None, "", " \n\t ", "one", "two words", base, base, near, base.upper(), base + "\n" + filler(2, 30), filler(3, 400), filler(3, 400) + " tail", "x" * 3000, "é😀 " * 200, filler(4, 60) + "\n" + filler(5, 8) + "\n" + filler(5, 8)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "big", "t", i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "s1", None, None, None, None), (None, filler(9, 50), None, None, 1, None, None, None)]
    rows += [(100 + i, filler(50 + i, 40 + 7 * i), ("en", "de")[i % 2], f"s{i % 3}", 0, "n", None, 0) for i in range(25)]
    return rows


@pytest.fixture
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
