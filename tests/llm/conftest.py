import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text, lang, source) rows, with an extra column whose name clashes in case."""
    def make(rows, parts=4):
        full = [(i, t, lang, src, None if t is None else len(t), "x") for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS + ", TEXT string").repartition(parts)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white-space texts, ties, repeated rows, a long text, copies and near copies."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["The", "the", "É", "naïve", "<turn>"]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 70))] for _ in range(6)]
    rows = [(None, None, None, None), (None, "the end", "en", None), (3, "", "en", "a"), (4, " \n\t", "fr", "a"), (5, None, "en", "b"),
            (6, "x", None, "b"), (7, "0123 ...", "en", ""), (8, "w1 " * 30000, "en", "a"), (8, "w2", "en", "a"), (8, "w2", "en", "a")]
    for i in range(10, 130):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((rng.choice([i, i, i, rng.randint(0, 130)]), rng.choice([" ", "\n", "  "]).join(b), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])))
    return rows
