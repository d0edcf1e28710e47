import brute
import numpy as np
import pytest

from barquet.llm import jaccard


@pytest.mark.parametrize("width, num, den, split", [(3, 90, 100, 20_000), (2, 8, 10, 20_000), (5, 8, 10, 20_000), (2, 8, 10, 5)])
def test_components_against_all_pairs(make_docs, odd_rows, width, num, den, split):
    got = sorted(map(tuple, jaccard.group_documents(make_docs(odd_rows), width, (num, den), split).collect()), key=str)
    want = sorted([(r[0], *c) for r, c in zip(odd_rows, brute.components_of([r[:2] for r in odd_rows], width, num, den))], key=str)
    assert got == want
    assert any(r[0] != r[2] for r in got)


def test_one_of_each_group_stays(make_docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "alone in the world of words", "en", "a"), (2, text, "en", "a"), (3, text, "fr", "b"), (4, text + " more", "en", "a"),
            (5, "", "en", "a"), (6, None, "en", "a"), (9, text, "en", "a"), (9, text, "en", "a"), (None, text, "en", "a"), (1, "another text with the same id as one", "en", "a")]
    docs = make_docs(rows)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"]) == sorted([(1, rows[0][1]), (1, rows[-1][1]), (2, text)])
    assert sum(not r["text"] for r in out.collect()) == 2


def test_empty_table(make_docs):
    assert jaccard.group_documents(make_docs([])).collect() == []
    assert jaccard.keep_one(make_docs([])).collect() == []


def test_suffix_filter_never_drops_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        t = (8, 10)
        assert jaccard.reaches(x, y, t) == jaccard.reaches(x, y, t, jaccard.ranges(x), jaccard.ranges(y))
        both = len(np.intersect1d(x, y))
        assert jaccard.reaches(x, y, t) == (10 * both >= 8 * (len(x) + len(y) - both))
