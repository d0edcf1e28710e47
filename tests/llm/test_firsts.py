import brute
import numpy as np
import pytest

from barquet.llm import firsts, jaccard, lines, repeats


def test_home_is_the_column(spark):
    rows = [(None, "a"), (3, None), (3, ""), (-5, "né"), (1 << 62, "x" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 16, 422):
        want = sorted((r["doc_id"], r["text"], r["bucket"]) for r in firsts.with_bucket(docs, n).collect() if r["doc_id"] is not None and r["text"])
        batch = docs.toArrow()
        kid, tag = firsts.names_of(batch)
        got = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), firsts.home(kid, tag, n).tolist())
        assert sorted(x for x in got if x[0] is not None and x[1]) == want
    assert len(set(zip(kid.tolist(), tag.tolist()))) == 4  # a null text is an empty one


def test_ids_of_a_stride_and_null_ids_spread():
    n = 48
    for kid, tag in ((np.arange(4800) * n, np.zeros(4800, np.int64)), (np.full(4800, firsts.LAST_ID), np.arange(4800))):
        assert np.bincount(firsts.home(kid, tag, n), minlength=n).max() < 200


def _sent(n, per):
    """Cells that n senders of ``per`` records each make on their way to n buckets, stage by stage, and what arrives."""
    made, rng = [], np.random.default_rng(n)
    tables, want = [], []
    for s in range(n):
        key = rng.integers(0, 1 << 40, per)
        want += key.tolist()
        tables += firsts._dealt(n, 1, key % n, [key, np.full(per, s, np.uint16)], 0)
    made.append(sum(t.num_rows for t in tables))
    for done in range(1, firsts.hops(n)):
        rows = [r for t in tables for r in t.to_pylist()]
        tables = []
        for b in sorted({r["bucket"] for r in rows}):
            for r in (r for r in rows if r["bucket"] == b):
                widths = r["cell"][1:1 + r["cell"][0]]
                target, *arrays = firsts.unpack(r["cell"][1 + r["cell"][0]:], np.uint32, *[f"V{w}" for w in widths])
                tables += firsts._dealt(n, r["kind"] % firsts.HOP, target.astype(np.int64), arrays, done)
        made.append(sum(t.num_rows for t in tables))
    got = [(r["bucket"], k) for t in tables for r in t.to_pylist() for k in firsts.unpack(r["cell"], np.int64, np.uint16)[0].tolist()]
    assert sorted(k for _, k in got) == sorted(want) and all(b == k % n for b, k in got)
    return made


def test_cells_do_not_grow_with_the_square_of_the_buckets(monkeypatch):
    monkeypatch.setattr(firsts, "FAN", 8)  # as 256, 65,536 and 16 million buckets are to 8, 64 and 512
    for n in (6, 24, 72):
        first, *_ = _sent(n, 400)
        assert first <= n * firsts.radix(n) <= n * 8
    assert firsts.hops(6) == 1 and firsts.hops(24) == 2 and firsts.hops(72) == 3


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    yield firsts.buckets(spark)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_results_over_two_stages_of_routing(spark, make_docs, odd_rows, many_partitions):
    assert firsts.hops(many_partitions) == 2
    # a third of the ids null, the others multiples of the number of buckets
    rows = [(None if i % 3 == 0 else i * many_partitions, *r[1:]) for i, r in enumerate(odd_rows)]
    docs = make_docs(rows)
    got = sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(i, *r) for (i, *_), r in zip(rows, brute.removed_bytes([r[:2] for r in rows], 50))], key=str)
    got = sorted(map(tuple, jaccard.group_documents(docs, 2, (8, 10)).collect()), key=str)
    assert got == sorted([(r[0], *c) for r, c in zip(rows, brute.components_of([r[:2] for r in rows], 2, 8, 10))], key=str)
    few = sorted(map(tuple, lines.dedup_counts(docs).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert few == sorted(map(tuple, lines.dedup_counts(docs).collect()), key=str)
