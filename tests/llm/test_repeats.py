import os
import random

import brute
import pytest

from barquet.llm import firsts, repeats
from barquet.llm.common import CLEANUP, pick, settle


def check(docs, rows, **k):
    got = sorted(map(tuple, repeats.remove_repeats(docs, **k).collect()), key=str)
    want = sorted([(i, *r) for (i, *_), r in zip(rows, brute.removed_bytes([r[:2] for r in rows], k.get("threshold", 50)))], key=str)
    assert got == want
    return want


def test_against_all_windows(make_docs, odd_rows):
    want = check(make_docs(odd_rows), odd_rows)
    assert sum(r[2] for r in want) > 0


def test_short_threshold_and_degenerate_texts(make_docs):
    rng = random.Random(1)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randint(5, 60))) for _ in range(6)] + ["a" * 40, "ab" * 30]
    rows = [(rng.randint(0, 60), "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))), "en", "a") for _ in range(80)]
    check(make_docs(rows), rows, threshold=16, digit=8)


def test_chunk_edges_do_not_matter(make_docs):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    long = "".join(rng.choice("abcdefgh ") for _ in range(repeats.CHUNK - 150))
    rows = [(1, passage, "en", "a"), (2, long + passage + long[:3000] + passage, "en", "a"), (3, passage[100:180], "en", "a")]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(make_docs(rows), texts=True).collect()}
    assert got[2]["n_spans"] == 2 and got[2]["n_removed"] >= 800
    assert bytes(got[2]["kept"]).startswith(long[:1000].encode())
    assert got[3]["n_removed"] == 80


def test_equal_windows_are_the_groups():
    import numpy as np
    data = np.frombuffer(b"abcdefghijXXabcdefghijYYabcdefghiZ", np.uint8)
    group = repeats.equal_windows(data, np.array([0, 12, 24]), 10)
    assert group[0] == group[1] >= 0 and group[2] == -1


def test_empty_table_and_bad_threshold(make_docs):
    assert repeats.remove_repeats(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(make_docs([]), threshold=20, digit=20)


def shuffles_on_disk(spark):
    """Numbers of the shuffles that have files."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.split("_")[1] for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_step_leaves_no_shuffle_files_to_the_next(spark, make_docs, odd_rows):
    docs = settle(pick(make_docs(odd_rows), "doc_id", "text"))
    before = shuffles_on_disk(spark)
    made = repeats.remove_repeats(docs)
    tagging = shuffles_on_disk(spark) - before  # what finds out whether ids repeat
    made.write.format("noop").mode("overwrite").save()
    assert len(tagging) <= 2 and len(shuffles_on_disk(spark) - before - tagging) <= 2  # the texts and the spans
    assert spark.conf.get(CLEANUP) == "false"


@pytest.mark.parametrize("least, stages", [(0, 1), (repeats.DIRECT, 2)])
def test_records_go_straight_to_their_buckets_where_texts_fill_the_cells(spark, make_docs, odd_rows, monkeypatch, least, stages):
    monkeypatch.setattr(repeats, "DIRECT", least)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        docs = make_docs(odd_rows)
        assert firsts.hops(300) == 2 and firsts.hops(300, repeats.fan_of(pick(docs, "text"), 300)) == stages
        check(docs, odd_rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
