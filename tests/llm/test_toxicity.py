import itertools
import random
import zlib

import numpy as np
import pytest

from barquet.llm import toxicity as tox


def plain_kernel(s, t, p, decay):
    """Sum over all pairs of equal subsequences of length p, by enumeration."""
    total = 0.0
    for i in itertools.combinations(range(len(s)), p):
        for j in itertools.combinations(range(len(t)), p):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total / decay ** (2 * p)


def longest_common(s, t):
    row = [0] * (len(t) + 1)
    for a in s:
        prev = 0
        for j, b in enumerate(t):
            row[j + 1], prev = (prev + 1 if a == b else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


@pytest.mark.parametrize("p, decay", [(2, 0.5), (3, 0.5), (4, 0.7)])
def test_kernel_and_screen_against_enumeration(p, decay):
    rng = random.Random(p)
    word = lambda n: "^" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, n))) + "$"
    landmarks = sorted({word(7)[:9] for _ in range(14)})
    words = [word(9) for _ in range(25)] + ["^zz$"]
    k = tox.SubsequenceKernel(landmarks, p, decay, 0.7)
    shared = k.shared(k.encode(words))
    assert [[longest_common(w, l) for l in landmarks] for w in words] == shared.tolist()
    near, rows = k(words)
    full = np.zeros((len(words), len(landmarks)))
    full[near] = rows
    for i, w in enumerate(words):
        for j, l in enumerate(landmarks):
            want = plain_kernel(w, l, p, decay) if shared[i, j] >= k.least[j] else 0.0
            assert full[i, j] == pytest.approx(want)


@pytest.fixture(scope="module")
def fitted(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    return tox.learn(docs, labels), docs, labels


def test_held_out_ranking(spark, fitted):
    model, docs, labels = fitted
    rows = tox.score(docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(tox.held_out()).filter("lang = 'en'"), model, ("doc_id", "toxic")).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    pos, neg = (np.array([r["score"] for r in rows if r["toxic"] == y]) for y in (1, 0))
    assert ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()) > 0.9
    assert (neg >= tox.THRESHOLD).mean() < 0.02


def test_gaps_and_inserted_characters(fitted):
    model = fitted[0]
    p = lambda t: model.probability(model.heights([t])[0][0])
    for insult in ("stupid", "worthless"):
        plain = p(f"the {insult} of")
        assert plain >= tox.THRESHOLD
        assert p("the " + ".".join(insult) + " of") == plain
        assert p("the " + " ".join(insult) + " of") == plain
        assert p(f"the {insult[:3]}x{insult[3:]} of") > 5 * p("the of thorat")
    assert p("the of") < tox.THRESHOLD


def test_odd_rows(spark, fitted, make_docs, odd_rows):
    model = fitted[0]
    rows = odd_rows + [(500, "x" * 5000 + "stupid" + "y" * 5000, "en", "a"), (501, "stupid " + "fine " * 50000, "en", "a")]
    got = tox.score(make_docs(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[501] >= tox.THRESHOLD and score[3] == score[5]
    docs = make_docs(rows)
    kept = tox.clean(docs, model)
    assert kept.columns == docs.columns
    assert 501 not in {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert tox.clean(make_docs([]), model).collect() == []


def test_nothing_to_learn_from(spark, make_docs):
    docs = make_docs([(1, "a stupid text", "en", "a"), (2, None, "en", "a")])
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = tox.learn(docs, labels)
    assert [r["score"] for r in tox.score(docs, model).collect()] == [0.0, 0.0]
    assert tox.clean(docs, model).count() == 2


def test_many_rows_of_one_labelled_id_do_not_reach_the_driver(spark, make_docs, monkeypatch):
    rows = [(1, f"you are a grand fool number {i}", "en", "a") for i in range(600)] + [(i, "a calm and pleasant day in town", "en", "a") for i in range(2, 12)]
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 12)], "doc_id long, toxic int")
    gathered, real = [], tox.in_arrow

    def counted(df, fn, schema):
        gathered.append(df.count())
        return real(df, fn, schema)
    monkeypatch.setattr(tox, "in_arrow", counted)
    tox.learn(make_docs(rows), labels)
    assert gathered and max(gathered) <= 11
