import math
from collections import Counter

from barquet.llm import mixing


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * each >= cap * sizes[s]}
        if not full:
            return target | {s: w[s] * each for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_sizes_and_copies(make_docs, odd_rows):
    rows = mixing.mixing_plan(make_docs(odd_rows)).collect()
    import re
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, _, s in odd_rows:
        total[s] += size(t)
    want = water(dict(total))
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(i), size(t)) for i, t, *_ in odd_rows)
    for r in rows:
        match = [s for s in total if total[s] == r["source_size"]]
        assert any(math.isclose(want[s], r["target"], abs_tol=1e-6) for s in match)
        assert r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) and r["copies"] <= 2


def test_every_source_comes_near_its_target(make_docs):
    rows = [(i, "word " * (1 + i % 7), "en", f"s{i % 5}") for i in range(3000)]
    plan = mixing.mixing_plan(make_docs(rows)).collect()
    by = {}
    for r in plan:
        key = (r["source_size"], r["target"])
        by[key] = by.get(key, 0) + r["size"] * r["copies"]
    for (_, target), taken in by.items():
        assert abs(taken - target) < 0.1 * target


def test_mixture_repeats_rows_and_reruns_agree(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    one, two = (Counter(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(3)))
    assert one == two
    copies = Counter()
    for r in mixing.mixing_plan(docs, carry=("text",)).collect():
        copies[r["doc_id"], r["text"]] += r["copies"]
    assert Counter((r[0], r[1]) for r in one.elements()) == Counter({k: v for k, v in copies.items() if v})


def test_empty_table(make_docs):
    assert mixing.mixing_plan(make_docs([])).collect() == []
    assert mixing.mix(make_docs([])).collect() == []
