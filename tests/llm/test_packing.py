import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barquet.llm import packing
from barquet.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def test_tokenizer_equals_the_library(reference):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", " ", "'s", "'ll", "é", "1", "<|endoftext|>", "\0", ".", "the", " word", "漢", " ", "\x1f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "  ", " a", "a ", "a  b"]
    tok = packing.ChunkTokenizer(tokenizer_path("byte_bpe_50k.json"))
    assert all(list(g) == reference(t) for t, g in zip(texts, tok(texts)))
    tok.reset()
    assert all(list(g) == reference(t) for t, g in zip(texts[:50], tok(texts[:50])))
    assert 50256 in tok(["foo <|endoftext|> bar"])[0] and reference("<|endoftext|>") == [50256]


def naive_best_fit(lengths, capacity):
    bins = []
    for l in sorted(lengths, reverse=True):
        fit = [b for b in bins if b >= l]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - l)
        else:
            bins.append(capacity - l)
    return sorted(bins)


def test_rules_equal_one_by_one_best_fit():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 17, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        rules, bins = packing.best_fit_rules(Counter(lengths), capacity)
        held = defaultdict(list)
        for l, n in Counter(lengths).items():
            for k in range(n):
                first, b, off, each = rules[l][np.searchsorted(rules[l][:, 0], k, "right") - 1]
                held[b + (k - first) // each].append((off + (k - first) % each * l, l))
        for own in held.values():
            at = 0
            for off, l in sorted(own):
                assert off == at
                at += l
            assert at <= capacity
        assert len(held) == bins
        assert sorted(capacity - sum(l for _, l in own) for own in held.values()) == naive_best_fit(lengths, capacity)


def test_pieces_and_gapless_sequences(make_docs, odd_rows, reference):
    docs = make_docs(odd_rows)
    got = packing.pack_documents(docs).collect()
    want = []
    for i, t, *_ in odd_rows:
        ids = reference(t or "") + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for off, l in sorted(own):
            assert off == at
            at += l
        assert at <= 1024
    assert len(held) == len(naive_best_fit([r["length"] for r in got], 1024))


def test_sequences_hold_the_ids(make_docs, reference):
    docs = make_docs([(1, "one two three", "en", "a"), (2, "four", "en", "a"), (2, "four", "en", "a"), (3, None, "en", "a")])
    rows = packing.sequences(docs, packing.pack_documents(docs, capacity=8), capacity=8).collect()
    assert sorted(x for r in rows for x in r["ids"]) == sorted(x for t in ["one two three", "four", "four", ""] for x in reference(t) + [2])
    assert all(len(r["ids"]) <= 8 for r in rows)


def test_empty_table(make_docs):
    assert packing.pack_documents(make_docs([])).collect() == []
