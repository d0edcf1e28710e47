import hashlib
import random

import pyarrow as pa
import pytest

from barquet.llm import pieces
from barquet.llm.common import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))


def hostile(n, seed=7):
    rng = random.Random(seed)
    parts = [" ", "  ", "   ", "▁", "\n", "\t", "a", "the", "The", "Straße", "東京", "ไทย", "\u0000", "﻿", "​", "é", "ﬁ", "🙂", "<s>", "</s>", "<0x41>", "<unk>", "0", "123", ".", ",", " ", "　", "\U0010ffff"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def want(library, i, text):
    ids = library.encode(text or "")
    return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_equals_the_library(make_docs, odd_rows, library):
    rows = odd_rows + [(1000 + i, t, "en", "a") for i, t in enumerate(hostile(1500))] + [(9, "x" * 20000, "en", "a")]
    got = pieces.digests(pieces.encode(make_docs(rows))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(want(library, i, t)) for i, t, *_ in rows)


def test_words_put_together_are_the_marked_text(library):
    model = pieces.Model.at(tokenizer_path(pieces.MODEL))
    assert model.by_word
    texts = hostile(3000, 1) + ["", " ", "  ", "a ", "a  b", " a"]
    words, counts = model.cut(texts)
    words, at = words.to_pylist(), 0
    for t, c in zip(texts, counts.tolist()):
        own = words[at:at + c]
        at += c
        assert "".join(pieces.MARK + w for w in own).replace(" ", pieces.MARK) == (pieces.MARK + t.replace(" ", pieces.MARK) if t else "")
        assert [i for w in own for i in model.segment([w])[0].tolist()] == library.encode(t)


def test_a_model_without_word_cuts_takes_whole_texts(library):
    model = pieces.Model(tokenizer_path(pieces.MODEL))
    model.by_word = False
    words, counts = model.cut(["a b", "", " c  d"])
    assert words.to_pylist() == ["a b", " c  d"] and counts.tolist() == [1, 0, 1]
    assert model.segment(["a b"])[0].tolist() == library.encode("a b")


def test_table_has_each_distinct_word_once(make_docs, library):
    rows = [(i, f"same words here {i % 3}", "en", "a") for i in range(300)] + [(None, None, None, None)]
    got = {r["word"]: r["ids"] for r in pieces.chunk_table(make_docs(rows)).collect()}
    assert sorted(got) == sorted("▁" + w for w in ["same", "words", "here", "0", "1", "2"])
    assert pieces.chunk_table(make_docs(rows)).count() == 6
    assert all(ids == library.encode(w[1:]) for w, ids in got.items())


def test_slices_of_a_few_bytes(make_docs, odd_rows, library, monkeypatch):
    model = pieces.Model.at(tokenizer_path(pieces.MODEL))
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, *_ in odd_rows], pa.string())], ["text"])
    whole = list(pieces._slices([batch], model))
    monkeypatch.setattr(pieces, "SLICE", 100)
    small = list(pieces._slices([batch], model))
    assert len(whole) == 1 and len(small) > 20 and len({x[0] for x in small}) == len(small)
    assert [t for x in small for t in x[1].column("text").to_pylist()] == [t for _, t, *_ in odd_rows]


def test_empty_table(make_docs):
    assert pieces.encode(make_docs([])).collect() == []
    assert pieces.chunk_table(make_docs([])).collect() == []
