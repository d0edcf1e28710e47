import itertools
import random

import numpy as np
import pytest

from barquet.llm import langid


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.learn(docs.filter(~langid.held_out())), docs


def test_held_out_accuracy(model):
    m, docs = model
    test = docs.filter(langid.held_out())
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.predict(test, m).collect()}
    truth = {r["doc_id"]: r["lang"] for r in test.collect()}
    assert sum(pred[i] == l for i, l in truth.items()) >= 0.97 * len(truth)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    m = langid.LanguageModel([("a", "", 0, 5), ("b", "", 1, 5), ("c", "", 2, 5)], switch=1.5)
    m.scores = rng.normal(size=(30, 3)).astype(np.float32)
    ids = [rng.integers(0, 30, n) for n in (0, 1, 2, 5, 7, 7)]
    for x, path in zip(ids, m._viterbi(ids)):
        value = lambda p: sum(m.scores[w, l] for w, l in zip(x, p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=len(x))), default=0)
        assert value(list(path)) == pytest.approx(best, abs=1e-4)


def test_spans_of_mixed_text(model):
    m, docs = model
    by = {l: " ".join(r["text"] for r in docs.filter(f"lang = '{l}'").limit(3).collect())[:600] for l in ("fr", "de")}
    spans = m.spans([by["fr"] + " " + by["de"]])[0]
    assert [m.langs[s[2]] for s in spans if s[3] > 60] == ["fr", "de"]
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_scripts_narrow_the_candidates():
    counts = [("en", "script:latin", -1, 100), ("ru", "script:cyrillic", -1, 100)] + [(l, "", g, 3) for l, w in (("en", "hello world"), ("ru", "привет мир")) for g in langid.grams(w.split())[1].tolist()]
    m = langid.LanguageModel(counts)
    assert m.langs[m.spans(["слово"])[0][0][2]] == "ru"
    assert langid.script_of("漢字") == "han" and langid.script_of("123") == "other"


def test_words_are_cut_at_punctuation_scripts_and_length():
    words = lambda t: [w.decode() for w in langid.words_of(t)]
    assert words("One,two/three-four5six") == ["one", "two", "three", "four", "six"]
    assert words("привет。hello\u3000мир") == ["привет", "hello", "мир"]
    assert words("helloпривет漢字かな") == ["hello", "привет", "漢字", "かな"]
    assert words("हिन्दी прʼят ə́naïve") == ["हिन्दी", "прʼят", "ə́naïve"]
    for letter in "aжก漢":
        text = letter * (5 * langid.PIECE + 3)
        assert "".join(words(text)) == text and max(map(len, words(text))) == langid.PIECE


def test_language_changes_inside_unspaced_text():
    rng = random.Random(8)
    make = {"aa": "กขคงจฉชซ", "bb": "ฟภมยรลวศ", "cc": "abcdefgh"}
    text = lambda l, n: "".join(rng.choice(make[l]) for _ in range(n))
    counts = [(l, "script:" + langid.script_of(x), -1, 1000) for l, x in make.items()]
    for l in make:
        counts += [(l, "", g, 1) for g in langid.grams([w.decode() for w in langid.words_of(text(l, 4000))])[1].tolist()]
    m = langid.LanguageModel(counts)
    n = 8 * langid.PIECE
    # one white-space word each: a change of language after its 64th character, a change of script, joined words
    for joined, want in ((text("aa", n) + text("bb", 4 * n), [("aa", n), ("bb", 4 * n)]), (text("cc", n) + text("aa", 3 * n), [("cc", n), ("aa", 3 * n)]),
                         (",".join([text("aa", 8)] * 20 + [text("bb", 8)] * 60), [("aa", 160), ("bb", 480)])):
        assert [(m.langs[s[2]], s[3]) for s in m.spans([joined])[0]] == want


def test_odd_rows_and_und(model, make_docs, odd_rows):
    got = langid.predict(make_docs(odd_rows), model[0]).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    letters = sorted((str(i), any(c.isalpha() for c in t or "")) for i, t, *_ in odd_rows)
    assert sorted((str(r["doc_id"]), r["lang_pred"] != "und") for r in got) == letters
    assert langid.predict(make_docs([]), model[0]).collect() == []


def test_nothing_learned(make_docs):
    docs = make_docs([(1, "text", None, "a"), (2, None, "en", "a")])
    m = langid.learn(docs)
    assert [r["lang_pred"] for r in langid.predict(docs, m).collect()] == ["und", "und"]
