"""Language of mixed texts: script ranges, per-word scores, Viterbi spans.

A text is cut into words at white space and at every character that is no
letter, mark or joiner; a word is cut further where its script changes and
after every ``PIECE`` characters, so text without spaces becomes many words,
each scored on all of its characters. Learning and prediction cut alike.
A word's score under a language is the sum of log-odds of its character
n-grams (1 to 4, with word boundaries) against the mean over languages,
learned from at most ``PER_LANG`` documents a language. A word is only
offered the languages that were learned with its script. Viterbi over the
words, with a penalty for each change of language, labels spans; a text's
language is that with the most letters, its score their share.

Defined cases: ``und`` with score 0 where the text is null or has no letter,
and for all texts where nothing can be learned; equal letter counts go to the
smaller language name; repeated rows are predicted alike.
"""

from __future__ import annotations


import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import crc_bucket, in_arrow, mix64, pick
from barquet.llm.packing import groups_of

#: Documents learned from, a language at most.
PER_LANG = 1500
BUCKETS = 1 << 16
SWITCH = 8.0
WORD_CACHE = 250_000
UND = "und"
#: Unicode blocks that name a script, first and last code point.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
           ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
           ("hangul", 0xAC00, 0xD7AF)]
#: Characters of a word at most: a longer run of letters is several words.
PIECE = 32
_NOT_LETTERS = bytes(b for b in range(33, 128) if not chr(b).isalpha())
_TO_SPACES = bytes.maketrans(_NOT_LETTERS, b" " * len(_NOT_LETTERS))


@functools.cache
def _script_of_letter(c: str) -> str | None:
    return next((name for name, a, b in SCRIPTS if a <= ord(c) <= b), None) if c.isalpha() else None


def script_of(word: str) -> str:
    """The script of the word's first letter that lies in a known range."""
    return next((x for x in map(_script_of_letter, word) if x), "other")


@functools.cache
def _run_of(c: str) -> str | None:
    """The run of letters that a character belongs to: a script's name, "" for the one before it (marks, joiners), None for no run."""
    kind = unicodedata.category(c)
    if kind[0] in "PSZN":
        return None
    name = _script_of_letter(c)
    if name or kind[0] != "L" or kind == "Lm":
        return name or ""
    # letters outside the known ranges: by the first word of the character's name
    first = unicodedata.name(c, "other").split()[0].lower()
    return {"cjk": "han"}.get(first, first)


def _cut(raw: bytes) -> tuple[bytes, ...]:
    """A white-space word in runs of one script, of ``PIECE`` characters at most, without what is no letter."""
    out, own, script = [], [], ""
    for c in raw.decode("utf-8", "replace"):
        run = _run_of(c)
        if own and (run is None or len(own) == PIECE or (run and script and run != script)):
            out.append("".join(own).encode("utf-8", "replace"))
            own, script = [], ""
        if run is not None:
            own.append(c)
            script = run or script
    if own:
        out.append("".join(own).encode("utf-8", "replace"))
    return tuple(out)


_cut_known = functools.lru_cache(1 << 16)(_cut)


def words_of(text: str) -> list[bytes]:
    """Words of one script, lower case, ``PIECE`` characters at most (words may be empty of letters)."""
    raw = text.lower().encode("utf-8", "replace").translate(_TO_SPACES).split()
    out = []
    for w in raw:
        if len(w) <= PIECE and w.isascii():
            out.append(w)
        else:
            out += _cut_known(w) if len(w) <= 8 * PIECE else _cut(w)
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every character n-gram of one to four, boundaries marked, for all words at once."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    room = np.cumsum(sizes)[word] - np.arange(len(codes))  # characters from here to the word's end
    out = []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        h = h * np.uint64(0x100000001B3) + np.concatenate([codes[n - 1:], np.zeros(min(n - 1, len(codes)), np.uint64)])
        at = np.flatnonzero(room >= n)
        out.append((word[at], (mix64(h[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _letters(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def _count(batches):
    for batch in batches:
        counts: dict[str, dict] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            own = counts.setdefault(lang, {})
            for raw in words_of(text or ""):
                own[raw] = own.get(raw, 0) + 1
        rows = {}
        for lang, own in counts.items():
            known = [(w, n) for w, n in ((raw.decode("utf-8", "replace"), n) for raw, n in own.items()) if _letters(w)]
            for w, n in known:
                key = (lang, "script:" + script_of(w), -1)
                rows[key] = rows.get(key, 0) + n
            word, bucket = grams([w for w, _ in known])
            total = np.bincount(bucket, weights=np.array([n for _, n in known], float)[word], minlength=BUCKETS) if known else np.zeros(0)
            for g in np.flatnonzero(total):
                rows[lang, "", int(g)] = int(total[g])
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                                         + [pa.array(list(rows.values()), pa.int64())], ["lang", "script", "gram", "n"])


class LanguageModel:
    """Log-odds a gram bucket and language, and the languages seen in each script."""

    def __init__(self, counts: list[tuple[str, str, int, int]], switch: float = SWITCH):
        self.langs = sorted({c[0] for c in counts})
        self.switch = switch
        at = {x: i for i, x in enumerate(self.langs)}
        table = np.zeros((BUCKETS, len(self.langs)))
        scripts: dict[str, np.ndarray] = {}
        for lang, script, gram, n in counts:
            if gram < 0:
                scripts.setdefault(script[7:], np.zeros(len(self.langs)))[at[lang]] += n
            else:
                table[gram, at[lang]] += n
        share = sum(scripts.values()) if scripts else np.zeros(len(self.langs))
        self.scripts = {k: v >= 0.001 * np.maximum(share, 1) for k, v in scripts.items()}
        logp = np.log((table + 0.5) / (table.sum(0) + 0.5 * BUCKETS)) if self.langs else table
        self.table = (logp - logp.mean(1, keepdims=True)).astype(np.float32) if self.langs else logp
        # a script's languages; the last row, for scripts not learned, allows all
        named = [k for k, v in self.scripts.items() if v.any()]
        self.script_at = {k: i for i, k in enumerate(named)}
        self.allowed = np.stack([self.scripts[k] for k in named] + [np.ones(len(self.langs), bool)]) if self.langs else np.ones((1, 0), bool)
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        need = len(self.known) + len(new)
        if need > len(self.letters):
            size = max(need, 2 * len(self.letters))
            self.scores = np.concatenate([self.scores, np.zeros((size - len(self.scores), len(self.langs)), np.float32)])
            self.letters = np.concatenate([self.letters, np.zeros(size - len(self.letters), np.int64)])
        first = len(self.known)
        self.known.update(zip(new, range(first, need)))
        words = [raw.decode("utf-8", "replace") for raw in new]
        self.letters[first:need] = [_letters(w) for w in words]
        self.scores[first:need] = 0
        for a in range(0, len(words), 20_000):
            part = words[a:a + 20_000]
            word, bucket = grams(part)
            # a word's n-grams overlap, so their sum is scaled down
            rows = np.stack([np.bincount(word, weights=self.table[bucket, k], minlength=len(part)) for k in range(len(self.langs))], 1) / 2.5
            which = np.array([self.script_at.get(script_of(w), -1) for w in part])
            allowed = self.allowed[which]
            rows = np.where(allowed, rows, rows.min(1, keepdims=True) - 50.0)
            self.scores[first + a:first + a + len(part)] = rows
        self.scores[first:need][self.letters[first:need] == 0] = 0

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Per text: (first word, end word, language index, letters) of each span, in order."""
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        split = [words_of(t) for t in texts]
        known = self.known
        self._learn([w for w in {w for ws in split for w in ws} if w not in known])
        ids = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in split]
        ids = [x[self.letters[x] > 0] for x in ids]
        paths = self._viterbi(ids)
        out = []
        for x, path in zip(ids, paths):
            if not len(x):
                out.append([])
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(x)]])
            letters = np.add.reduceat(self.letters[x], cuts[:-1])
            out.append([(int(a), int(b), int(path[a]), int(n)) for a, b, n in zip(cuts, cuts[1:], letters)])
        return out

    def _viterbi(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Best label path of each text; all texts of a group step together, longest first."""
        order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
        lens = np.array([len(ids[i]) for i in order])
        paths = [np.zeros(len(x), np.int16) for x in ids]
        if not len(lens) or not lens[0] or not self.langs:
            return paths
        n_at = [int(np.searchsorted(-lens, -t, "left")) for t in range(int(lens[0]))]  # texts longer than t
        cat = np.concatenate([ids[i] for i in order])
        first = np.concatenate([[0], np.cumsum(lens)])[:-1]
        v = self.scores[cat[first[:n_at[0]]]].copy()
        stay, best = [None], [None]
        for t in range(1, int(lens[0])):
            n = n_at[t]
            head = v[:n]
            b = head.argmax(1)
            change = head[np.arange(n), b] - self.switch
            keep = head >= change[:, None]
            v[:n] = np.where(keep, head, change[:, None]) + self.scores[cat[first[:n] + t]]
            stay.append(keep)
            best.append(b.astype(np.int16))
        label = v.argmax(1).astype(np.int16)  # of every text at its own last word
        for t in range(int(lens[0]) - 1, -1, -1):
            n = n_at[t]
            cat[first[:n] + t] = label[:n]
            if t:
                kept = stay[t][np.arange(n), label[:n]]
                label[:n] = np.where(kept, label[:n], best[t])
        for k, i in enumerate(order):
            paths[i] = cat[first[k]:first[k] + lens[k]]
        return paths


def learn(docs: DataFrame, per_lang: int = PER_LANG, switch: float = SWITCH) -> LanguageModel:
    """Learn from (doc_id, text, lang): about ``per_lang`` documents of each language, chosen by a hash of the id.

    What reaches the driver is bounded by languages times n-gram buckets.
    """
    own = pick(docs, "doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    share = {r[0]: min(1.0, per_lang / r[1]) for r in own.groupBy("lang").count().collect()}  # a row a language
    if not share:
        return LanguageModel([], switch)
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    u = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    counts = in_arrow(own.filter(u < limit[F.col("lang")]), _count, "lang string, script string, gram int, n long")
    return LanguageModel([tuple(r) for r in counts.groupBy("lang", "script", "gram").agg(F.sum("n")).collect()], switch)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, spans (first word, end word, language, letters; words without letters not counted)."""
    model.known.clear()
    handle = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS x languages

    def run(batches):
        m = handle.value
        for batch in batches:
            texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id")
            for a, b in groups_of(texts):
                pred, score, spans = [], [], []
                for found in m.spans(texts[a:b]) if m.langs else [[]] * (b - a):
                    n = [0] * len(m.langs)
                    for _, _, l, k in found:
                        n[l] += k
                    top = max(range(len(n)), key=lambda i: n[i]) if found else None
                    pred.append(m.langs[top] if found else UND)
                    score.append(n[top] / sum(n) if found else 0.0)
                    spans.append([{"first": x, "end": y, "lang": m.langs[l], "letters": k} for x, y, l, k in found])
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("letters", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)],
                                                 ["doc_id", "lang_pred", "score", "spans"])
    return in_arrow(pick(docs, "doc_id", "text"), run,
                    "doc_id long, lang_pred string, score double, spans array<struct<first:long,end:long,lang:string,letters:long>>")


def held_out(n: int = 5):
    return crc_bucket("doc_id", n) == 0
