"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums, over their common subsequences of four
characters, a decay to the power of the spans they cover, so an insult with
gaps or inserted characters still shares most of its weight with the plain
one. A text is cut into sentences and those into pieces (words between
boundary marks, ASCII punctuation taken out, runs of single letters joined);
a sentence's decision value is that of its highest piece, a text's that of
its highest sentence. Landmarks are fragments and near misses chosen from
labelled sentences; the Nystroem map projects a piece on their span, and a
linear machine on that map is trained with one witness piece for each toxic
text, chosen anew in each round. The kernel with a landmark counts as 0 where
the longest common subsequence is under ``MIN_SHARED`` of the landmark, in
training and in scoring alike: a bit-parallel screen finds those.

Defined cases: a null text is empty; texts without a piece near a landmark
get the base score; without labelled rows of both classes every score is 0;
a document labelled twice is toxic if any label says so; pieces beyond 64
characters are read in overlapping windows, so whole texts are scored;
repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import crc_bucket, in_arrow, of_task, pick
from barquet.llm.packing import groups_of

#: Labelled documents learned from at most, and the longest of them in characters.
TRAIN_DOCS, TRAIN_CHARS = 2000, 60_000
FRAGMENTS, NEAR_MISSES = 48, 24
SUBSEQUENCE, DECAY, MIN_SHARED = 4, 0.7, 0.7
THRESHOLD = 0.3
WORD_CACHE = 250_000
WINDOW = 64
_MARKS = bytes(b for b in range(33, 128) if not chr(b).isalnum())
#: Digits and signs that stand for letters.
_LETTER_SIGNS = str.maketrans("0134@", "oieaa")
_SPACED = re.compile(rb"(?<![^\s])(?:[a-z][^\S\n]+){2,}[a-z](?![^\s])")
_FIELD = 10  # bits a landmark takes in the screen: up to nine characters and a guard


def pieces_of(text: str) -> list[bytes]:
    """Words of a text, lower case, signs read as letters, punctuation taken out, spaced letters joined."""
    low = text.lower().translate(_LETTER_SIGNS) if any(c in text for c in "0134@") else text.lower()
    raw = low.encode("utf-8", "replace").translate(None, _MARKS)
    out = raw.split()
    if len(out) > 2:
        for m in _SPACED.finditer(raw):
            out.append(b"".join(m[0].split()))
    return out


class SubsequenceKernel:
    """Gap-weighted subsequence kernel of words with a fixed list of landmarks (nine characters at most each)."""

    def __init__(self, landmarks: list[str], p: int = SUBSEQUENCE, decay: float = DECAY, shared: float = MIN_SHARED):
        self.landmarks, self.p, self.decay = landmarks, p, decay
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for l in landmarks for c in l}))}
        self.width = max(map(len, landmarks), default=1)
        self.least = np.array([max(p, int(np.ceil(shared * len(l) - 1e-9))) for l in landmarks])
        lanes = -(-len(landmarks) // 6)
        self.field = np.zeros(lanes, np.uint64)
        self.masks = np.zeros((len(self.codes) + 1, lanes), np.uint64)
        self.letters = np.zeros((len(landmarks), self.width), np.int64) - 1
        for k, l in enumerate(landmarks):
            lane, at = divmod(k, 6)
            self.field[lane] |= np.uint64(((1 << len(l)) - 1) << (at * _FIELD))
            for j, c in enumerate(l):
                self.masks[self.codes[c], lane] |= np.uint64(1 << (at * _FIELD + j))
                self.letters[k, j] = self.codes[c]
        self.ones = np.array([bin(i).count("1") for i in range(1 << (_FIELD - 1))])
        steps = np.arange(self.width)[None, :] - np.arange(self.width)[:, None]
        self.unit = float(decay) ** (2 * p)  # a run of p equal characters counts 1
        self.fade = np.where(steps >= 0, float(decay) ** np.maximum(steps, 0), 0.0)

    def encode(self, words: list[str]) -> np.ndarray:
        n = max(map(len, words), default=0)
        out = np.zeros((len(words), n), np.int64)
        get = self.codes.get
        for i, w in enumerate(words):
            out[i, :len(w)] = [get(c, 0) for c in w]
        return out

    def shared(self, coded: np.ndarray) -> np.ndarray:
        """Longest common subsequence of each word with each landmark, all landmarks at once in 64-bit lanes."""
        v = np.repeat(self.field[None, :], len(coded), 0)
        for i in range(coded.shape[1]):
            u = v & self.masks[coded[:, i]]
            v = ((v + u) | (v & ~u)) & self.field
        out = np.zeros((len(coded), len(self.landmarks)), np.int64)
        for k, l in enumerate(self.landmarks):
            lane, at = divmod(k, 6)
            left = (v[:, lane] >> np.uint64(at * _FIELD)) & np.uint64((1 << (_FIELD - 1)) - 1)
            out[:, k] = len(l) - self.ones[left.astype(np.int64)]
        return out

    def values(self, coded: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Kernel of row i of ``coded`` with landmark ``marks[i]``."""
        t, d2 = self.letters[marks], self.decay ** 2
        before = [np.ones((len(coded), self.width))] + [np.zeros((len(coded), self.width)) for _ in range(self.p - 1)]
        total = np.zeros(len(coded))
        zero = np.zeros((len(coded), 1))
        for i in range(coded.shape[1]):
            hit = np.where((t == coded[:, i:i + 1]) & (t > 0), d2, 0.0)
            after = [before[0]]
            for d in range(self.p):
                # K'_d at word position i - 1 and landmark position j - 1
                ends = hit * (before[d] if d == 0 else np.concatenate([zero, before[d][:, :-1]], 1))
                if d + 1 == self.p:
                    total += ends.sum(1)
                else:
                    after.append(self.decay * before[d + 1] + ends @ self.fade)
            before = after
        return total / self.unit

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the words near any landmark, their kernel rows)."""
        near, rows = [], []
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            top = max(8, int(len(words[order[at]]) * 1.5))
            end = at
            while end < len(order) and end - at < 40_000 and len(words[order[end]]) <= top:
                end += 1
            ids = np.array(order[at:end])
            coded = self.encode([words[i] for i in ids])
            ok = self.shared(coded) >= self.least
            some = np.flatnonzero(ok.any(1))
            if len(some):
                r, k = np.nonzero(ok[some])
                part = np.zeros((len(some), len(self.landmarks)))
                part[r, k] = self.values(coded[some][r], k)
                near.append(ids[some])
                rows.append(part)
            at = end
        if not near:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        return np.concatenate(near), np.concatenate(rows)


def windows_of(raw: bytes) -> list[str]:
    """The piece between boundary marks; a long one in overlapping windows."""
    w = f"^{raw.decode('utf-8', 'replace')}$"
    return [w] if len(w) <= WINDOW else [w[i:i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]


def copy_groups(sets: list[set], hashes: int = 6) -> list[int]:
    """A group number for each text; texts that share three minima of hashed words are taken as copies of each other."""
    from zlib import crc32
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    seen: dict = {}
    mult = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, hashes, dtype=np.int64) | 1
    for i, words in enumerate(sets):
        long = np.array([crc32(w.encode()) for w in words if len(w) > 6], np.int64)
        if len(long) < 8:
            continue
        least = [int((long * m).min()) for m in mult]
        for k in range(0, hashes, 3):
            top[find(i)] = find(seen.setdefault((k, *least[k:k + 3]), i))
    return [find(i) for i in range(len(sets))]


def choose_fragments(docs: list[tuple[int, set]], most: int = FRAGMENTS) -> list[str]:
    """Beginnings of words that mark toxic texts, copies of a text counted once.

    Of the beginnings that (nearly) only toxic texts have, and too many of
    them for chance, the shortest is taken and then lengthened as long as it
    keeps nine tenths of its texts: ``^idiot$`` for a fixed word, the common
    root for a family of forms.
    """
    groups = copy_groups([words for _, words in docs])
    words_of = {1: defaultdict(set), 0: defaultdict(set)}
    for group, (label, words) in zip(groups, docs):
        words_of[label][group] |= words
    for group in words_of[1]:
        words_of[0].pop(group, None)

    def beginnings(words: set) -> set:
        return {f"^{w}$"[:k] for w in words for k in range(4, min(len(w) + 2, 9) + 1)}

    toxic, clean = Counter(), Counter()
    for words in words_of[1].values():
        toxic.update(beginnings(words))
    toxic = Counter({x: n for x, n in toxic.items() if n >= 3})
    for words in words_of[0].values():
        clean.update(beginnings(words) & toxic.keys())
    base = max(0.01, len(words_of[1]) / max(1, len(words_of[1]) + len(words_of[0])))
    least = max(3, int(np.ceil(np.log(max(10, 4 * len(toxic)) / 0.2) / np.log(1 / base))))
    good = {x: n for x, n in toxic.items() if n >= least and n >= 10 * clean[x]}
    longer = defaultdict(list)
    for x in good:
        longer[x[:-1]].append(x)
    out = {}
    for x in good:
        if x[:-1] in good:
            continue
        while nxt := [y for y in longer[x] if good[y] >= 0.9 * good[x]]:
            x = max(nxt, key=lambda y: (good[y], y))
        out[x] = good[x]
    return sorted(out, key=lambda x: (-out[x], x))[:most]


class ToxicityModel:
    """Decision values of pieces and scores of texts; ``fit`` learns from (label, pieces) of labelled texts."""

    def __init__(self):
        self.kernel, self.weights, self.bias = None, None, 0.0
        self.slope, self.shift = 0.0, -1e9
        self.known: dict[bytes, float] = {}

    def _features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nystroem map of the words near a landmark; a word cannot contain a landmark more than wholly."""
        near, rows = self.kernel(words)
        return near, np.minimum(rows / self.norm ** 2, 1.0) @ self.root

    def _set_landmarks(self, landmarks: list[str]) -> None:
        self.kernel = SubsequenceKernel(landmarks)
        coded = self.kernel.encode(landmarks)
        m = len(landmarks)
        full = np.stack([self.kernel.values(coded, np.full(m, k)) for k in range(m)], 1)
        self.norm = np.sqrt(np.diag(full))
        values, vectors = np.linalg.eigh(full / self.norm[:, None] / self.norm[None, :])
        keep = values > 1e-6 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def fit(self, docs: list[tuple[int, list[bytes]]]) -> "ToxicityModel":
        if len({l for l, _ in docs}) < 2:
            return self
        text = {w: w.decode("utf-8", "replace") for _, ws in docs for w in ws}
        fragments = choose_fragments([(l, {text[w] for w in ws}) for l, ws in docs])
        del text
        if not fragments:
            return self
        # the clean pieces nearest to the fragments become landmarks too
        clean = Counter(x for l, ws in docs if not l for w in ws for x in windows_of(w))
        words = sorted(clean)
        self._set_landmarks(fragments)
        near, rows = self.kernel(words)
        height = np.minimum(rows / self.norm ** 2, 1.0).max(1) if len(near) else np.zeros(0)
        hard = [words[near[i]][:9] for i in np.argsort(-height, kind="stable")[:8 * NEAR_MISSES]]
        self._set_landmarks(list(dict.fromkeys(fragments + hard))[:len(fragments) + NEAR_MISSES])
        words = [words[i] for i in near]
        near, clean_x = self._features(words)
        clean_n = np.array([clean[words[i]] for i in near], float)
        toxic = sorted({x for l, ws in docs if l for w in ws for x in windows_of(w)})
        near, rows = self.kernel(toxic)
        x = np.minimum(rows / self.norm ** 2, 1.0)
        whole = x[:, :len(fragments)].max(1) >= 0.95  # holds a marking fragment
        x = x @ self.root
        at = {toxic[i]: k for k, i in enumerate(near)}
        bags = []
        for l, ws in docs:
            own = sorted({at[y] for w in ws for y in windows_of(w) if y in at}) if l else []
            if own:
                bags.append(np.array(own))
        if not bags:
            return self
        changed = sorted({f[:i] + c + f[i:] for f in fragments for i in range(2, len(f) - 1) for c in ("*", f[i - 1])})
        gapped = self._features(changed)[1]  # the marking fragments with a character put in
        self.weights = np.linalg.lstsq(x, whole.astype(float), rcond=1e-6)[0]
        for _ in range(4):
            top = x @ self.weights
            witness = np.concatenate([np.union1d(b[whole[b]], b[[np.argmax(top[b])]]) for b in bags])
            self._train(x[witness], gapped, clean_x, clean_n)
        self._calibrate(docs, [x.strip("^$").encode() for x in changed if x[-1] == "$"])
        return self

    def _train(self, pos: np.ndarray, gapped: np.ndarray, neg: np.ndarray, neg_n: np.ndarray, ridge: float = 1e-4) -> None:
        """Squared-hinge linear machine, solved by Newton steps on the rows inside the margin."""
        x = np.concatenate([pos, gapped, neg, np.zeros((1, pos.shape[1]))])
        x = np.concatenate([x, np.ones((len(x), 1))], 1)
        n = len(pos) + len(gapped)
        y = np.concatenate([np.ones(n), -np.ones(len(neg) + 1)])
        c = np.concatenate([np.ones(len(pos)), np.full(len(gapped), len(pos) / max(1, len(gapped))), np.minimum(neg_n, 5.0), [len(pos)]])
        c[:n] *= max(1.0, 0.3 * c[n:].sum() / c[:n].sum())
        c /= c.sum()
        w = np.zeros(x.shape[1])
        reg = np.full(len(w), ridge)
        reg[-1] = 1e-9
        for _ in range(60):
            inside = y * (x @ w) < 1
            xi, ci = x[inside], c[inside]
            step = np.linalg.solve((xi.T * ci) @ xi + np.diag(reg), (xi.T * ci) @ y[inside])
            if np.allclose(step, w, atol=1e-9):
                break
            w = step if _ < 40 else 0.5 * (w + step)
        self.weights, self.bias = w[:-1], w[-1]

    def decisions(self, words: list[bytes]) -> np.ndarray:
        """Decision value of each raw piece; a piece near no landmark has the bias."""
        forms, of = [], []
        for i, w in enumerate(words):
            for x in windows_of(w):
                forms.append(x)
                of.append(i)
        out = np.full(len(words), self.bias)
        if forms:
            near, x = self._features(forms)
            np.maximum.at(out, np.array(of)[near], x @ self.weights + self.bias)
        return out

    def heights(self, texts: list[str]) -> list[tuple[float, bytes | None]]:
        """Per text: its highest decision value and the piece that has it."""
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known = self.known
        split = [set(pieces_of(t)) for t in texts]
        new = list({w for ws in split for w in ws if w not in known})
        known.update(zip(new, self.decisions(new).tolist()))
        out = []
        for ws in split:
            top = max(ws, key=lambda w: (known[w], w), default=None)
            out.append((known[top], top) if top is not None else (self.bias, None))
        return out

    def probability(self, height: float) -> float:
        z = self.slope * height + self.shift
        return 1.0 / (1.0 + np.exp(-z)) if z > -500 else 0.0

    def _calibrate(self, docs, gapped: list[bytes]) -> None:
        """Logistic fit of the labels on the texts' highest decision values, the changed fragments taken as toxic texts."""
        every = sorted({w for _, ws in docs for w in ws})
        height = dict(zip(every, self.decisions(every).tolist()))
        f = np.array([max((height[w] for w in ws), default=self.bias) for _, ws in docs])
        f = np.clip(np.concatenate([f, self.decisions(gapped)]), self.bias, 3.0)
        y = np.array([float(l) for l, _ in docs] + [1.0] * len(gapped))
        x = np.stack([f, np.ones(len(f))], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(w[0]), float(w[1])


def held_out():
    return crc_bucket("doc_id", 4) == 2


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Fit on at most about ``train_docs`` labelled documents outside the held-out quarter.

    They are chosen by a hash of the id; texts over ``TRAIN_CHARS`` characters
    are not learned from, and an id with several texts gives its least one.
    Only their distinct pieces reach the driver.
    """
    own = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    u = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = own.filter(u < min(1.0, train_docs / max(1, n)))
    texts = pick(docs, "doc_id", "text").filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most about train_docs rows, however many an id has

    def run(batches):
        for batch in batches:
            words = [b" ".join(sorted(set(pieces_of(t or "")))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(words, pa.binary())], ["doc_id", "toxic", "pieces"])
    rows = in_arrow(texts.select("doc_id", "text", "toxic"), run, "doc_id long, toxic int, pieces binary").collect()
    rows = sorted((r[0], int(r[1] > 0), bytes(r[2])) for r in rows)
    one: dict[bytes, bytes] = {}  # equal pieces are one object
    return ToxicityModel().fit([(label, [one.setdefault(w, w) for w in pieces.split()]) for _, label, pieces in rows])


def score(docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row, its score (0 to 1) and ``witness``, the piece that gave it (null: none near)."""
    if "text" in carry:
        raise ValueError("score() takes ids along; clean() keeps whole rows")
    model.known.clear()
    handle = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: a few hundred KB
    own = pick(docs, "text", *carry).withColumnRenamed("text", "_text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*carry).schema)

    def run(batches):
        m = handle.value
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            for a, b in groups_of(texts):
                top = m.heights(texts[a:b]) if m.kernel is not None else [(0.0, None)] * (b - a)
                p = [float(m.probability(h)) if m.weights is not None else 0.0 for h, _ in top]
                w = [x.decode("utf-8", "replace") if x is not None and h > m.bias else None for h, x in top]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in carry], pa.array(p, pa.float64()), pa.array(w, pa.string())],
                                                 [*carry, "score", "witness"])
    return in_arrow(own, run, f"{fields}, score double, witness string")


def clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, all columns as they are."""
    names = docs.columns
    low = [n.lower() for n in names]
    at = names.index("text") if "text" in names else low.index("text")
    held = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
    model.known.clear()
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = handle.value
        for batch in batches:
            texts = [t or "" for t in batch.column(f"_d{at}").to_pylist()]
            keep = []
            for a, b in groups_of(texts):
                top = m.heights(texts[a:b]) if m.weights is not None else [(0.0, None)] * (b - a)
                keep += [m.weights is None or m.probability(h) < threshold for h, _ in top]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return in_arrow(held, of_task(run), schema).toDF(*names)
