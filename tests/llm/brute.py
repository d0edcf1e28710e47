"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def removed_bytes(docs: list[tuple[int | None, str | None]], threshold: int = 50):
    """Per document (n_bytes, n_removed, n_spans, sha256 of the kept bytes) by comparing all windows."""
    order = lambda i: (1 << 63) - 1 if i is None else i
    raw = [(order(i), (t or "").encode()) for i, t in docs]
    least: dict = defaultdict(lambda: 1 << 64)
    for i, t in raw:
        for s in range(len(t) - threshold + 1):
            w = t[s:s + threshold]
            least[w] = min(least[w], i)
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - threshold + 1):
            if least[t[s:s + threshold]] < i:
                gone[s:s + threshold] = b"\1" * threshold
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def components_of(docs: list[tuple[int | None, str | None]], width: int, num: int, den: int):
    """Per document (set size, least id reachable over links) by comparing all pairs."""
    import re
    sets = []
    for _, t in docs:
        w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append(frozenset(zip(*[w[i:] for i in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else []))
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                top[find(i)] = find(j)
    order = lambda i: (1 << 63) - 1 if i is None else i
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 1 << 64), order(d))
    return [(len(s), None if least[find(i)] == (1 << 63) - 1 else least[find(i)]) for i, s in enumerate(sets)]


LOWER = {c: c + 32 for c in range(65, 91)}
