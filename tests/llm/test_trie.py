import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from barquet.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, TEXT_ string, Conv_ID string"


def conversations(rows):
    """Sequences of (role, text) by conversation; ties on turn go by the digest, as documented."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        out[c].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [x[-1] for x in sorted(v)] for c, v in out.items()}


def rebuilt(rows):
    own = conversations(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 6
        base = None if c is None else c - int(abs(c) % 100 * (1 if c >= 0 else -1))
        out[c] = (own.get(base, []) if base is not None else [])[:h] + turns[h:]
    return out


def plain(sequences):
    """All prefixes of all sequences."""
    key = lambda c: (c is None, c or 0)
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sorted(sequences.items(), key=lambda x: key(x[0])):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own
    text = lambda ids: ",".join("" if i is None else str(i) for i in ids)
    return sorted(str((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(text(ends[p]).encode()).hexdigest())) for p, m in members.items())


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


def odd(seed, n=260):
    rng = random.Random(seed)
    texts = ["", None, "a", "b", "cc", "dédé", "🙂", "long " * 2000]
    rows = [(None, 0, "user", "a"), (None, None, None, None), (-150, 0, "user", "a"), (-7, 0, "user", "b"), (-7, 1, "assistant", "b")]
    for c in range(n):
        c = rng.choice([c, c, c + 100, c * 7])
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    same = [(0, "user", "hello"), (1, "assistant", "hi"), (2, "user", "bye")]
    rows += [(5000 + i, *t) for i in range(n) for t in same]
    rows += [(9000 + i, t, "user", f"x{t % 3}") for i in range(2) for t in range(700)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_trie_equals_all_prefixes(spark, seed):
    rows = odd(seed)
    got = trie.prefix_trie(trie.with_shared_heads(frame(spark, rows))).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rebuilt(rows))


@pytest.mark.parametrize("parts,merge", [(40, 4), (7, 5), (1, 4096)])
def test_partitions_and_rounds_do_not_matter(spark, parts, merge):
    rows = odd(3, 90)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = trie.prefix_trie(trie.sequences(frame(spark, rows)), merge=merge).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(str(tuple(r)) for r in got) == plain(conversations(rows))


def test_forest_of_one_partition():
    turn = lambda x: bytes([x]) * trie.WIDTH
    seqs = sorted({b"".join(map(turn, s)) for s in [(), (1,), (1, 2, 3), (1, 2, 4), (1, 2, 4, 5), (2,), (2, 2, 2)]})
    forest = trie.Forest([trie.Item(s, [1] * 9, {len(s) // trie.WIDTH: trie.Sums(1, i)}) for i, s in enumerate(seqs)])
    branching = [d for v, d in enumerate(forest.depth) if v >= len(seqs)]
    assert branching == [2]  # the others are prefixes that stand as items of their own
    totals = forest.totals(True)
    root = forest.top[forest._find(0)]
    assert totals[root][-1].n == len(seqs) and totals[root][-1].leaves == 3


def test_common_turns():
    a, b = b"".join(bytes([i % 251]) * 16 for i in range(1000)), b"".join(bytes([i % 251]) * 16 for i in range(777)) + b"\xff" * 32
    assert trie.common_turns(a, b) == 777 and trie.common_turns(a, a) == 1000 and trie.common_turns(a, b"") == 0


def test_empty_and_single(spark):
    assert trie.prefix_trie(trie.with_shared_heads(frame(spark, []))).collect() == []
    one = trie.prefix_trie(trie.with_shared_heads(frame(spark, [(None, None, None, None)]))).collect()
    assert sorted(r["depth"] for r in one) == [0, 1] and all(r["conv_id"] is None and r["n_convs"] == 1 for r in one)
