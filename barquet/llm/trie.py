"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

A conversation is the sequence of its turns' digests (16 bytes a turn, of role
and text), so sorting the digests as bytes puts shared prefixes side by side.
Conversations are range partitioned and sorted. In a partition

1. equal neighbours become one item, and every two neighbours an edge with the
   length of their common prefix;
2. the edges are taken in descending depth; all merges at one depth join the
   components' top nodes under a branching node of that depth, or under the
   item that ends there; stretches between branching nodes are unary chains;
3. nodes that hold neither the first nor the last item are complete, as
   members of a node are neighbours: they are emitted with their totals;
4. the others lie on two paths, from the root to the first and to the last
   item. The partition is contracted to these two items, each with what hangs
   off its path at every depth (members, closed children, leaves, savings).

The contracted items of all partitions are sorted and treated alike, in rounds
of at most ``MERGE`` items a task, until one task has all that is left. A
third of all conversations being equal makes many partitions of one item each
and no large group. The smallest member of a node that is complete only in a
later round is joined to its children by the digest of the prefix, salted, and
its members' ids are digested from one written list a partition, in order.

Defined cases: null roles and texts are empty; turns are ordered by turn, null
first, and then by digest; repeated rows are turns of their own; a null
conversation id is one conversation, which comes last and is written as
nothing; an empty table gives no nodes. The digests of one conversation (some
20 bytes a turn, whatever its texts) are held by one task.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import attach, in_arrow, partitions, pick, settle

WIDTH = 16
#: A null id, which sorts last.
LAST_ID = (1 << 63) - 1
#: Contracted items that one task takes in a round.
MERGE = 4096
#: Kinds of emitted rows.
NODE, ENDS, ITEM = 0, 1, 2

HANG = pa.struct([(x, pa.int64()) for x in ("depth", "n", "least", "kids", "leaves", "saved")])
EMITTED = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()),
                     ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
                     ("seq", pa.binary()), ("chars", pa.list_(pa.int32())), ("hang", pa.list_(HANG))])
EMITTED_SQL = ("kind int, key binary, conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
               "seq binary, chars array<int>, hang array<struct<depth: long, n: long, least: long, kids: long, leaves: long, saved: long>>")
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Rows that leave a task as one Arrow batch.
ROWS = 8192


class Sums:
    """What a node has, or what hangs off a path at one depth."""

    __slots__ = ("n", "least", "kids", "leaves", "saved")

    def __init__(self, n=0, least=LAST_ID, kids=0, leaves=0, saved=0):
        self.n, self.least, self.kids, self.leaves, self.saved = n, least, kids, leaves, saved

    def add(self, other: Sums, kids: int) -> None:
        self.n += other.n
        self.least = min(self.least, other.least)
        self.kids += kids
        self.leaves += other.leaves
        self.saved += other.saved


class Item:
    """A sequence, its turns' sizes, what hangs off its path by depth, and the ids of those that end with it (first round)."""

    __slots__ = ("seq", "chars", "hang", "ids")

    def __init__(self, seq: bytes, chars, hang: dict[int, Sums], ids: list[int] | None = None):
        self.seq, self.chars, self.hang, self.ids = seq, chars, hang, ids

    @property
    def length(self) -> int:
        return len(self.seq) // WIDTH


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """The compressed trie of sorted, distinct items; node i of the first ones is item i's."""

    def __init__(self, items: list[Item]):
        n = len(items)
        self.items = items
        self.depth = [x.length for x in items]
        self.low, self.high = list(range(n)), list(range(n))
        self.parent = [-1] * n
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.up, self.top = list(range(n)), list(range(n))
        edges = sorted(((common_turns(items[i - 1].seq, items[i].seq), i) for i in range(1, n)), key=lambda e: -e[0])
        for depth, group in groupby(edges, key=lambda e: e[0]):
            self._merge(depth, [i for _, i in group])
        self.hung: list[dict[int, Sums]] = [{} for _ in self.depth]
        for i, x in enumerate(items):
            v = i
            for d in sorted(x.hang, reverse=True):
                while self.above(v) >= d:
                    v = self.parent[v]
                self.hung[v].setdefault(d, Sums()).add(x.hang[d], x.hang[d].kids)

    def _find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def _merge(self, depth: int, edges: list[int]) -> None:
        """Join the components at the edges of one depth, each under one node of that depth."""
        tops: dict[int, list[int]] = {}
        for i in edges:
            a, b = self._find(i - 1), self._find(i)
            held = tops.pop(a, None) or [self.top[a]]
            held += tops.pop(b, None) or [self.top[b]]
            self.up[b] = a
            tops[a] = held
        for root, held in tops.items():
            ends = [v for v in held if self.depth[v] == depth]  # at most the one item that is the prefix itself
            v = ends[0] if ends else self._new(depth)
            below = [c for c in held if c != v]
            self.children[v] += below
            for c in below:
                self.parent[c] = v
            self.low[v], self.high[v] = min(self.low[c] for c in held), max(self.high[c] for c in held)
            self.top[root] = v

    def _new(self, depth: int) -> int:
        self.depth.append(depth)
        self.parent.append(-1)
        self.children.append([])
        self.low.append(0)
        self.high.append(0)
        return len(self.depth) - 1

    def above(self, v: int) -> int:
        """Depth of the parent node; the chain of ``v`` starts one below it."""
        return self.depth[self.parent[v]] if self.parent[v] >= 0 else -1

    def open(self, v: int) -> bool:
        """Whether neighbouring partitions may hold members of the node, too."""
        return self.low[v] == 0 or self.high[v] == len(self.items) - 1

    def prefix(self, v: int, depth: int) -> bytes:
        return self.items[self.low[v]].seq[:depth * WIDTH]

    def _below(self, v: int, depth: int, child: dict[int, list[Sums]], open_too: bool) -> Sums:
        """What hangs at (v, depth) and, where branches start, the children (closed ones, or all)."""
        s = Sums()
        if (x := self.hung[v].get(depth)) is not None:
            s.add(x, x.kids)
        if depth == self.depth[v]:
            for c in self.children[v]:
                if open_too or not self.open(c):
                    s.add(child[c][-1], 1)
        return s

    def totals(self, last: bool) -> dict[int, list[Sums]]:
        """For every complete node of the compressed trie, the sums along its chain, deepest first."""
        out: dict[int, list[Sums]] = {}
        for v in sorted(range(len(self.depth)), key=lambda v: -self.depth[v]):
            if not last and self.open(v):
                continue
            chars, chain = self.items[self.low[v]].chars, []
            for d in range(self.depth[v], self.above(v), -1):
                s = self._below(v, d, out, True)
                if chain:
                    s.add(chain[-1], 1)
                s.leaves = s.leaves or 1  # no child has none
                s.saved += (s.n - 1) * chars[d - 1] if d else 0
                chain.append(s)
            out[v] = chain
        return out

    def contracted(self, totals: dict[int, list[Sums]]) -> list[Item]:
        """The first and the last item with all that hangs off their paths."""
        out = []
        for i in dict.fromkeys((0, len(self.items) - 1)):
            hang, v = {}, i
            while v >= 0 and (i == 0 or self.low[v] > 0):
                for d in range(self.depth[v], self.above(v), -1):
                    s = self._below(v, d, totals, False)
                    if s.n:
                        hang[d] = s
                v = self.parent[v]
            out.append(Item(self.items[i].seq, self.items[i].chars, hang))
        return out


def key_of(prefix: bytes) -> bytes:
    return hashlib.md5(prefix).digest()


def _ids_text(ids: list[int]) -> str:
    return ",".join("" if i == LAST_ID else str(i) for i in ids)


def emitted(items: list[Item], last: bool, keyed: bool):
    """All rows that one partition's sorted items give. ``last``: nothing lies outside; ``keyed``: nodes carry their prefix's key."""
    forest = Forest(items)
    totals = forest.totals(last)
    for v, chain in totals.items():
        p = forest.parent[v]
        for k, s in enumerate(chain):
            d = forest.depth[v] - k
            parent = chain[k + 1].least if k + 1 < len(chain) else totals[p][0].least if p in totals else None
            ids = items[v].ids if k == 0 and v < len(items) else None
            yield {"kind": NODE, "key": key_of(forest.prefix(v, d)) if keyed else None, "conv_id": s.least, "depth": d, "parent_conv_id": parent,
                   "parent_key": key_of(forest.prefix(v, d - 1)) if d and parent is None else None, "n_convs": s.n, "n_children": s.kids, "n_leaves": s.leaves,
                   "saved_tokens": s.saved, "ends": None if keyed else hashlib.sha256(_ids_text(ids).encode()).hexdigest() if ids else NO_ENDS}
    for v in range(len(items)):
        if items[v].ids and v not in totals:
            yield {"kind": ENDS, "key": key_of(items[v].seq), "conv_id": items[v].ids[0], "ends": _ids_text(items[v].ids)}
    if not last:
        for x in forest.contracted(totals):
            yield {"kind": ITEM, "seq": x.seq, "chars": x.chars, "hang": [{"depth": d, "n": s.n, "least": s.least, "kids": s.kids, "leaves": s.leaves, "saved": s.saved} for d, s in x.hang.items()]}


def _batched(rows):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, EMITTED)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, EMITTED)


def _first_round(sequences: DataFrame, n: int) -> DataFrame:
    order = F.col("seq").asc(), F.col("conv_id").asc()

    def run(batches):
        items: list[Item] = []
        for batch in batches:
            for conv_id, seq, chars in zip(batch.column("conv_id").to_pylist(), batch.column("seq").to_pylist(), batch.column("chars").to_pylist()):
                if items and items[-1].seq == seq:
                    items[-1].ids.append(conv_id)
                else:
                    items.append(Item(seq, chars, {}, [conv_id]))
        for x in items:
            x.hang[x.length] = Sums(len(x.ids), x.ids[0])
        if items:
            yield from _batched(emitted(items, False, False))
    return in_arrow(sequences.repartitionByRange(n, *order).sortWithinPartitions(*order), run, EMITTED_SQL)


def _later_round(items: DataFrame, n: int) -> DataFrame:
    order = F.col("seq").asc(), F.col("least").asc()  # equal sequences are dealt apart

    def run(batches):
        held: list[Item] = []
        for batch in batches:
            for seq, chars, hang in zip(batch.column("seq").to_pylist(), batch.column("chars").to_pylist(), batch.column("hang").to_pylist()):
                if not held or held[-1].seq != seq:
                    held.append(Item(seq, chars, {}))
                for h in hang:
                    held[-1].hang.setdefault(h["depth"], Sums()).add(Sums(h["n"], h["least"], 0, h["leaves"], h["saved"]), h["kids"])
        if held:
            yield from _batched(emitted(held, n == 1, True))
    own = items.select("seq", "chars", "hang", F.array_min("hang.least").alias("least"))
    dealt = own.repartition(1) if n == 1 else own.repartitionByRange(n, *order)
    return in_arrow(dealt.sortWithinPartitions(*order), run, EMITTED_SQL)


def _digests(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256) from written lists of ids, read as a stream in ascending order."""
    ordered = pieces.select("key", "conv_id", "ends").repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("key", "conv_id")

    def run(batches):
        now, state = None, None
        for batch in batches:
            keys, out = [], []
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        out.append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                state.update(ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "digest"])
    return in_arrow(ordered, run, "key binary, digest string")


def turn_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest hex, chars) of (conv_id, turn, role, text) rows; roles and texts travel no further."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    one = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return pick(rows, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(one.cast("binary")).alias("digest"), F.length(text).cast("int").alias("chars"))


def _ordered(turns: DataFrame) -> DataFrame:
    """A row a conversation: its (turn, digest, chars) in order."""
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))


def _sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id with nulls last, seq, chars) of rows (conv_id, turns)."""
    return conversations.select(F.coalesce("conv_id", F.lit(LAST_ID)).alias("conv_id"),
                                F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("seq"),
                                F.transform("turns", lambda t: t["chars"]).alias("chars"))


def sequences(rows: DataFrame) -> DataFrame:
    """Conversations as they are, from (conv_id, turn, role, text) rows."""
    return _sequences(_ordered(turn_digests(rows)))


def with_shared_heads(rows: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of their group's first conversation, h = crc32(id) % heads.

    Conversation c's head comes from c - c % group (``%`` as in SQL); all its
    turns if it has fewer, none if it is absent; c's own turns after its
    first h follow. Heads are at most heads - 1 turns, and at most ``group``
    conversations share one, so the join has no hot key.
    """
    turns = turn_digests(rows)
    first = _ordered(turns.filter(F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = _ordered(turns).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    h = (F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % heads).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return _sequences(own.join(first, "base", "left").select("conv_id", F.concat(head, rest).alias("turns")))


def prefix_trie(conversations: DataFrame, merge: int = MERGE) -> DataFrame:
    """Every node of the trie of rows (conv_id, seq, chars), as :func:`sequences` gives them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. ``merge`` is 4 or more.
    """
    spark = conversations.sparkSession
    rounds = [settle(_first_round(settle(conversations, "trie"), partitions(spark)), "trie")]
    while True:
        items = rounds[-1].filter(F.col("kind") == ITEM)
        n = -(-items.count() // merge)
        rounds.append(settle(_later_round(items, max(1, n)), "trie"))
        if n <= 1:
            break
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_key"]
    late = rounds[1]
    for r in rounds[2:]:
        late = late.unionByName(r)
    late = late.filter(F.col("kind") == NODE)
    digests = _digests(rounds[0].filter(F.col("kind") == ENDS))
    ended = late.join(digests, "key", "left").select(*columns, F.coalesce("digest", F.lit(NO_ENDS)).alias("ends_sha256"))
    closed = rounds[0].filter(F.col("kind") == NODE).select(*columns, F.col("ends").alias("ends_sha256"))
    up = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("late_parent"))
    nodes = attach(closed.unionByName(ended), up, "parent_key")
    shown = lambda c: F.when(c != LAST_ID, c)
    return nodes.select(shown(F.col("conv_id")).alias("conv_id"), "depth", shown(F.coalesce("parent_conv_id", "late_parent")).alias("parent_conv_id"),
                        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
