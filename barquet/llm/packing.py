"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

1. Tasks tokenise whole documents and cut those longer than the capacity.
2. Best fit works on the histogram of piece lengths, which has at most
   ``capacity`` entries however many documents there are: equal lengths are
   placed together, and a segment tree over the remaining capacities 0..C
   finds the tightest open bin in logarithmic time. The outcome is that of
   placing the pieces one by one in decreasing length; it is written as rules
   (a range of ranks within a length -> a range of bins and an offset). Their
   number depends on the capacity alone (at most about C**2 / 2 rules).
3. Pieces get their rank within their length from counts per (length, hash
   bucket), so a length that holds a third of all pieces is ranked in many
   tasks; each rank looks its place up in the rules.

Defined cases: a null text is an empty document (its end token alone); equal
rows, and rows with equal ids, are separate documents; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.llm.common import give_back, in_arrow, of_task, partitions, pick, settle, tokenizer_path

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Tokens of this many distinct chunks are remembered in a worker before it starts anew.
CHUNK_CACHE = 250_000


class _Numbers(dict):
    """Numbers new keys in order and remembers which are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class ChunkTokenizer:
    """Byte-level BPE ids of a text from remembered ids of its space-separated chunks.

    The vocabulary is read from a ``tokenizers`` file; its merges are in order
    of id, so the ids serve as merge ranks. The splitting pattern always
    starts a new token at a single space between two characters that are not
    white space, so such chunks can be encoded apart. A text with other white
    space next to a space is encoded whole. Strings of special tokens are
    ordinary text.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        of = {chr(b): b for b in printable}
        of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(of[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in self.added}
        self.encoding = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, i in ranks.items():
            self.bytes_of[i] = len(k)
        self.reset()

    def reset(self) -> None:
        self.known = _Numbers()
        self.ids, self.start, self.count, self.loose = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += [self._plain(text[at:m.start()]), np.array([self.added[m[0]]], "<u4")]
            at = m.end()
        return np.concatenate([*parts, self._plain(text[at:])]) if parts else self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def _learn(self) -> None:
        """Encode all new chunks in one call; a chunk's first token starts where its bytes start."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        loose = np.zeros(len(new), bool)
        ids, counts = [np.zeros(0, "<u4")] * len(new), np.zeros(len(new), np.int64)
        joined = []
        for i, w in enumerate(new):
            if w[:1] == "\0":  # first of its text: no space before it
                loose[i] = w[-1:].isspace()
                ids[i] = self.encode(w[1:])
                counts[i] = len(ids[i])
            elif not w or w[0].isspace() or w[-1].isspace():
                loose[i] = True
            else:
                joined.append(i)
        sizes = np.array([len(new[i].encode()) + 1 for i in joined], np.int64)
        flat = self.encode("".join([" " + new[i] for i in joined]))
        ends = np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum(sizes)) + 1
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        counts[joined] = ends - starts
        first = np.zeros(len(new), np.int64)
        base = len(self.ids)
        first[joined] = base + starts
        own = np.ones(len(new), bool)
        own[joined] = False
        at = base + len(flat)
        own = np.flatnonzero(own)
        first[own] = at + np.concatenate([[0], np.cumsum(counts[own])])[:len(own)]
        self.ids = np.concatenate([self.ids, flat, *[ids[i] for i in own]])
        self.start, self.count, self.loose = np.concatenate([self.start, first]), np.concatenate([self.count, counts]), np.concatenate([self.loose, loose])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CHUNK_CACHE:
            self.reset()
        number, rows = self.known.__getitem__, []
        for t in texts:
            if "\0" in t or self.cut.search(t):
                rows.append(None)
                continue
            words = t.split(" ")
            words[0] = "\0" + words[0]
            rows.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._learn()
        out = []
        for t, row in zip(texts, rows):
            if row is None or self.loose[row].any():
                out.append(self.encode(t))
                continue
            n = self.count[row]
            ends = np.cumsum(n)
            out.append(self.ids[np.repeat(self.start[row] - ends + n, n) + np.arange(ends[-1])])
        return out


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
        give_back()  # what reading the vocabulary took
    return _TOKENIZERS[path]


def groups_of(texts: list, most: int = 2_000_000):
    """Slices of the list with about ``most`` characters each (a longer text is alone)."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= most):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    tail = np.array([end_id], "<u4")

    def run(batches):
        tok = chunk_tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("doc_id").to_pylist()
            for a, b in groups_of(texts):
                rows = defaultdict(list)
                for key, ids in zip(keys[a:b], tok(texts[a:b])):
                    n = len(ids) + 1
                    ids = np.concatenate([ids, tail])
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        rows["doc_id"].append(key)
                        rows["piece"].append(i)
                        rows["start"].append(s)
                        rows["length"].append(e - s)
                        rows["ids_crc32"].append(zlib.crc32(ids[s:e]))
                        if with_ids:
                            rows["ids"].append(ids[s:e].tolist())
                kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                kinds += [("ids", pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in kinds], [n for n, _ in kinds])
    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ``ids``).

    Only documents longer than ``capacity`` are cut; then the first piece may
    be shorter and all others are full.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    return in_arrow(pick(docs, "doc_id", "text"), of_task(_tokenise(path, capacity, end_id, with_ids)),
                    PIECES + (", ids array<int>" if with_ids else ""))


class CapacityTree:
    """Segment tree over remaining capacities: how many open bins have each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.size
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity >= ``need`` that an open bin has."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_rules(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """Place ``lengths[l]`` pieces of each length l, longest first, into the tightest open bins.

    Returns, per length, rows (first rank, first bin, offset, pieces a bin)
    by rising first rank, and the number of bins. A bin that still fits the
    same length after a placement is again the tightest, so a bin takes
    ``remaining // l`` equal pieces before the next bin is asked.
    """
    tree, held = CapacityTree(capacity), defaultdict(list)
    rules: dict[int, list] = defaultdict(list)
    bins = 0

    def put(remaining: int, first: int, count: int) -> None:
        if count and remaining > 0:
            held[remaining].append((first, count))
            tree.add(remaining, count)

    for l in sorted(lengths, reverse=True):
        left, rank = lengths[l], 0
        while left:
            r = tree.tightest(l)
            if r is None:
                each = capacity // l
                r, first, count = capacity, bins, -(-left // each)
                bins += count
            else:
                each = r // l
                first, count = held[r].pop()
                tree.add(r, -count)
                used = min(count, -(-left // each))
                put(r, first + used, count - used)
                count = used
            took = min(left, count * each)
            rules[l].append((rank, first, capacity - r, each))
            full = took // each
            put(r - each * l, first, full)
            if took % each:
                put(r - (took % each) * l, first + full, 1)
            rank += took
            left -= took
    return {l: np.array(x, np.int64) for l, x in rules.items()}, bins


def _place(rules: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for l in np.unique(length):
                own, rule = length == l, rules[int(l)]
                r = rule[np.searchsorted(rule[:, 0], rank[own], "right") - 1]
                q = rank[own] - r[:, 0]
                seq[own] = r[:, 1] + q // r[:, 3]
                off[own] = r[:, 2] + q % r[:, 3] * l
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])
    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (see :func:`token_pieces`) with sequence_id and offset; each sequence is gapless from 0."""
    spark = pieces.sparkSession
    cut = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    rules, _ = best_fit_rules(by_length, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (cut.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank")))
    return in_arrow(ranked, of_task(_place(rules)), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Best-fit packing of ``docs`` (doc_id, text): a row a piece with its sequence and offset.

    The pieces, small rows without ids, are written once to the shared work
    folder: they are read for the histogram and again for the ranks.
    """
    return pack_pieces(settle(token_pieces(docs, path, capacity, end_id), "packing"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token ids of each packed sequence: sequence_id, ids, doc_ids (a sequence holds at most ``capacity`` tokens)."""
    ids = token_pieces(docs, path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids")
    # rows with equal ids and equal pieces are interchangeable: one copy of their ids serves all
    ids = ids.groupBy("doc_id", "piece", "ids_crc32").agg(F.first("ids").alias("ids"))
    same = (packed["doc_id"].eqNullSafe(ids["doc_id"]) & (packed["piece"] == ids["piece"]) & (packed["ids_crc32"] == ids["ids_crc32"]))
    rows = packed.join(ids, same).select(packed["sequence_id"], packed["offset"], packed["doc_id"], ids["ids"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (rows.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids")))
