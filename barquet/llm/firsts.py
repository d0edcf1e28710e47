"""First occurrences of keys across all documents, exchanged as packed arrays.

Tasks combine their own occurrences first: a key is sent once a task (its
first occurrence there), later ones are known at once. Rows of the exchange
are binary cells of many packed records, dealt by a bucket of the key; so a
key that stands in a third of all documents sends one record a task, and no
task ever holds the occurrences of a key one by one.

A sender makes at most ``FAN`` cells of a kind. With more buckets than that,
records go to their bucket digit by digit (:func:`routed`): ``hops`` stages of
about the root of the buckets each, so cells grow as buckets times that root,
and never beyond the records.

A document is named by (kid, tag): its id, nulls last, and 63 bits of its
text's hashes, which tells rows with a repeated id apart. Its home is a bucket
by the hash of both, so neither null ids nor ids of one stride meet in one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import of_group, pack, partitions, texts_of, unpack, unpack_all
from barquet.session import ship_package

LAST_ID = (1 << 63) - 1
CELLS = "bucket int, kind int, cell binary"
#: Record layouts.
KEYED = (np.uint64, np.uint32, np.int64, np.int64, np.int64)  # key (96 bits), kid, tag, position
SPANS = (np.int64, np.int64, np.int64, np.int64)  # kid, tag, start, end
#: Cell kinds.
KEYS, FOUND = 0, 1


#: Cells of one kind that a sender makes at most; and what the kind of a cell under way is raised by, times the stages behind it.
FAN, HOP = 256, 100


def buckets(spark) -> int:
    """Two buckets a partition, as hashing buckets to partitions is uneven."""
    return 2 * partitions(spark)


def hops(n: int, fan: int | None = None) -> int:
    """Stages in which a record reaches one of n buckets, with ``fan`` cells a sender at most (FAN if not given)."""
    k = 1
    while (fan or FAN) ** k < n:
        k += 1
    return k


def radix(n: int, fan: int | None = None) -> int:
    """Least number whose power ``hops(n)`` is n or more."""
    k, r = hops(n, fan), 1
    while r ** k < n:
        r += 1
    return r


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5  # fixed values of XXH64


def _xxh64(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of eight bytes, as SQL's xxhash64 has it for a long."""
    u = lambda v: np.uint64(v & (1 << 64) - 1)
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = seed + u(_P5 + 8)
        h = h ^ turn(x.astype(np.uint64) * u(_P2), 31) * u(_P1)
        h = turn(h, 27) * u(_P1) + u(_P4)
        h = (h ^ h >> np.uint64(33)) * u(_P2)
        h = (h ^ h >> np.uint64(29)) * u(_P3)
        return h ^ h >> np.uint64(32)


def home(kid: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    return _xxh64(np.asarray(tag), _xxh64(np.asarray(kid), np.uint64(42))).view(np.int64) % n


def home_column(kid, tag, n: int):
    """:func:`home` as a column."""
    return F.pmod(F.xxhash64(kid, tag), F.lit(n)).cast("int")


def with_bucket(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (with doc_id and text) and the bucket in which its results are gathered."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = F.shiftleft(F.crc32(text.cast("binary")), 31).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)))
    return docs.withColumn("bucket", home_column(F.coalesce("doc_id", F.lit(LAST_ID)), tag, n))


def repeated_ids(docs: DataFrame) -> bool:
    """Whether any id (or null) stands in two rows: only then do names need a tag besides the id."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())


def names_of(batch, ids: str = "doc_id", text: str = "text", tags: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(kid, tag) of every row; without ``tags`` all tags are 0, which pack to nothing."""
    kid = batch.column(ids).fill_null(LAST_ID).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else \
        batch.column(ids).combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    if not tags:
        return kid.astype(np.int64), np.zeros(len(kid), np.int64)
    raw = ((t or "").encode("utf-8", "replace") for t in batch.column(text).to_pylist())
    return kid.astype(np.int64), np.fromiter((zlib.crc32(t) << 31 | xxhash.xxh64_intdigest(t, 42) & (1 << 31) - 1 for t in raw), np.int64, len(kid))


#: Bytes of text combined at once: bounds a task's memory whatever the batch.
SLICE = 16 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE):
    """The batch in runs of rows with about ``size`` bytes of text each (a longer text is alone)."""
    _, offsets = texts_of(batch, "text")
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _cells(kind: int, bucket: np.ndarray, arrays, head: bytes = b""):
    """Record batches with one cell for each bucket that occurs; records keep their order within a bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
    arrays = [a[order] for a in arrays]
    yield pa.RecordBatch.from_arrays(
        [pa.array(b[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, kind, np.int32)),
         pa.array([head + pack(*[a[s:e] for a in arrays]) for s, e in zip(cuts, cuts[1:])], pa.binary())], ["bucket", "kind", "cell"])


def _dealt(n: int, kind: int, target: np.ndarray, arrays, done: int, fan: int | None = None):
    """Cells whose address has one digit of the target more than the ``done`` ones; on the way the sender's own number fills the rest."""
    k, r = hops(n, fan), radix(n, fan)
    if done + 1 == k:
        yield from _cells(kind, target, arrays)
        return
    rest = r ** (k - done - 1)
    lane = (TaskContext.get().partitionId() if TaskContext.get() else 0) % rest
    head = bytes([len(arrays), *(a.dtype.itemsize for a in arrays)])
    yield from _cells(kind + HOP * (done + 1), target // rest * rest + lane, [np.asarray(target).astype(np.uint32), *arrays], head)


def cells(n: int, kind: int, bucket: np.ndarray, *arrays: np.ndarray, fan: int | None = None):
    """The records on their way to their buckets, of which there are n. Read them behind :func:`routed` with the same ``fan``."""
    yield from _dealt(n, kind, bucket, arrays, 0, fan)


def routed(dealt: DataFrame, n: int, fan: int | None = None) -> DataFrame:
    """Cells at their buckets: the stages that are left for :func:`cells` of n buckets."""
    def stage(done: int):
        def run(table: pa.Table) -> pa.Table:
            kinds, given = np.array(table.column("kind").to_pylist()), table.column("cell").to_pylist()
            out = []
            for kind in np.unique(kinds[kinds >= HOP]):
                parts = []
                for i in np.flatnonzero(kinds == kind):
                    widths = given[i][1:1 + given[i][0]]
                    parts.append(unpack(given[i][1 + given[i][0]:], np.uint32, *[f"V{w}" for w in widths]))
                target, *arrays = (np.concatenate(x) for x in zip(*parts))
                out += _dealt(n, int(kind) % HOP, target.astype(np.int64), arrays, done, fan)
            return joined(out, table, *range(HOP))
        return run
    for done in range(1, hops(n, fan)):
        dealt = dealt.groupBy("bucket").applyInArrow(of_group(stage(done)), CELLS)
    return dealt


def read_cells(table, kind: int, layout) -> list[np.ndarray]:
    kinds = table.column("kind").to_pylist()
    return unpack_all([c for k, c in zip(kinds, table.column("cell").to_pylist()) if k == kind], *layout)


def joined(out: list, table: pa.Table, *passed: int) -> pa.Table:
    """New cells, and the cells of the given kinds as they came."""
    kinds = np.array(table.column("kind").to_pylist())
    rest = table.select(["bucket", "kind", "cell"]).filter(pa.array(np.isin(kinds, passed)))
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("cell", pa.binary())])
    return pa.concat_tables([pa.Table.from_batches(out, schema), rest.cast(schema)])


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Start index of the run of equal keys that each sorted row is in."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def later(h1, h2, kid, tag, pos, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, is_first, is_later): rows by key, kid, tag, position, which is the first of its key, and which have an earlier occurrence of it.

    ``within``: earlier positions of the same document count; else only
    documents with a smaller id do. Equal rows have one name, so what has the
    first one's kid, tag and position is that same occurrence: neither first
    nor later.
    """
    order = np.lexsort((pos, tag, kid, h2, h1))
    first = runs(h1[order], h2[order])
    is_first = first == np.arange(len(order))
    k, t, p = kid[order], tag[order], pos[order]
    if within:
        return order, is_first, (k != k[first]) | (t != t[first]) | (p != p[first])
    return order, is_first, k > k[first]


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of half-open spans of each row; touching spans become one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # spans of different rows are moved apart so that one running maximum serves all
    shift = row.astype(np.int64) * (int(max(end.max(), 1)) + 2) if len(row) else row
    s, e = start + shift, np.maximum.accumulate(end + shift)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(s) - 1]])
    return row[at], start[at], e[last] - shift[at]


def reduce_firsts(exchanged: DataFrame, n: int, length: int, within: bool, fan: int | None = None) -> DataFrame:
    """Cells of keyed records -> cells of spans [position, position + length) of later occurrences, by document bucket."""
    ship_package(exchanged.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        h1, h2, kid, tag, pos = read_cells(table, KEYS, KEYED)
        order, _, is_later = later(h1, h2, kid, tag, pos, within)
        own = order[is_later]
        own = own[np.lexsort((pos[own], tag[own], kid[own]))]
        out = list(cells(n, FOUND, home(kid[own], tag[own], n), kid[own], tag[own], pos[own], pos[own] + length, fan=fan))
        return joined(out, table, FOUND)

    return routed(routed(exchanged, n, fan).groupBy("bucket").applyInArrow(of_group(run), CELLS), n, fan)


class Rows:
    """Rows of a document table by (kid, tag)."""

    def __init__(self, table=None, names=None):
        self.kid, self.tag = names_of(table) if names is None else names
        self.first: dict = {}
        for i, name in enumerate(zip(self.kid.tolist(), self.tag.tolist())):
            self.first.setdefault(name, i)

    def find(self, kid: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The first row of each name (equal rows share it); quick where names come in runs."""
        if not len(kid):
            return np.zeros(0, np.int64)
        new = np.ones(len(kid), bool)
        new[1:] = (kid[1:] != kid[:-1]) | (tag[1:] != tag[:-1])
        at = np.flatnonzero(new)
        rows = [self.first[x] for x in zip(kid[at].tolist(), tag[at].tolist())]
        return np.repeat(np.array(rows, np.int64), np.diff(np.append(at, len(kid))))

    def representative(self) -> np.ndarray:
        """For each row, the row that results of its name are found under."""
        return self.find(self.kid, self.tag)


def doc_cells(docs: DataFrame, n: int, tags: bool = True) -> DataFrame:
    """Whole texts as packed cells by home bucket: (doc_id, text) rows move and wait compressed."""
    def run(batches):
        for batch in batches:
            kid, tag = names_of(batch, tags=tags)
            null = np.array([x is None for x in batch.column("doc_id").to_pylist()], np.uint8)
            data, offsets = texts_of(batch, "text")
            size, bucket = np.diff(offsets), home(kid, tag, n)
            order = np.argsort(bucket, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else [0]
            for a, b in zip(cuts, cuts[1:]):
                own = order[a:b]
                body = b"".join(data[offsets[i]:offsets[i + 1]].tobytes() for i in own)
                head = pack(kid[own], tag[own], null[own], size[own])
                cell = len(head).to_bytes(8, "little") + head + pa.Codec("zstd", 3).compress(body, asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([bucket[own[0]]], pa.int32()), pa.array([len(body)], pa.int64()), pa.array([cell], pa.large_binary()).cast(pa.binary())],
                                                 ["bucket", "size", "cell"])
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, size long, cell binary")


class PackedRows(Rows):
    """The documents of a bucket from their cells: names, bytes and offsets."""

    def __init__(self, table: pa.Table):
        heads, bodies = [], []
        for cell, size in zip(table.column("cell").to_pylist(), table.column("size").to_pylist()):
            h = int.from_bytes(cell[:8], "little")
            heads.append(unpack(cell[8:8 + h], np.int64, np.int64, np.uint8, np.int64))
            bodies.append(pa.decompress(cell[8 + h:], decompressed_size=size, codec="zstd", asbytes=True))
        kid, tag, self.null, sizes = (np.concatenate(x) for x in zip(*heads)) if heads else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint8, np.int64))
        super().__init__(names=(kid, tag))
        self.data = np.frombuffer(b"".join(bodies), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
