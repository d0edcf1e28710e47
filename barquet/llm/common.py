"""Small helpers that the operators share: column picking, written intermediates, hashes, salted joins."""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.session import ship_package, work_dir

#: A side is broadcast only after its rows were counted and are no more than this.
BROADCAST_ROWS = 20_000
SALTS = 48


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else ``df`` holds.

    An exactly equal name wins over one that differs in case, so extra
    columns with clashing names neither break nor change the result.
    """
    held = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])

    def at(name: str) -> int:
        if name in df.columns:
            return df.columns.index(name)
        loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if len(loose) != 1:
            raise ValueError(f"column {name!r} not found once in {df.columns}")
        return loose[0]

    return held.select(*[held[f"_c{at(n)}"].alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark (4.1 on) removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, *parts: str, free: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared work folder and read back: lineage ends there.

    ``free``: the shuffle files that led to it go at once, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = work_dir(spark, "llm", *parts)
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def of_task(fn):
    """``fn`` of a task's batches, for mapInArrow."""
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()
    return run


def give_back() -> None:
    """Return freed memory to the machine: Python workers live on after a task, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def of_group(fn):
    """``fn`` of a group's table, for applyInArrow."""
    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            give_back()
    return run


def of_cogroup(fn):
    """``fn`` of two tables of a group, for applyInArrow."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return fn(left, right)
        finally:
            give_back()
    return run


def attach(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a table with one row a key, by a key that may hold a third of ``left``.

    ``right`` is counted first: within ``BROADCAST_ROWS`` rows it is
    broadcast; beyond, its rows are repeated ``SALTS`` times and ``left`` is
    dealt by (key, salt), so no key lands in one task. Null keys match
    nothing.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = [F.xxhash64(*[c for c in left.columns if dict(left.dtypes)[c] not in ("string", "binary")] or [key])]
    spread = left.withColumn("_salt", F.pmod(rest[0], F.lit(SALTS)).cast("int"))
    return spread.join(salted, [key, "_salt"], how).drop("_salt")


# ---- 64-bit hashes in numpy -------------------------------------------------

#: Odd multiplier of the positional hash, and its inverse modulo 2**64.
MULT = 0x9E3779B97F4A7C15
MULT_INV = pow(MULT, -1, 1 << 64)
BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class RangeHash:
    """Hashes of any byte ranges of one buffer from prefix sums (64-bit positional polynomial).

    ``code[b] * MULT**-i`` is summed once over the buffer; the hash of
    [a, b) is the difference of two sums times ``MULT**a``, so equal bytes
    hash alike wherever they stand.
    """

    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, code: np.ndarray = BYTE_CODE):
        n = len(data)
        up, down = self._table(n + 1)
        self.up = up
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code[data] * down[:n], out=self.sums[1:])

    @classmethod
    def _table(cls, n: int):
        if len(cls._powers[0]) < n:
            size = max(n, 1 << 16)
            ones = np.full(size, MULT, np.uint64), np.full(size, MULT_INV, np.uint64)
            for x in ones:
                x[0] = 1
            cls._powers = np.cumprod(ones[0]), np.cumprod(ones[1])
        return cls._powers

    def __call__(self, start, end) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.up[start])


# ---- packed arrays inside binary cells --------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Equal-length arrays as one compressed cell; byte planes are kept apart, which compresses counts and ids well."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T).tobytes() for a in arrays]
    raw = b"".join(planes)
    return n.to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(cell: bytes, *dtypes) -> list[np.ndarray]:
    n, size = int.from_bytes(cell[:4], "little"), int.from_bytes(cell[4:12], "little")
    raw = np.frombuffer(pa.decompress(cell[12:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t in dtypes:
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * w].reshape(w, n).T).reshape(-1).view(t))
        at += n * w
    return out


def unpack_all(cells, *dtypes) -> list[np.ndarray]:
    parts = [unpack(c, *dtypes) for c in cells]
    if not parts:
        return [np.zeros(0, t) for t in dtypes]
    return [np.concatenate(x) for x in zip(*parts)]


def texts_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; nulls are empty."""
    col = batch.column(name)
    if pa.types.is_string_view(col.type):
        col = col.cast(pa.large_string())
    col = col.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def crc_bucket(column: str, n: int):
    """crc32 of the column as text, modulo ``n`` (null counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))
