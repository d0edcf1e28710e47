"""SentencePiece encoding and decoding over a table of distinct marked words.

A text is marked as the model does it (a marker in front, a marker for every
space) and cut before each marker that follows another character. No piece of
such a model holds a marker behind another character, so no merge crosses a
cut and a word's ids do not depend on its neighbours: each distinct word is
segmented once, and ids are put back by position.

Stages:

1. A task cuts its texts in slices of some 16 MB, numbers the distinct words
   of a slice and sends them, packed, to the bucket of each word's hash.
2. A bucket holds the table of its distinct words: the model segments each
   once, whatever the number of slices that ask, and the ids go back to the
   slices. A word of any frequency is one entry a slice, so none is hot.
3. A slice meets its word numbers (one a position) and its ids: every
   document's ids are gathered by position and decoded.

Both uses of stage 1 read ``docs`` anew, so it must give the same rows in the
same order each time, as a stored table does; a DataFrame that is computed
with a shuffle is to be written first (:func:`barquet.llm.common.settle`). The
key of a slice holds a checksum of its words, so a slice that changed between
the reads finds no table and raises.

Whether a model cuts texts this way is read from its pieces and from how it
normalises a probe; for any other model a whole text is one word, which is
exact for every model.

Defined cases: a null text is empty; an empty text has no ids and decodes to
the empty text; ids, nulls and repeats of ``doc_id`` do not matter, every row
has its row; a text without spaces is one word, however long; a slice holds
at least one text whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import pack, partitions, pick, texts_of, tokenizer_path, unpack
from barquet.session import ship_package

MODEL = "piece_bpe_32k.model"
MARK = "▁"
SLICE = 16 << 20
#: A word with the markers behind its first one; the first word of a text needs no space before it.
_WORD = re.compile(r"(?:\A| )( *[^ ]*)")
_PROBE = "Ａﬁ ①  é\t　x "
_models: dict = {}

CELLS = "slice string, bucket int, cell binary"


class Model:
    """A SentencePiece model and what its pieces allow."""

    def __init__(self, path: str):
        import sentencepiece
        self.it = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.it.id_to_piece(i) for i in range(self.it.get_piece_size())]
        self.mark_id = self.it.piece_to_id(MARK)
        self.by_word = (self.it.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK) and self.it.id_to_piece(self.mark_id) == MARK
                        and not any(re.search(f"[^{MARK}]{MARK}", p) for p in names))

    @classmethod
    def at(cls, path: str) -> Model:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All words of all texts in order, each without its first marker, and how many every text has."""
        if not self.by_word:
            return pa.array([t for t in texts if t], pa.large_string()), np.array([bool(t) for t in texts], np.int64)
        plain = pc.replace_substring(pa.array(texts, pa.large_string()), MARK, " ")
        split = pc.split_pattern(plain, " ")
        counts = np.diff(split.offsets.to_numpy())
        words = split.flatten()
        if pc.any(pc.equal(pc.binary_length(words), 0)).as_py():  # empty texts, or several spaces together
            lists = [_WORD.findall(t) if t else [] for t in plain.to_pylist()]
            return pa.array([w for x in lists for w in x], pa.large_string()), np.array([len(x) for x in lists], np.int64)
        return words, counts.astype(np.int64)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids a word)."""
        ids = self.it.encode(words, num_threads=1)
        if self.by_word:
            ids = [x if w else [self.mark_id] for x, w in zip(ids, words)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())), sizes


def _checksum(words: pa.Array) -> int:
    data, crc = words.cast(pa.large_binary()), 0
    for x in (data.buffers()[1], data.buffers()[2]):
        crc = zlib.crc32(x or b"", crc)
    return crc


def _slices(batches, model: Model, texts: str = "text"):
    """(slice key, rows of the slice, distinct words, word number of every position, words a text)."""
    task, k = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for batch in batches:
        _, offsets = texts_of(batch, texts)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
            part = batch.slice(a, b - a)
            words, counts = model.cut([t or "" for t in part.column(texts).to_pylist()])
            coded = words.dictionary_encode()
            yield f"{task}.{k}.{_checksum(coded.dictionary):x}", part, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32), counts
            a, k = b, k + 1


def _hash_order(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word, order of the words by bucket); stable, so both uses of a slice agree."""
    import pandas as pd
    bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def _texts_cell(words: pa.Array) -> bytes:
    raw = words.cast(pa.large_binary())
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    body = b"".join(raw.to_pylist())
    head = pack(sizes.astype(np.uint32 if len(body) < 1 << 32 else np.int64))
    wide = int(len(body) >= 1 << 32)
    return bytes([wide]) + len(head).to_bytes(8, "little") + head + len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _cell_texts(cell: bytes) -> list[bytes]:
    wide, h = cell[0], int.from_bytes(cell[1:9], "little")
    sizes = unpack(cell[9:9 + h], np.int64 if wide else np.uint32)[0].astype(np.int64)
    n = int.from_bytes(cell[9 + h:17 + h], "little")
    body = pa.decompress(cell[17 + h:], decompressed_size=n, codec="zstd", asbytes=True)
    ends = np.cumsum(sizes)
    return [body[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


def _word_cells(own: DataFrame, path: str, n: int) -> DataFrame:
    """Stage 1 for the table: a cell of distinct words for each slice and bucket that has some."""
    def run(batches):
        for key, _, words, _, _ in _slices(batches, Model.at(path)):
            bucket, order = _hash_order(words, n)
            if not len(order):
                continue
            ordered, b = words.take(pa.array(order)), bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
            for s, e in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([b[s]], pa.int32()), pa.array([_texts_cell(ordered.slice(s, e - s))], pa.binary())],
                                                 ["slice", "bucket", "cell"])
    return own.mapInArrow(run, CELLS)


def _segmented(cells: DataFrame, path: str) -> DataFrame:
    """Stage 2: each bucket's distinct words, segmented once, and the ids of each asking cell's words in its order."""
    def run(table: pa.Table) -> pa.Table:
        lists = [_cell_texts(c) for c in table.column("cell").to_pylist()]
        number: dict[bytes, int] = {}
        asked = [np.fromiter((number.setdefault(w, len(number)) for w in x), np.int64, len(x)) for x in lists]
        ids, sizes = Model.at(path).segment([w.decode() for w in number])
        ends = np.cumsum(sizes)
        out = []
        for x in asked:
            head = pack(sizes[x].astype(np.uint32))
            body = pack(ids[_spread(ends[x] - sizes[x], sizes[x])])
            out.append(len(head).to_bytes(8, "little") + head + body)
        return pa.table({"slice": table.column("slice").combine_chunks(), "bucket": table.column("bucket").combine_chunks(), "cell": pa.array(out, pa.binary())})
    return cells.groupBy("bucket").applyInArrow(run, CELLS)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _positions(own: DataFrame, path: str, n: int) -> DataFrame:
    """Stage 1 for the documents: a cell a slice with ids, words a text, and the word number of every position in the table's order."""
    def run(batches):
        for key, part, words, codes, counts in _slices(batches, Model.at(path)):
            _, order = _hash_order(words, n)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            null = np.array([x is None for x in part.column("doc_id").to_pylist()], np.uint8)
            ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            head, body = pack(ids, null, counts), pack(place[codes])
            cell = len(words).to_bytes(8, "little") + len(head).to_bytes(8, "little") + head + body
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([cell], pa.binary())], ["slice", "cell"])
    return own.mapInArrow(run, "slice string, cell binary")


#: Texts whose ids and decoded text leave a task as one Arrow batch.
ROWS = 2048


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded): each text's ids, without begin or end ids, and what they decode to.

    ``docs`` has doc_id and text; ``model`` is the path of a SentencePiece
    model on the executors.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path, n = model or tokenizer_path(MODEL), partitions(spark)
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = _segmented(_word_cells(own, path, n), path)

    def run(place: pa.Table, words: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        cells = sorted(zip(words.column("bucket").to_pylist(), words.column("cell").to_pylist()))
        sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for _, c in cells:
            h = int.from_bytes(c[:8], "little")
            sizes += unpack(c[8:8 + h], np.uint32)
            ids += unpack(c[8 + h:], np.int32)
        sizes, ids = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
        starts = np.cumsum(sizes) - sizes
        out = []
        for cell in place.column("cell").to_pylist():
            asked, h = int.from_bytes(cell[:8], "little"), int.from_bytes(cell[8:16], "little")
            if asked != len(sizes):
                raise RuntimeError("the documents changed between the two reads: write them first (settle)")
            doc, null, counts = unpack(cell[16:16 + h], np.int64, np.uint8, np.int64)
            codes = unpack(cell[16 + h:], np.uint32)[0]
            ends = np.cumsum(counts)
            for a in range(0, len(doc), ROWS):
                b = min(len(doc), a + ROWS)
                first = int(ends[a] - counts[a])
                own = codes[first:int(ends[b - 1])]
                flat = ids[_spread(starts[own], sizes[own])]
                upto = np.concatenate([[0], np.cumsum(sizes[own])])[ends[a:b] - first]
                offsets = np.concatenate([[0], upto]).astype(np.int32)
                decoded = Model.at(path).it.decode([flat[s:e].tolist() for s, e in zip(offsets, offsets[1:])])
                out.append(pa.table([pa.array(doc[a:b], mask=null[a:b].astype(bool)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())],
                                    schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return _positions(own, path, n).groupBy("slice").cogroup(table.groupBy("slice")).applyInArrow(run, "doc_id long, ids array<int>, decoded string")


def chunk_table(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The table itself: every distinct word of ``docs`` (with its markers) and its ids, a row a word."""
    spark = docs.sparkSession
    ship_package(spark)
    path = model or tokenizer_path(MODEL)
    cells = _word_cells(pick(docs, "doc_id", "text"), path, partitions(spark))

    def run(table: pa.Table) -> pa.Table:
        words = [w.decode() for w in dict.fromkeys(w for c in table.column("cell").to_pylist() for w in _cell_texts(c))]
        it = Model.at(path)
        ids, sizes = it.segment(words)
        marked = [MARK + w.replace(" ", MARK) if it.by_word else w for w in words]
        return pa.table([pa.array(marked, pa.string()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))], names=["word", "ids"])
    return cells.groupBy("bucket").applyInArrow(run, "word string, ids array<int>")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what :func:`encode` gives."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
