"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed (96 bits); a window that
also stands earlier - in a document with a smaller id, or higher up in the
same document - is a repeat, and the lines that repeats cover are removed.

Defined cases: lines end at ``\\n``; a null text stays null and has no line;
texts of fewer than ``WIDTH`` lines have no window; a null id counts as
larger than every id; rows with one id are ordered by their text's hash;
fully equal rows (null ids with equal texts too) are the same document twice:
neither is a repeat of the other, and both get the same result. A text that
repeats one line is left with its first line.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barquet.llm.common import BYTE_CODE, RangeHash, in_arrow, mix64, of_cogroup, of_task, pick
from barquet.llm.firsts import CELLS, FOUND, KEYS, SPANS, Rows, buckets, cells, home, later, merged, names_of, read_cells, reduce_firsts, slices, with_bucket
from barquet.session import ship_package

WIDTH = 3
#: Bytes hashed at once (a longer text is hashed whole).
PIECE = 1 << 20


def line_windows(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """(document index, first line, hash, hash) of every window of ``width`` lines."""
    second = mix64(BYTE_CODE + np.uint64(0x2545F4914F6CDD1D))
    out = []
    a = 0
    while a + 1 < len(offsets):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        lo, hi = int(offsets[a]), int(offsets[b])
        part = data[lo:hi]
        inner = offsets[a:b + 1] - lo
        # ends of lines: line breaks, and the end of each document
        breaks = np.flatnonzero(part == 10)
        ends = np.concatenate([breaks, inner[1:]])
        doc = np.concatenate([np.searchsorted(inner, breaks, "right") - 1, np.arange(b - a)])
        order = np.lexsort((ends, doc))
        ends, doc = ends[order], doc[order]
        first_of_doc = np.ones(len(doc), bool)
        first_of_doc[1:] = doc[1:] != doc[:-1]
        starts = np.where(first_of_doc, inner[doc], np.concatenate([[0], ends[:-1] + 1]))
        at = np.flatnonzero(first_of_doc)
        number = np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc))))
        w = np.arange(len(doc) - width + 1) if len(doc) >= width else np.zeros(0, np.int64)
        w = w[doc[w] == doc[w + width - 1]]
        if len(w):
            h = [RangeHash(part)(starts[w], ends[w + width - 1]), RangeHash(part, second)(starts[w], ends[w + width - 1])]
            out.append((doc[w] + a, number[w], *h))
        a = b
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan(n: int, width: int):
    from barquet.llm.common import texts_of

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            kid, tag = names_of(batch)
            doc, number, h1, h2 = line_windows(*texts_of(batch, "text"), width)
            order, is_first, is_later = later(h1, h2, kid[doc], tag[doc], number, within=True)
            # a window that this batch holds before is a repeat for certain
            own = np.sort(order[is_later])
            yield from cells(n, FOUND, home(kid[doc[own]], tag[doc[own]], n), kid[doc[own]], tag[doc[own]], number[own], number[own] + width)
            f = np.sort(order[is_first])
            yield from cells(n, KEYS, (h1[f] % np.uint64(n)).astype(np.int64), h1[f], h2[f].astype(np.uint32), kid[doc[f]], tag[doc[f]], number[f])
    return run


def _cut(text_at: str, schema: pa.Schema, whole: bool, chars_at: str | None):
    """Remove the found lines; either digests or the rows themselves with their remaining text."""
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        batch = docs.combine_chunks().to_batches()[0]
        rows = Rows(batch)
        kid, tag, start, end = read_cells(found, FOUND, SPANS)
        row, start, end = merged(rows.find(kid, tag), start, end)
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        lines, removed, kept = [], [], []
        for i, (rep, text) in enumerate(zip(rows.representative(), batch.column("text").to_pylist())):
            own = text.split("\n") if text is not None else []
            a, b = cuts[rep], cuts[rep + 1]
            edges = [0, *np.stack([start[a:b], end[a:b]], 1).reshape(-1).tolist(), len(own)]
            left = [x for s, e in zip(edges[::2], edges[1::2]) for x in own[s:e]]
            lines.append(len(own))
            removed.append(len(own) - len(left))
            kept.append(None if text is None else text if len(left) == len(own) else "\n".join(left))
        if not whole:
            digest = [None if k is None else hashlib.sha256(k.encode()).hexdigest() for k in kept]
            return pa.Table.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], schema=schema)
        keep = pa.array([n == 0 or r < n for n, r in zip(lines, removed)], pa.bool_())
        columns = []
        for f in schema:
            if f.name == text_at:
                columns.append(pa.array(kept, f.type))
            elif f.name == chars_at:
                columns.append(pa.array([c if not r else len(k) for c, r, k in zip(batch.column(f.name).to_pylist(), removed, kept)], f.type))
            else:
                columns.append(batch.column(f.name).cast(f.type))
        return pa.Table.from_arrays(columns, schema=schema).filter(keep)
    return run


def _spans(own: DataFrame, n: int, width: int) -> DataFrame:
    keyed = in_arrow(own.select("doc_id", "text"), of_task(_scan(n, width)), CELLS)
    return reduce_firsts(keyed, n, width, within=True)


def dedup_counts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the SHA-256 of the remaining text (null for a null text)."""
    n = buckets(docs.sparkSession)
    ship_package(docs.sparkSession)
    own = with_bucket(pick(docs, "doc_id", "text"), n)
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return own.groupBy("bucket").cogroup(_spans(own, n, width).groupBy("bucket")).applyInArrow(
        of_cogroup(_cut("", schema, False, None)), "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of ``text``.

    ``n_chars``, where there is one, follows the text. A document that loses
    every line is dropped; one that was empty or null stays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    n = buckets(docs.sparkSession)
    ship_package(docs.sparkSession)
    names = docs.columns
    held = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    find = lambda x: f"_d{names.index(x) if x in names else [c.lower() for c in names].index(x)}"
    chars = find("n_chars") if "n_chars" in [c.lower() for c in names] else None
    own = with_bucket(held.withColumns({"doc_id": held[find("doc_id")], "text": held[find("text")]}), n)
    schema = to_arrow_schema(held.schema)
    cut = own.groupBy("bucket").cogroup(_spans(own, n, width).groupBy("bucket")).applyInArrow(of_cogroup(_cut(find("text"), schema, True, chars)), held.schema)
    return cut.toDF(*names)
