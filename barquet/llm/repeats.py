"""Removal of byte strings that an earlier document holds: a depth-limited radix sort of suffixes.

Two texts share a repeat when suffixes of theirs agree through ``THRESHOLD``
bytes. Suffixes are ordered no deeper than that, most significant digit first:

1. The first digit is the rarest-hashing ``DIGIT``-byte substring of a
   window (its minimizer), which depends on the window's bytes alone; all
   windows around one minimizer occurrence share it, so about one record per
   16 bytes of text is dealt out instead of one per byte.
2. Within a digit, occurrences whose whole reach (every window around the
   minimizer) is equal need no further ordering: all but those of the
   smallest id are repeats, whole. A digit with one distinct reach is done.
3. The second digit lengthens the first by half of what a window has more,
   to the left and to the right: a window holds one of the two, so an
   occurrence goes on only if another document shares either, and only its
   windows of that side.
4. Windows of the few that are left are sorted by their bytes, eight at a
   time, most significant digit first, dropping groups of one after each
   pass; groups that are still together after the last pass are exactly the
   repeated windows. First windows of each task's groups meet by 96-bit
   digests of all their bytes.

Equal occurrences of a task are combined before each exchange, so a passage
that a third of all documents share costs a record a task.

Defined cases: a null text is empty; texts under ``THRESHOLD`` bytes have no
window; a null id counts as larger than every id; rows with one id are no
earlier than each other; a document's own repeats stay. Equality of reaches
and of groups across tasks is that of 88- and 96-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import BYTE_CODE, RangeHash, in_arrow, mix64, of_cogroup, of_group, of_task, pick, settle, texts_of
from barquet.llm.firsts import (CELLS, FOUND, KEYS, SPANS, PackedRows, buckets, cells, doc_cells, home, hops, joined, merged, names_of, read_cells, reduce_firsts, repeated_ids,
                                routed, runs, slices)
from barquet.session import ship_package

THRESHOLD, DIGIT = 50, 20
#: Bytes of text for each pair of buckets from which on records go straight to their buckets: with some 60 records
#: a cell, cells don't outweigh the records, and each further stage of routing would write all of them once more.
DIRECT = 1024
CHUNK = 1 << 18  # windows handled at once: arrays of this length stay in cache
#: Record layout of minimizer occurrences: digit (40 bits), reach (48 bits), kid, tag, position.
DIGITS = (np.uint32, np.uint8, np.uint32, np.uint16, np.int64, np.int64, np.uint32)
#: kid, tag, position, what (a reach that is a repeat, or one whose windows are to be sorted).
REACHES = (np.int64, np.int64, np.int64, np.uint8)
#: Second digit, kid, tag, position, side.
SECOND = (np.uint64, np.int64, np.int64, np.uint32, np.uint8)
COVERED, PROBE = 0, 1
#: What another document shares: the digit lengthened to the left, to the right.
LEFT, RIGHT = 1, 2
#: Cell kind of reaches.
REACHED = 2
#: The reach of a record that only says that its digit has several reaches in a task.
SEVERAL = (1 << 48) - 1


def sliding(values: np.ndarray, width: int, fn) -> np.ndarray:
    """fn (minimum or maximum) over every run of ``width`` values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = fn(out[:-have], out[have:])
        have *= 2
    return fn(out[:len(values) - width + 1], out[width - have:width - have + len(values) - width + 1]) if have < width else out


def minimizers(data: np.ndarray, offsets: np.ndarray, threshold: int = THRESHOLD, digit: int = DIGIT):
    """(position, document index, digit hash, reach hash) of each selected substring.

    Every window of ``threshold`` bytes inside a document holds a selected
    position, chosen by the window's bytes alone (all positions with the
    least hash). The reach of a position is the bytes from
    ``threshold - digit`` before it to ``threshold`` after it, cut at the
    document's ends.
    """
    width = threshold - digit + 1
    begin, end = int(offsets[0]), int(offsets[-1])
    parts = []
    for a in range(begin, max(begin, end - threshold + 1), CHUNK):
        b = min(a + CHUNK, end - threshold + 1)  # windows start in [a, b)
        lo, hi = max(begin, a - threshold), min(end, b + 2 * threshold)
        h = RangeHash(data[lo:hi])
        at = np.arange(a - lo, b + width - 1 - lo)
        grams = h(at, at + digit) | np.uint64(1)
        least = sliding(grams, width, np.minimum)  # of windows a .. b - 1
        starts = np.arange(a, b)
        doc = np.searchsorted(offsets, starts, "right") - 1
        least[starts + threshold > offsets[doc + 1]] = 0  # crosses a document's end
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(sliding(padded, width, np.maximum) == grams)
        p = chosen + a
        d = np.searchsorted(offsets, p, "right") - 1
        left = np.maximum(p - (threshold - digit), offsets[d])
        right = np.minimum(p + threshold, offsets[d + 1])
        reach = mix64(h(left - lo, right - lo) + ((p - left) * 128 + (right - p)).astype(np.uint64))
        parts.append((p, d, grams[chosen], reach))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    p, d, g, r = (np.concatenate(x) for x in zip(*parts))
    keep = np.ones(len(p), bool)  # a position near a chunk's edge can be chosen on both sides
    order = np.argsort(p, kind="stable")
    keep[1:] = p[order][1:] != p[order][:-1]
    order = order[keep]
    return p[order], d[order], g[order] >> np.uint64(24), r[order] >> np.uint64(16)


def classes(digit, reach, kid):
    """Order by (digit, reach, kid); for each sorted row: is it a repeat of a smaller id, and has its digit other reaches of another id."""
    order = np.lexsort((kid, reach, digit))
    d, r, k = digit[order], reach[order], kid[order]
    first = runs(d, r)
    repeat = k > k[first]
    group = runs(d)
    starts = np.unique(group)
    low, high = np.minimum.reduceat(r, starts) if len(r) else r, np.maximum.reduceat(r, starts) if len(r) else r
    klow, khigh = np.minimum.reduceat(k, starts) if len(k) else k, np.maximum.reduceat(k, starts) if len(k) else k
    which = np.searchsorted(starts, group)
    mixed = ((low != high) & (klow != khigh))[which] if len(r) else np.zeros(0, bool)
    return order, repeat, mixed, group


def _scan(n: int, fan: int | None, threshold: int, digit: int, tags: bool):
    """First digits of a task's texts, combined; reaches already known to be repeats or to need sorting go home at once."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            kid, tag = names_of(batch, tags=tags)
            data, offsets = texts_of(batch, "text")
            p, d, g, r = minimizers(data, offsets, threshold, digit)
            pos = p - offsets[d]
            order, repeat, mixed, group = classes(g, r, kid[d])
            known = repeat | mixed
            own = order[known]
            what = np.where(repeat[known], COVERED, PROBE).astype(np.uint8)
            by = np.lexsort((pos[own], d[own]))
            own, what = own[by], what[by]
            yield from cells(n, REACHED, home(kid[d[own]], tag[d[own]], n), kid[d[own]], tag[d[own]], pos[own], what, fan=fan)
            # one record for a digit with several reaches here, every other first occurrence as it is
            lone = np.sort(order[~known])
            several = order[np.unique(group[mixed])] if mixed.any() else np.zeros(0, np.int64)
            send = np.concatenate([lone, several])
            reach = np.concatenate([r[lone], np.full(len(several), SEVERAL, np.uint64)])
            gs, ks, ts = g[send], kid[d[send]], tag[d[send]]
            ks[len(lone):] = -1 << 63  # other than every document
            yield from cells(n, KEYS, (gs % np.uint64(n)).astype(np.int64), (gs & np.uint64(0xFFFFFFFF)).astype(np.uint32), (gs >> np.uint64(32)).astype(np.uint8),
                             (reach & np.uint64(0xFFFFFFFF)).astype(np.uint32), (reach >> np.uint64(32)).astype(np.uint16),
                             ks, ts, pos[send].astype(np.uint32), fan=fan)
    return run


def _by_digit(n: int, fan: int | None):
    """All tasks' records of a digit: repeats of a smaller id's reach, and first occurrences whose digit has other reaches."""
    def run(table: pa.Table) -> pa.Table:
        g0, g1, r0, r1, kid, tag, pos = read_cells(table, KEYS, DIGITS)
        g = g0.astype(np.uint64) | (g1.astype(np.uint64) << np.uint64(32))
        r = r0.astype(np.uint64) | (r1.astype(np.uint64) << np.uint64(32))
        order, repeat, mixed, _ = classes(g, r, kid)
        known = (repeat | mixed) & (r[order] != SEVERAL)
        own = order[known]
        what = np.where(repeat[known], COVERED, PROBE).astype(np.uint8)
        by = np.lexsort((pos[own], tag[own], kid[own]))
        own, what = own[by], what[by]
        out = list(cells(n, REACHED, home(kid[own], tag[own], n), kid[own], tag[own], pos[own].astype(np.int64), what, fan=fan))
        return joined(out, table, REACHED)
    return run


def equal_windows(data: np.ndarray, starts: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Group number of each window, -1 for windows that equal no other.

    Depth-limited radix sort, most significant digit first: each pass orders
    the windows of a group by their next eight bytes and splits it; groups of
    one drop out.
    """
    group = np.full(len(starts), -1)
    live, own = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(data, 8) if len(data) >= 8 else None
    for depth in range(0, threshold, 8):
        if not len(live):
            return group
        # the last digit may overlap the one before it
        at = starts[live] + min(depth, threshold - 8)
        digit = np.ascontiguousarray(view[at]).view(">u8").reshape(-1)
        order = np.lexsort((digit, own))
        first = runs(own[order], digit[order])
        size = np.bincount(first, minlength=len(first))[first]
        stay = size > 1
        live, own = live[order[stay]], first[stay]
    group[live] = own
    return group


def _second_code() -> np.ndarray:
    return mix64(BYTE_CODE + np.uint64(0x5851F42D4C957F2D))


def _placed(docs: pa.Table, found: pa.Table):
    """The documents of a bucket, and the found positions with the rows they are in."""
    rows = PackedRows(docs)
    kid, tag, pos, what = read_cells(found, REACHED, REACHES)
    return rows, rows.data, rows.offsets, rows.find(kid, tag), pos, what


def range_hashes(data, offsets, row, start, end, code=BYTE_CODE) -> np.ndarray:
    """Hashes of byte ranges of documents; ``row`` need not be sorted."""
    out = np.zeros(len(row), np.uint64)
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(len(offsets)))
    for i in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[i]:cuts[i + 1]]
        out[own] = RangeHash(data[offsets[i]:offsets[i + 1]], code)(start[own], end[own])
    return out


def _lengthen(n: int, fan: int | None, threshold: int, digit: int):
    """Whole repeats become spans; for undecided reaches, their two second digits go out."""
    more = -(-(threshold - digit) // 2)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows or REACHED not in found.column("kind").to_pylist():
            return joined([], found)
        rows, data, offsets, row, pos, what = _placed(docs, found)
        size = offsets[row + 1] - offsets[row]
        cover = what == COVERED
        r, s, e = merged(row[cover], np.maximum(pos - (threshold - digit), 0)[cover], np.minimum(pos + threshold, size)[cover])
        out = list(cells(n, FOUND, home(rows.kid[r], rows.tag[r], n), rows.kid[r], rows.tag[r], s, e, fan=fan))
        keys = []
        for side, (a, b) in ((LEFT, (pos - more, pos + digit)), (RIGHT, (pos, pos + digit + more))):
            ok = np.flatnonzero(~cover & (a >= 0) & (b <= size))
            keys.append((range_hashes(data, offsets, row[ok], a[ok], b[ok]) ^ np.uint64(side), row[ok], pos[ok], np.full(len(ok), side, np.uint8)))
        key, r, p, side = (np.concatenate(x) for x in zip(*keys))
        key, k, t = mix64(key), rows.kid[r], rows.tag[r]
        order, _, mixed, group = classes(key, k.astype(np.uint64), k)
        alive = order[mixed]
        alive = alive[np.lexsort((p[alive], r[alive]))]
        out += cells(n, REACHED, home(k[alive], t[alive], n), k[alive], t[alive], p[alive], side[alive], fan=fan)
        lone = np.sort(order[~mixed])
        several = order[np.unique(group[mixed])] if mixed.any() else np.zeros(0, np.int64)
        send = np.concatenate([lone, several])
        k = k[send]
        k[len(lone):] = -1 << 63  # other than every document
        out += cells(n, KEYS, (key[send] % np.uint64(n)).astype(np.int64), key[send], k, t[send], p[send].astype(np.uint32), side[send], fan=fan)
        return joined(out, found, FOUND)
    return run


def _by_key(n: int, fan: int | None):
    """Occurrences whose second digit another document has, too."""
    def run(table: pa.Table) -> pa.Table:
        key, kid, tag, pos, side = read_cells(table, KEYS, SECOND)
        order, _, mixed, _ = classes(key, kid.astype(np.uint64), kid)
        own = order[mixed & (kid[order] != -1 << 63)]
        own = own[np.lexsort((pos[own], tag[own], kid[own]))]
        out = list(cells(n, REACHED, home(kid[own], tag[own], n), kid[own], tag[own], pos[own].astype(np.int64), side[own], fan=fan))
        return joined(out, table, FOUND, REACHED)
    return run


def _windows(n: int, fan: int | None, threshold: int, digit: int):
    """Sort the windows around what is left: a task's own repeats are found by bytes, its first windows go out by digest."""
    code = mix64(BYTE_CODE + np.uint64(0x5851F42D4C957F2D))

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows or REACHED not in found.column("kind").to_pylist():
            return joined([], found, FOUND)
        rows, data, offsets, row, pos, what = _placed(docs, found)
        # both sides of an occurrence together
        order = np.lexsort((pos, row))
        row, pos, what = row[order], pos[order], what[order]
        first = np.flatnonzero(np.arange(len(row)) == runs(row, pos))
        what = np.bitwise_or.reduceat(what, first)
        row, pos = row[first], pos[first]
        span, more = threshold - digit, -(-(threshold - digit) // 2)
        starts = np.arange(-span, 1)  # of windows, from the position
        holds = np.where(starts <= -more, LEFT, 0) | np.where(starts >= more - span, RIGHT, 0)
        r, c = np.nonzero((holds[None, :] & ~what[:, None]) == 0)
        s = pos[r] + starts[c]
        ok = (s >= 0) & (s + threshold <= (offsets[row + 1] - offsets[row])[r])
        at = (offsets[row][r] + s)[ok]
        at = np.unique(at)
        r = np.searchsorted(offsets, at, "right") - 1
        s = at - offsets[r]
        group = equal_windows(data, at, threshold)
        # of a group of equal windows, those with the smallest id are firsts
        k = rows.kid[r]
        order = np.lexsort((k, group))
        first = runs(group[order])
        repeat = np.zeros(len(r), bool)
        repeat[order] = (k[order] > k[order][first]) & (group[order] >= 0)
        out = []
        row, start, end = merged(r[repeat], s[repeat], s[repeat] + threshold)
        out += cells(n, FOUND, home(rows.kid[row], rows.tag[row], n), rows.kid[row], rows.tag[row], start, end, fan=fan)
        f = np.flatnonzero(~repeat)
        h1 = range_hashes(data, offsets, r[f], s[f], s[f] + threshold)
        h2 = range_hashes(data, offsets, r[f], s[f], s[f] + threshold, code)
        out += cells(n, KEYS, (h1 % np.uint64(n)).astype(np.int64), h1, h2.astype(np.uint32), rows.kid[r[f]], rows.tag[r[f]], s[f], fan=fan)
        return joined(out, found, FOUND)
    return run


def _cut(texts: bool):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                            *([("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))] if texts else [])])
        if not docs.num_rows:
            return schema.empty_table()
        rows = PackedRows(docs)
        data, offsets = rows.data, rows.offsets
        kid, tag, start, end = read_cells(found, FOUND, SPANS)
        row, start, end = merged(rows.find(kid, tag), start, end)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        out = []
        for i, rep in enumerate(rows.representative()):
            text = data[offsets[i]:offsets[i + 1]].tobytes()
            a, b = cuts[rep], cuts[rep + 1]
            edges = [0, *np.stack([start[a:b], end[a:b]], 1).reshape(-1).tolist(), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            out.append((len(text), len(text) - len(kept), int(b - a), hashlib.sha256(kept).hexdigest(), kept, list(map(list, zip(start[a:b].tolist(), end[a:b].tolist())))))
        columns = [list(x) for x in zip(*out)][:len(schema) - 1]
        return pa.Table.from_arrays([pa.array(rows.kid, mask=rows.null.astype(bool)), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)
    return run


def fan_of(docs: DataFrame, n: int) -> int | None:
    """Cells of a kind that a sender makes at most: one for each of the n buckets if the texts fill them, else the default."""
    if hops(n) == 1:
        return None
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return n if size >= DIRECT * n * n else None


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, with ``texts``, the kept bytes and removed spans).

    A byte is removed when a ``threshold``-byte string that covers it also
    starts in a document with a smaller id.
    """
    if threshold - digit < 1 or threshold < 8 or threshold > 120:
        raise ValueError("digit < threshold, 8 <= threshold <= 120")
    spark = docs.sparkSession
    ship_package(spark)
    n = buckets(spark)
    plain = pick(docs, "doc_id", "text")
    tags = repeated_ids(plain)
    # Each step is written before the next begins: its shuffle files go then, and the packed texts, computed
    # again where they are needed, are on disk only with one step's records.
    fan, own = fan_of(plain, n), doc_cells(plain, n, tags).groupBy("bucket")
    digits = routed(in_arrow(plain, of_task(_scan(n, fan, threshold, digit, tags)), CELLS), n, fan)
    reaches = routed(settle(digits.groupBy("bucket").applyInArrow(of_group(_by_digit(n, fan)), CELLS), "repeats", free=True), n, fan)
    longer = routed(own.cogroup(reaches.groupBy("bucket")).applyInArrow(of_cogroup(_lengthen(n, fan, threshold, digit)), CELLS), n, fan)
    alive = routed(settle(longer.groupBy("bucket").applyInArrow(of_group(_by_key(n, fan)), CELLS), "repeats", free=True), n, fan)
    windows = own.cogroup(alive.groupBy("bucket")).applyInArrow(of_cogroup(_windows(n, fan, threshold, digit)), CELLS)
    spans = settle(reduce_firsts(windows, n, threshold, within=False, fan=fan), "repeats", free=True)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<array<bigint>>" if texts else "")
    return own.cogroup(spans.groupBy("bucket")).applyInArrow(of_cogroup(_cut(texts)), kind)
