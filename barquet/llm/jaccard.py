"""Similarity join of documents by the Jaccard index of their word shingles, and the groups that its links form.

Prefix filtering: under one order of all shingles, rarest first, two sets that
reach the threshold share a shingle among the first few of each, and their
first shared one stands early enough in both (length and positional filter).

1. Document frequencies of shingles are counted over all documents into a
   table of fixed size; (frequency, hash) is the order. Equal sets of a task
   are joined to their first document at once.
2. Each distinct set of a task posts its prefix shingles, as packed records
   dealt by shingle. A shingle frequent enough to overfill a task is posted
   to a grid of blocks, so that every pair of blocks meets in a cell of its
   own.
3. Of a shingle's documents, the one that has it earliest (the one with
   fewest rarer shingles) is tested against each other document; linked
   documents are one component and need no test among themselves. Only pairs
   of different components that still pass the filters are then tested. So a
   large group of near copies costs a test a document, and no link between
   different groups is lost.
4. A test sends the one set to the other's home bucket, once a bucket,
   compares histograms of hash ranges first (suffix filter: a lower bound of
   the Hamming distance) and then the sets. Each pair is tested once.

Components follow by least labels with pointer jumping over the links.

Defined cases: words are maximal runs without ASCII white space, A-Z in lower
case; a text with fewer words than the width has its whole sequence as one
shingle; without words or text the set is empty and linked with nothing; a
null id counts as larger than every id (as component null); rows with one id
are documents of their own. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import RangeHash, in_arrow, mix64, of_cogroup, of_group, of_task, pack, pick, settle, texts_of, unpack
from barquet.llm.firsts import CELLS, HOP, LAST_ID, Rows, buckets, cells, home, home_column, joined, names_of, read_cells, routed, runs, slices, with_bucket
from barquet.session import ship_package

WIDTH, THRESHOLD = 5, (8, 10)
#: Entries of the frequency table (a fixed size, whatever the input).
FREQUENCIES = 1 << 22
#: Documents of one shingle in one cell, about.
SPLIT = 20_000
PIECE = 1 << 20
#: Bytes of text whose shingles a task holds at once.
SLICE = 4 << 20
POSTING = (np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.uint8)  # key, kid, tag, set size, position, side
LABELLED = POSTING + (np.int64, np.int64)
DOCUMENT = (np.int64, np.int64, np.uint32, np.uint8)  # kid, tag, set size, whether the id is null
PAIR = (np.int64, np.int64, np.int64, np.int64)  # the set that travels, the set that stays
#: Cell kinds.
POSTS, DOCS, COPIES, PAIRS = 0, 1, 2, 3


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash) of every distinct shingle, by document and hash."""
    docs, hashes = [], []
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 3) & ((1 << 64) - 1)) for i in range(width)]
    a = 0
    while a + 1 < len(offsets):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        lo, hi = int(offsets[a]), int(offsets[b])
        part = data[lo:hi]
        inner = offsets[a:b + 1] - lo
        a0, a = a, b
        if not len(part):
            continue
        low = part | (((part >= 65) & (part <= 90)).astype(np.uint8) << 5)
        gap = (part == 32) | ((part >= 9) & (part <= 13))
        starts_word = ~gap
        starts_word[1:] &= gap[:-1]
        inside = inner[:-1][inner[:-1] < len(part)]
        starts_word[inside] = ~gap[inside]
        start = np.flatnonzero(starts_word)
        stops = np.zeros(len(part) + 1, bool)
        stops[:-1] = gap
        stops[inner] = True  # a document's end ends a word
        ends = np.flatnonzero(stops)
        end = ends[np.searchsorted(ends, start, "right")]
        doc = np.searchsorted(inner, start, "right") - 1
        word = RangeHash(low)(start, end)
        n = np.bincount(doc, minlength=b - a0)
        full = np.arange(len(word) - width + 1) if len(word) >= width else np.zeros(0, np.int64)
        full = full[doc[full] == doc[full + width - 1]]
        if len(full):
            h = np.zeros(len(full), np.uint64)
            for i in range(width):
                h = mix64(h * odd[i] + word[full + i])
            docs.append(doc[full] + a0)
            hashes.append(h)
        first = np.concatenate([[0], np.cumsum(n)])
        for d in np.flatnonzero((n > 0) & (n < width)):  # the whole sequence as one
            h = np.uint64(n[d])
            for w in word[first[d]:first[d + 1]]:
                h = mix64(np.array([h * odd[0] + w], np.uint64))[0]
            docs.append(np.array([d + a0]))
            hashes.append(np.array([h], np.uint64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]


def frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """Document frequency of every shingle's table entry, over all documents, on a scale of eighths of a power of two."""
    chunk = 1 << 18

    def run(batches):
        total = np.zeros(FREQUENCIES, np.uint32)
        seen = False
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            _, h = shingle_sets(*texts_of(batch, "text"), width)
            seen |= bool(len(h))
            for a in range(0, len(h), 1 << 22):
                np.add.at(total, (h[a:a + (1 << 22)] & np.uint64(FREQUENCIES - 1)).astype(np.int64), 1)
        if seen:
            for c in range(0, FREQUENCIES, chunk):
                yield pa.RecordBatch.from_arrays([pa.array([c // chunk], pa.int32()), pa.array([0], pa.int32()), pa.array([pack(total[c:c + chunk])], pa.binary())],
                                                 ["bucket", "kind", "cell"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.uint64)
        for cell in table.column("cell").to_pylist():
            total += unpack(cell, np.uint32)[0]
        level = np.minimum(255, np.ceil(8 * np.log2(total.astype(float) + 1))).astype(np.uint8)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "kind": table.column("kind").slice(0, 1), "cell": pa.array([pack(level)], pa.binary())})

    rows = in_arrow(docs, of_task(run), CELLS).groupBy("bucket").applyInArrow(of_group(add), CELLS).collect()  # FREQUENCIES bytes in all
    out = np.zeros(FREQUENCIES, np.uint8)
    for bucket, _, cell in rows:
        out[bucket * chunk:(bucket + 1) * chunk] = unpack(bytes(cell), np.uint8)[0]
    return out


def need(nx, ny, t) -> np.ndarray:
    """Least size of the intersection of two sets that reach the threshold."""
    num, den = t
    return -(-(num * (nx + ny)) // (num + den))


def _post(n: int, width: int, t, split: int, handle):
    num, den = t

    def run(batches):
        level = handle.value
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            kid, tag = names_of(batch)
            null = np.array([x is None for x in batch.column("doc_id").to_pylist()], np.uint8)
            d, h = shingle_sets(*texts_of(batch, "text"), width)
            size = np.bincount(d, minlength=len(kid))
            yield from cells(n, DOCS, home(kid, tag, n), kid, tag, size.astype(np.uint32), null)
            if not len(d):
                continue
            # equal sets of this batch: the smallest name posts, the others link to it
            first = np.concatenate([[0], np.cumsum(size)])
            total = np.concatenate([[np.uint64(0)], np.cumsum(h)])
            other = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(0xA0761D6478BD642F)))])
            have = np.flatnonzero(size)
            s1, s2 = total[first[have + 1]] - total[first[have]], other[first[have + 1]] - other[first[have]]
            order = np.lexsort((tag[have], kid[have], s2, s1))
            top = have[order][runs(s1[order], s2[order])]
            mine = have[order]
            twin = (top != mine) & ((kid[top] != kid[mine]) | (tag[top] != tag[mine]))
            c, r = mine[twin], top[twin]
            yield from cells(1, COPIES, np.zeros(len(c), np.int64), kid[c], tag[c], kid[r], tag[r])
            posts = np.zeros(len(kid), bool)
            posts[mine[top == mine]] = True
            sel = posts[d]
            d, h = d[sel], h[sel]
            freq = level[(h & np.uint64(FREQUENCIES - 1)).astype(np.int64)]
            order = np.lexsort((h, freq, d))
            d, h, freq = d[order], h[order], freq[order]
            pos = np.arange(len(d)) - runs(d)
            prefix = size[d] - -(-(num * size[d]) // den) + 1
            keep = pos < prefix
            d, h, freq, pos = d[keep], h[keep], freq[keep], pos[keep]
            key, side = h, np.full(len(h), 2, np.uint8)
            hot = 2.0 ** (freq / 8.0) > split
            if hot.any():  # cells (i, j) of a grid of blocks: a document of block b goes to all cells of row and column b
                parts = [(d[~hot], h[~hot], pos[~hot], side[~hot])]
                m = np.ceil(2.0 ** (freq[hot] / 8.0) / split).astype(np.int64)
                block = (mix64(kid[d[hot]].astype(np.uint64) + tag[d[hot]].astype(np.uint64)) % m.astype(np.uint64)).astype(np.int64)
                rep = np.repeat(np.arange(len(m)), m)
                j = np.arange(len(rep)) - np.repeat(np.cumsum(m) - m, m)
                i = block[rep]
                grid = (np.minimum(i, j) * (1 << 20) + np.maximum(i, j)).astype(np.uint64)
                parts.append((d[hot][rep], mix64(h[hot][rep] ^ mix64(grid + np.uint64(1))), pos[hot][rep],
                              np.where(i == j, 2, (i > j).astype(np.int64)).astype(np.uint8)))
                d, key, pos, side = (np.concatenate(x) for x in zip(*parts))
            yield from cells(n, POSTS, (mix64(key) % np.uint64(n)).astype(np.int64), key, kid[d], tag[d], size[d].astype(np.uint32), pos.astype(np.uint32), side)
    return run


def passes(nx, px, sx, ny, py, sy, t) -> np.ndarray:
    """Length and positional filter of two documents at a shared shingle, and whether this cell is the pair's."""
    num, den = t
    nx, ny, px, py = (np.asarray(v, np.int64) for v in (nx, ny, px, py))
    ok = (np.minimum(nx, ny) * den >= num * np.maximum(nx, ny)) & ((np.asarray(sx) == 2) | (np.asarray(sx) != np.asarray(sy)))
    return ok & (np.minimum(nx - px, ny - py) >= need(nx, ny, t))


def _pairs_out(n: int, pairs: list) -> list:
    """Distinct pairs as cells at the home of the set that travels."""
    if not pairs:
        return []
    ak, at, bk, bt = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((bt, bk, at, ak))
    ak, at, bk, bt = ak[order], at[order], bk[order], bt[order]
    keep = np.arange(len(ak)) == runs(ak, at, bk, bt)
    ak, at, bk, bt = ak[keep], at[keep], bk[keep], bt[keep]
    return list(cells(n, PAIRS, home(ak, at, n), ak, at, bk, bt))


def _stars(n: int, t):
    """Each shingle's earliest document against all others; lists of three and more go on, for what the star leaves open."""
    def run(table: pa.Table) -> pa.Table:
        key, kid, tag, size, pos, side = read_cells(table, POSTS, POSTING)
        order = np.lexsort((tag, kid, size, pos, key))
        key, kid, tag, size, pos, side = (x[order] for x in (key, kid, tag, size, pos, side))
        first = runs(key)
        count = np.bincount(first, minlength=len(first))[first] if len(first) else first
        x = np.flatnonzero((count > 1) & (first != np.arange(len(first))))
        lead = first[x]
        ok = passes(size[x], pos[x], side[x], size[lead], pos[lead], side[lead], t) & ((kid[x] != kid[lead]) | (tag[x] != tag[lead]))
        x, lead = x[ok], lead[ok]
        out = _pairs_out(n, [(kid[lead], tag[lead], kid[x], tag[x])])
        more = np.flatnonzero(count > 2)
        more = more[np.lexsort((pos[more], tag[more], kid[more]))]
        out += cells(n, POSTS, home(kid[more], tag[more], n), key[more], kid[more], tag[more], size[more], pos[more], side[more])
        return joined(out, table)
    return run


def _label(n: int):
    """Posts at their home meet the components found so far, and go back to their shingle."""
    def run(posts: pa.Table, labels: pa.Table) -> pa.Table:
        key, kid, tag, size, pos, side = read_cells(posts, POSTS, POSTING)
        lkid, ltag = kid.copy(), tag.copy()
        if labels.num_rows and len(kid):
            names = {x[:2]: x[2:] for x in zip(*(labels.column(c).to_pylist() for c in ("kid", "tag", "lkid", "ltag")))}
            at = np.flatnonzero(np.arange(len(kid)) == runs(kid, tag))
            found = [names.get(x, x) for x in zip(kid[at].tolist(), tag[at].tolist())]
            times = np.diff(np.append(at, len(kid)))
            lkid, ltag = np.repeat(np.array([f[0] for f in found], np.int64), times), np.repeat(np.array([f[1] for f in found], np.int64), times)
        out = list(cells(n, POSTS, (mix64(key) % np.uint64(n)).astype(np.int64), key, kid, tag, size, pos, side, lkid, ltag))
        return joined(out, posts.slice(0, 0))
    return run


def _across(n: int, t):
    """All pairs of one shingle that pass the filters and lie in different components, but for the star's."""
    def run(table: pa.Table) -> pa.Table:
        key, kid, tag, size, pos, side, lkid, ltag = read_cells(table, POSTS, LABELLED)
        order = np.lexsort((tag, kid, size, pos, key))
        key, kid, tag, size, pos, side, lkid, ltag = (x[order] for x in (key, kid, tag, size, pos, side, lkid, ltag))
        pairs = []
        cuts = np.append(np.flatnonzero(np.arange(len(key)) == runs(key)), len(key))
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 3 or (lkid[a:b] == lkid[a]).all() and (ltag[a:b] == ltag[a]).all():
                continue
            for i in range(a + 1, b - 1):
                # by rising position: past the last that can pass with i there is none
                x = np.arange(i + 1, b)
                ok = ((lkid[x] != lkid[i]) | (ltag[x] != ltag[i])) & passes(size[x], pos[x], side[x], size[i], pos[i], side[i], t)
                x = x[ok]
                if len(x):
                    pairs.append((np.full(len(x), kid[i]), np.full(len(x), tag[i]), kid[x], tag[x]))
        return joined(_pairs_out(n, pairs), table.slice(0, 0))
    return run


def _send(n: int, width: int):
    """The set of each travelling document, once to each home of the documents that it is tested with."""
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("pairs", pa.binary())])
        ak, at, bk, bt = read_cells(asked, PAIRS, PAIR)
        if not len(ak) or not docs.num_rows:
            return schema.empty_table()
        batch = docs.combine_chunks().to_batches()[0]
        rows = Rows(batch)
        target = home(bk, bt, n)
        order = np.lexsort((bt, bk, target, at, ak))
        ak, at, bk, bt, target = (x[order] for x in (ak, at, bk, bt, target))
        keep = np.arange(len(ak)) == runs(ak, at, bk, bt)
        ak, at, bk, bt, target = (x[keep] for x in (ak, at, bk, bt, target))
        row = rows.find(ak, at)
        sets = sets_of(batch, np.unique(row), width)
        cuts = np.append(np.flatnonzero(np.arange(len(ak)) == runs(ak, at, target)), len(ak))
        out = [(int(target[a]), pack(sets[row[a]]), pack(ak[a:b], at[a:b], bk[a:b], bt[a:b])) for a, b in zip(cuts, cuts[1:])]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
    return run


def sets_of(batch: pa.RecordBatch, rows: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Sorted shingle hashes of the given rows."""
    part = batch.take(pa.array(rows))
    d, h = shingle_sets(*texts_of(part, "text"), width)
    cuts = np.searchsorted(d, np.arange(len(rows) + 1))
    return {int(r): h[cuts[i]:cuts[i + 1]] for i, r in enumerate(rows)}


def reaches(x: np.ndarray, y: np.ndarray, t, cells_x=None, cells_y=None) -> bool:
    """Whether two sorted sets reach the threshold; the suffix filter comes first."""
    least = int(need(len(x), len(y), t))
    if cells_x is not None and int(np.abs(cells_x - cells_y).sum()) > len(x) + len(y) - 2 * least:
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= least


def ranges(x: np.ndarray) -> np.ndarray:
    """How many hashes lie in each sixteenth of the hash range."""
    return np.bincount((x >> np.uint64(60)).astype(np.int64), minlength=16)


def _test(width: int, t):
    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        schema = pa.schema([("akid", pa.int64()), ("atag", pa.int64()), ("bkid", pa.int64()), ("btag", pa.int64())])
        if not sent.num_rows or not docs.num_rows:
            return schema.empty_table()
        batch = docs.combine_chunks().to_batches()[0]
        rows = Rows(batch)
        asked = [(unpack(h, np.uint64)[0], unpack(p, *PAIR)) for h, p in zip(sent.column("hashes").to_pylist(), sent.column("pairs").to_pylist())]
        found = [rows.find(p[2], p[3]) for _, p in asked]
        sets = sets_of(batch, np.unique(np.concatenate(found)), width)
        spread = {r: ranges(s) for r, s in sets.items()}
        out = []
        for (x, p), own in zip(asked, found):
            cx = ranges(x)
            ok = np.array([reaches(x, sets[int(r)], t, cx, spread[int(r)]) for r in own], bool)
            out.append([c[ok].astype(np.int64) for c in p])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)
    return run


def _tested(docs: DataFrame, pairs: DataFrame, n: int, width: int, t) -> DataFrame:
    """The pairs that reach the threshold: akid, atag, bkid, btag."""
    sent = docs.groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(of_cogroup(_send(n, width)), "bucket int, hashes binary, pairs binary")
    return docs.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(of_cogroup(_test(width, t)), "akid long, atag long, bkid long, btag long")


def components(links: DataFrame) -> DataFrame:
    """Least name that each linked document reaches: kid, tag, lkid, ltag, for rows akid, atag, bkid, btag.

    Each round takes the least label among the neighbours and then the label
    of the label; both joins are of two written tables, whose skewed keys
    Spark splits by itself.
    """
    a, b = F.struct(F.col("akid").alias("kid"), F.col("atag").alias("tag")), F.struct(F.col("bkid").alias("kid"), F.col("btag").alias("tag"))
    edges = settle(links.select(a.alias("u"), b.alias("v")).unionByName(links.select(b.alias("u"), a.alias("v"))).distinct(), "links")
    labels = settle(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = settle(labels.join(near, labels["id"] == near["u"]).select("id", F.least("label", "m").alias("label"), F.col("label").alias("was")), "labels")
        top = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = settle(step.join(top, "label").select("id", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("moved")), "labels")
        labels = jumped.select("id", "label")
        if not jumped.filter("moved").limit(1).count():
            return labels.select(F.col("id.kid").alias("kid"), F.col("id.tag").alias("tag"), F.col("label.kid").alias("lkid"), F.col("label.tag").alias("ltag"))


def of_kind(dealt: DataFrame, kind: int) -> DataFrame:
    """The cells of one kind, at their bucket or under way."""
    return dealt.filter(F.col("kind") % HOP == kind)


def similarity_groups(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, split: int = SPLIT):
    """(cells of documents, components): see :func:`group_documents` and :func:`keep_one`."""
    spark = docs.sparkSession
    ship_package(spark)
    n = buckets(spark)
    own = with_bucket(pick(docs, "doc_id", "text"), n)
    flat = own.select("doc_id", "text")
    handle = spark.sparkContext.broadcast(frequencies(flat, width))
    posted = settle(in_arrow(flat, of_task(_post(n, width, threshold, split, handle)), CELLS), "posts")
    stars = settle(routed(of_kind(posted, POSTS), n).groupBy("bucket").applyInArrow(of_group(_stars(n, threshold)), CELLS), "stars")
    links = settle(_tested(own, routed(of_kind(stars, PAIRS), n), n, width, threshold), "links")
    labels = components(links)
    by_home = labels.withColumn("bucket", home_column("kid", "tag", n))
    labelled = routed(of_kind(stars, POSTS), n).groupBy("bucket").cogroup(by_home.groupBy("bucket")).applyInArrow(of_cogroup(_label(n)), CELLS)
    across = settle(routed(labelled, n).groupBy("bucket").applyInArrow(of_group(_across(n, threshold)), CELLS), "across")
    more = _tested(own, routed(across, n), n, width, threshold) if across.limit(1).count() else None

    def copies(table):
        for batch in table:
            names = [x.astype(np.int64) for x in unpack_pairs(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in names], ["akid", "atag", "bkid", "btag"])

    all_links = links.unionByName(in_arrow(posted.filter(F.col("kind") == COPIES), copies, "akid long, atag long, bkid long, btag long"))
    return routed(of_kind(posted, DOCS), n), components(all_links.unionByName(more) if more is not None else all_links)


def unpack_pairs(batch) -> list[np.ndarray]:
    from barquet.llm.common import unpack_all
    return unpack_all(batch.column("cell").to_pylist(), *PAIR)


def _groups():
    def run(docs: pa.Table, labels: pa.Table) -> pa.Table:
        kid, tag, size, null = read_cells(docs, DOCS, DOCUMENT)
        names = {x[:2]: x[2] for x in zip(*(labels.column(c).to_pylist() for c in ("kid", "tag", "lkid")))}
        comp = np.array([names.get(x, x[0]) for x in zip(kid.tolist(), tag.tolist())], np.int64)
        return pa.table({"doc_id": pa.array(kid, mask=null.astype(bool)), "n_shingles": pa.array(size.astype(np.int64)),
                         "component_id": pa.array(comp, mask=null.astype(bool) & (comp == LAST_ID))})
    return run


def group_documents(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id (the smallest id that links reach) of every document."""
    found, labels = similarity_groups(docs, width, threshold, split)
    n = buckets(docs.sparkSession)
    by_home = labels.withColumn("bucket", home_column("kid", "tag", n))
    return found.groupBy("bucket").cogroup(by_home.groupBy("bucket")).applyInArrow(of_cogroup(_groups()), "doc_id long, n_shingles long, component_id long")


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each group; of fully equal rows one stays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    names = docs.columns
    held = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    find = lambda x: f"_d{names.index(x) if x in names else [c.lower() for c in names].index(x)}"
    n = buckets(docs.sparkSession)
    own = with_bucket(held.withColumns({"doc_id": held[find("doc_id")], "text": held[find("text")]}), n)
    _, labels = similarity_groups(docs, width, threshold)
    by_home = labels.withColumn("bucket", home_column("kid", "tag", n))
    schema = to_arrow_schema(held.schema)

    def run(table: pa.Table, groups: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        batch = table.combine_chunks().to_batches()[0]
        rows = Rows(batch)
        top = {x[:2]: x[2:] for x in zip(*(groups.column(c).to_pylist() for c in ("kid", "tag", "lkid", "ltag")))}
        own_names = list(zip(rows.kid.tolist(), rows.tag.tolist()))
        empty = [not (x or "").strip(" \t\n\v\f\r") for x in batch.column("text").to_pylist()]
        keep = [e or (top.get(x, x) == x and rows.first[x] == i) for i, (x, e) in enumerate(zip(own_names, empty))]
        return pa.Table.from_batches([batch.select(schema.names).filter(pa.array(keep, pa.bool_()))]).cast(schema)
    return own.groupBy("bucket").cogroup(by_home.groupBy("bucket")).applyInArrow(of_cogroup(run), held.schema).toDF(*names)
