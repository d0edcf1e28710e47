"""SimHash document fingerprints and the search for near fingerprints, in DataFrame functions alone.

A text's terms are its pairs of neighbouring words, cut at spaces (the first
word alone is a term too); a term weighs as many votes as it has characters, 16 at most, so
that pairs of frequent short words count little. Each of the 128 bits of a
term's hash votes for or against the same bit of the fingerprint; several bits'
votes are summed in one long.

Documents are ordered by (doc_id, text hash); a null id comes last. Fully
equal rows are one document, computed once; each has its output row. A null text is empty; a text without words has
the fingerprint 0. The document after the last is the first; a single
document is its own next. Texts with equal words and white space layout have
equal fingerprints.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.llm.common import attach, partitions, pick, settle

BITS = 128
MAX_WEIGHT = 16
#: Stands for a null id in the order: after every other.
LAST_ID = (1 << 63) - 1
#: Terms a block: BLOCK * MAX_WEIGHT votes fit 15 bits (the highest field has the sign).
BLOCK = 2000
#: Output rows that one joined row stands for at most.
COPIES = 10_000
#: The lowest bit of each of four 16-bit fields, and the 16-bit values in two 32-bit fields.
_FOUR = 1 + (1 << 16) + (1 << 32) + (1 << 48)
_TWO_FIELDS = 0xFFFF + (0xFFFF << 32)


def _words(text: Column) -> Column:
    return F.split(text, " ", -1)


def _terms(words: str, start: Column) -> Column:
    """Pairs of neighbours of an array column from word ``start`` on, with the number of the block that they are counted in.

    ``words`` must be a plain column: an expression would be computed again
    for each element.
    """
    w = F.col(words)
    count = F.size(w) - start
    at = F.when(count > 0, F.sequence(start, F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(
        F.when(i == 0, F.get(w, i)).otherwise(F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i))).alias("t"),
        F.floor(i / BLOCK).cast("int").alias("b")))


def _bits(part: str, total: str) -> Column:
    """The signed majority of each bit as one long; the i-th sum holds bits i and i + 32, 32 bits each."""
    sums = F.array(*[F.col(f"{part}_{i}") for i in range(32)])
    ones = F.concat(F.transform(sums, lambda s: s.bitwiseAND(F.lit((1 << 32) - 1))), F.transform(sums, lambda s: F.shiftrightunsigned(s, 32)))
    powers = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    chosen = F.zip_with(ones, powers, lambda n, bit: F.when(n * 2 > F.col(total), bit).otherwise(F.lit(0).cast("long")))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def fingerprints(texts: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """Fingerprints of one or more texts (string columns ``sides``) of each row of ``keys`` (distinct): two longs for each side.

    ``common`` (long) counts leading words that all sides share; their votes
    are counted once. Votes are summed four bits to a long over blocks of
    terms too short to overflow a field, then two bits to a long over blocks.
    Returns ``keys`` and, for side i, fi_0 and fi_1.
    """
    first, rest = sides[0], sides[1:]
    own = [F.struct(F.lit(i).alias("side"), F.col("common").cast("int").alias("start"), _words(F.col(c)).alias("words")) for i, c in enumerate(sides)]
    shared = F.struct(F.lit(-1).alias("side"), F.lit(0).alias("start"), F.slice(_words(F.col(first)), F.lit(1), F.greatest(F.col("common"), F.lit(0)).cast("int")).alias("words"))
    held = texts.select(*keys, F.inline(F.array(*([shared] if rest else []), *own)))
    terms = held.select(*keys, "side", F.inline(_terms("words", F.col("start"))))
    hashed = terms.select(*keys, "side", "b", F.least(F.length("t"), F.lit(MAX_WEIGHT)).cast("long").alias("_w"),
                          F.xxhash64("t").alias("_h0"), F.xxhash64(F.lit(1), "t").alias("_h1"))
    sums = [F.sum(F.shiftrightunsigned(F.col(p), i).bitwiseAND(F.lit(_FOUR)) * F.col("_w")).alias(f"{p}_{i}") for p in ("_h0", "_h1") for i in range(16)]
    blocks = hashed.groupBy(*keys, "side", "b").agg(F.sum("_w").alias("_total"), *sums)
    # field i of a block's long: bits i, i + 16, i + 32, i + 48
    wide = [F.shiftrightunsigned(F.col(f"{p}_{i % 16}"), 16 * (i // 16)).bitwiseAND(F.lit(_TWO_FIELDS)).alias(f"{p}_{i}") for p in ("_h0", "_h1") for i in range(32)]
    spread = blocks.select(*keys, "side", "_total", *wide)
    whole = []
    for k in range(len(sides)):
        counts = F.col("side").isin(-1, k)
        whole.append(F.sum(F.when(counts, F.col("_total"))).alias(f"s{k}_total"))
        whole += [F.sum(F.when(counts, F.col(f"{p}_{i}"))).alias(f"s{k}{p}_{i}") for p in ("_h0", "_h1") for i in range(32)]
    summed = spread.groupBy(*keys).agg(*whole)
    prints = summed.select(*keys, *[F.coalesce(_bits(f"s{k}_h{h}", f"s{k}_total"), F.lit(0).cast("long")).alias(f"f{k}_{h}") for k in range(len(sides)) for h in (0, 1)])
    # a text always has a word (the empty one, which has no vote), so only rows without any term are left out: there are none
    return prints


def as_text(f0: Column, f1: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)])


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))) / F.lit(float(BITS))


def next_documents(keys: DataFrame) -> DataFrame:
    """For distinct rows (kid, th, n): the next row's kid and th in ascending order, the last followed by the first.

    Rows are range-partitioned and numbered by partition once (written, as
    range bounds are sampled); within a partition a window finds the next
    row, and only the first row of each partition is handed to the partition
    before it.
    """
    spark = keys.sparkSession
    ranged = keys.repartitionByRange(partitions(spark), "kid", "th").withColumn("pid", F.spark_partition_id())
    ranged = settle(ranged, "order")
    following = F.lead(F.struct("kid", "th")).over(Window.partitionBy("pid").orderBy("kid", "th"))
    firsts = ranged.groupBy("pid").agg(F.min(F.struct("kid", "th")).alias("own"))
    order = Window.orderBy("pid")  # a row a partition
    wrap = F.first("own").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("pid", F.coalesce(F.lead("own").over(order), wrap).alias("after"))
    out = attach(ranged.withColumn("nxt", following), after, "pid")
    nxt = F.coalesce("nxt", "after")
    return out.select("kid", "th", "n", nxt["kid"].alias("next_kid"), nxt["th"].alias("next_th"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and the row's key: kid (id, nulls last) and th (hash of the text)."""
    text = F.coalesce("text", F.lit(""))
    return pick(docs, "doc_id", "text").select(
        "doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("kid"), F.xxhash64(text).alias("th"))


def edited_documents(rows: DataFrame) -> DataFrame:
    """Each distinct document of ``rows`` (see ``keyed``) with its edited text: its last floor(n / 4) characters replaced by the next document's first as many.

    The text moves once; a document's next one receives only (key, number of
    characters) and sends that prefix back.
    """
    # equal rows meet in the scan tasks already: a key sends one text a task
    texts = rows.groupBy("kid", "th").agg(F.first("text").alias("text"))
    lengths = rows.select("kid", "th", F.length("text").cast("long").alias("n")).distinct()
    links = settle(next_documents(lengths), "next")
    asked = links.select(F.col("next_kid").alias("kid"), F.col("next_th").alias("th"),
                         F.col("kid").alias("to_kid"), F.col("th").alias("to_th"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    # both joins read the same texts, so that they share one exchange of them
    sent = (texts.join(asked, ["kid", "th"])
            .select(F.col("to_kid").alias("kid"), F.col("to_th").alias("th"),
                    F.substring("text", F.lit(1), F.col("k")).alias("tail"), F.col("kid").alias("next_kid"), F.col("th").alias("next_th")))
    own = texts.join(sent, ["kid", "th"])
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    return own.select("kid", "th", "next_kid", "next_th", "text", n.cast("long").alias("n_chars"),
                      F.concat(F.substring("text", F.lit(1), kept), "tail").alias("edited"))


def each_row(rows: DataFrame) -> DataFrame:
    """(kid, th, doc_id, copies): the rows of each document, in steps of ``COPIES`` at most."""
    counted = rows.groupBy("kid", "th", "doc_id").agg(F.count("*").alias("_all"))
    steps = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1, F.lit(COPIES).cast("long"))).alias("_from"))
    return steps.select("kid", "th", "doc_id", F.least(F.col("_all") - F.col("_from"), F.lit(COPIES)).cast("int").alias("copies"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_chars, edited_sha256, the two fingerprints and their likenesses (module docstring)."""
    given = keyed(docs)
    e = edited_documents(given)
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    # words before the last one of the kept text are the same in both texts
    sides = e.select("kid", "th", F.struct("next_kid", "next_th", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")).alias("info"),
                     "text", "edited", (F.size(_words(F.substring("text", F.lit(1), kept.cast("int")))) - 1).alias("common"))
    prints = fingerprints(sides, ["kid", "th", "info"], ["text", "edited"])
    rows = prints.select("kid", "th", "info", F.col("f0_0").alias("f0"), F.col("f0_1").alias("f1"), F.col("f1_0").alias("e0"), F.col("f1_1").alias("e1"))
    rows = settle(rows, "fingerprints")
    after = rows.select(F.col("kid").alias("next_kid"), F.col("th").alias("next_th"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    out = rows.select("*", "info.*").join(after, ["next_kid", "next_th"], "left")
    # one output row for each input row
    out = out.join(each_row(given), ["kid", "th"]).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    c = F.col
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(c("f0"), c("f1")).alias("fingerprint"), as_text(c("e0"), c("e1")).alias("edited_fingerprint"),
                      likeness(c("f0"), c("f1"), c("e0"), c("e1")).alias("near_edited"), likeness(c("f0"), c("f1"), c("n0"), c("n1")).alias("near_next"))


def block_tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Rows of ``prints`` once for each permuted table, with the table's number and key.

    128 bits are cut into ``blocks`` runs; each table leads with another
    choice of ``blocks - radius`` of them. Two fingerprints within the radius
    differ in at most ``radius`` blocks, so they agree on the whole key of at
    least one table.
    """
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    bits = F.concat(*[F.lpad(F.conv(F.hex(F.col(f)), 16, 2), 64, "0") for f in ("f0", "f1")])
    runs = [F.substring(bits, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[runs[i] for i in chosen]).alias("key"))
                       for t, chosen in enumerate(combinations(range(blocks), blocks - radius))])
    return prints.select("*", F.inline(tables))


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All distinct fingerprints (f0, f1) of ``prints`` within ``radius`` bits of each distinct query fingerprint.

    Returns q0, q1, f0, f1, distance; a query finds itself if ``prints`` has
    it. Equal fingerprints are one before the tables are built, so a group of
    copies costs one row a table; join back on (f0, f1) for the documents.
    """
    q = block_tables(queries.select("f0", "f1").distinct(), radius, blocks).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), "table", "key")
    p = block_tables(prints.select("f0", "f1").distinct(), radius, blocks)
    found = q.join(p, ["table", "key"]).withColumn(
        "distance", F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("f1"))))
    return found.filter(F.col("distance") <= radius).select("q0", "q1", "f0", "f1", "distance").distinct()
