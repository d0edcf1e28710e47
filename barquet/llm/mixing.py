"""Mixing sources to target weights.

Word counts are summed per source (map-side combined, so a hot source costs
one row a task). Targets fill up by weight under a cap, in closed form; a
source's repetition rate is target / size, and a document is emitted
floor(rate) times plus once more with probability equal to the fraction,
drawn from a hash of its id.

Defined cases: a null text has size 0; null sources are one source that sorts
last; sources of size 0 get target 0 and rate 0; rows with equal ids draw
alike, a null id draws by its text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.llm.common import attach, pick, settle

#: Words: maximal runs without ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"


def draw(seed: str):
    """Uniform in [0, 1) from 52 bits of md5(seed, id); equal on every run and engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: size, target and rate, from rows (source, size).

    Water filling: with sources ordered by cap * size / weight, those whose
    bound is below the level of what is left per weight take their bound, all
    others share the rest by weight. The table has a row a source, not a
    document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    t = (totals.withColumn("weight", F.element_at(ws, (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")))
         .withColumn("bound", F.lit(cap) * F.col("source_size")))
    by_level = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    t = (t.withColumn("goal", F.lit(share) * F.sum("source_size").over(whole))
         .withColumn("left", F.col("goal") - F.coalesce(F.sum("bound").over(below), F.lit(0.0)))
         .withColumn("left_weight", F.sum("weight").over(rest))
         .withColumn("full", F.col("bound") * F.col("left_weight") <= F.col("left") * F.col("weight")))
    t = t.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("bound") / F.col("weight"), "left", "left_weight"))).over(whole))
    target = F.when(F.col("full"), F.col("bound")).otherwise(
        F.least(F.col("bound"), F.col("weight") * F.col("level.left") / F.col("level.left_weight")))
    return (t.withColumn("target", target)
            .select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")))


def mixing_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, rate, copies (and the ``carry`` columns)."""
    own = pick(docs, "doc_id", "text", "source", *[c for c in carry if c not in ("doc_id", "text", "source")])
    sized = own.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))
    rates = settle(source_targets(sized.select("source", "size"), weights, share, cap), "mixing")
    key = F.concat(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce("source", F.lit("")))
    joined = attach(sized.withColumn("_key", key), rates.select(key.alias("_key"), "source_size", "target", "rate"), "_key")
    floor = F.floor("rate")
    copies = (floor + F.when(draw(seed) < F.col("rate") - floor, 1).otherwise(0)).cast("int")
    return joined.withColumn("copies", copies).select(
        *dict.fromkeys(("doc_id", "size", "source_size", "target", "rate", "copies", *carry)))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixture itself: every column of ``docs``, one row for each emitted copy."""
    names = docs.columns
    held = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    low = [n.lower() for n in names]
    at = {n: held[f"_d{names.index(n) if n in names else low.index(n)}"] for n in ("doc_id", "text", "source")}
    wide = held.select("*", *[c.alias(n) for n, c in at.items()])
    plan = mixing_plan(wide, weights, share, cap, seed, tuple(held.columns))
    return (plan.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*held.columns).toDF(*names))
