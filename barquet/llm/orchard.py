"""Centroid clustering of integer vectors; the nearest centroid is found by Orchard's search.

Every centroid has the list of all others sorted by their distance from it.
A vector starts at centroid 0 and walks the list of its closest centroid so
far: a listed centroid that was not visited yet is measured and marked, and a
closer one (or an equally close one of smaller number) becomes the new best,
whose own list is walked from its start. By the triangle inequality nothing
beyond twice the best distance can be closer or equal, so the walk stops at
the first listed centroid strictly beyond it. All distances are squared
integers: "beyond twice" reads ``between > 4 * best``.

The vectors of an Arrow batch walk together: each numpy step takes one list
entry for every vector that has not stopped. Only the centroids (k vectors)
travel to the tasks; a task sends one row a cluster back (count and sums of
what it assigned), so no cluster is ever gathered, however many vectors it
holds.

Defined cases: vectors of another length, null vectors, and vectors holding
null or non-finite components take no part; a component that does not fit
27 bits after scaling is an error (squared distances would not fit a long); a
null id hashes as the empty text; equal ids are told apart by their
components when seeds are chosen, and repeated rows are rows of their own;
with fewer vectors than centroids every vector is a seed; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import in_arrow, pick, settle

DIMS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, "2", 256.0
#: 64 dimensions times the square of a difference below 2**28 stay under 2**63.
COMPONENT_BITS = 27
#: Vectors that walk together: bounds a task's work arrays whatever the batch.
BLOCK = 4096


def integer_vectors(embeddings: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = pick(embeddings, "vec_id", "embedding").filter(x.isNotNull() & (F.size(x) == dims) & F.coalesce(fits, F.lit(False)))
    small = F.forall("embedding", lambda c: F.abs(F.lit(scale) * c.cast("double")) < float(1 << COMPONENT_BITS))
    return kept.select("vec_id", F.when(small, whole).otherwise(
        F.raise_error(F.lit(f"a component does not fit {COMPONENT_BITS} bits")).cast("array<bigint>")).alias("v"))


def seeds(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in hash order (a top-k, so k rows reach the driver)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Lists:
    """Centroids with their sorted neighbour lists (the centroid itself left out) and the distances in them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        order = np.argsort(gaps, axis=1, kind="stable")
        others = np.array([row[row != c] for c, row in enumerate(order)], np.int64).reshape(len(centroids), -1)
        self.next = others
        self.gap = np.take_along_axis(gaps, others, 1) if others.size else np.zeros_like(others)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, distances computed) of each row of ``v``; ties go to the smaller number."""
        n, width = len(v), self.next.shape[1]
        best = np.zeros(n, np.int64)
        least = ((v - self.centroids[0]) ** 2).sum(1)
        at = np.zeros(n, np.int64)
        seen = np.zeros((n, len(self.centroids)), bool)
        seen[:, 0] = True
        live = np.arange(n if width else 0)
        while len(live):
            c, p = best[live], at[live]
            near = self.gap[c, p] <= 4 * least[live]
            live, c, p = live[near], c[near], p[near]
            other = self.next[c, p]
            at[live] += 1
            new = ~seen[live, other]
            own, other = live[new], other[new]
            seen[own, other] = True
            d = ((v[own] - self.centroids[other]) ** 2).sum(1)
            closer = (d < least[own]) | ((d == least[own]) & (other < best[own]))
            own, other, d = own[closer], other[closer], d[closer]
            best[own], least[own], at[own] = other, d, 0
            live = live[at[live] < width]
        return best, least, seen.sum(1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, measured): the nearest centroid, its squared distance, and how many distances it took."""
    dims = centroids.shape[1]

    def run(batches):
        lists = Lists(centroids)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                number, d, measured = lists.nearest(_matrix(part.column("v"), dims))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(d), pa.array(measured.astype(np.int32))],
                                                 ["vec_id", "cluster", "distance", "measured"])
    return in_arrow(vectors, run, "vec_id long, cluster int, distance long, measured int")


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: componentwise floor(sum / count) of what each was assigned; an empty one stays."""
    k, dims = centroids.shape

    def run(batches):
        lists, sums, counts = Lists(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                v = _matrix(batch.slice(a, BLOCK).column("v"), dims)
                number = lists.nearest(v)[0]
                np.add.at(sums, number, v)
                counts += np.bincount(number, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])
    parts = in_arrow(vectors.select("v"), run, "cluster int, n long, s array<bigint>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)]).collect()
    out = centroids.copy()
    for r in totals:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster(embeddings: DataFrame, dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED,
            scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(assignments as of :func:`assign`, the final centroids). Vectors are scaled and written once, then read a round."""
    vectors = settle(integer_vectors(embeddings, dims, scale), "orchard")
    centroids = seeds(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("measured")), centroids
    for _ in range(rounds):
        centroids = _means(vectors, centroids)
    return settle(assign(vectors, centroids), "orchard"), centroids


def cluster_report(embeddings: DataFrame, **parameters) -> DataFrame:
    """Every vector with its cluster, distance, the inertia of its cluster and of all, and its centroid's digest."""
    assigned, centroids = cluster(embeddings, **parameters)
    spark = embeddings.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row a centroid
    total = sum(r["s"] for r in sums)
    rows = [(r["cluster"], r["s"], total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("measured").alias("n_measured"))
