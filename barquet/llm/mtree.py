"""Exact top-k by inner product: best-first search in a forest of M-trees.

Largest inner product is turned into nearest point: every vector gets one
more component that brings its norm to the largest norm of all, a query gets
0 there; then distance^2 = |q|^2 + M^2 - 2 * score, a metric, so triangle
bounds hold.

Root level: a fixed number of pivots (a hashed sample, bounded) with the
covering radius of the vectors nearest to them. A pivot's vectors are dealt
into as many parts as their number asks for, so a vector that makes up a third
of all rows fills several parts. Each part is one tree: pages of entries with
a routing vector, a covering radius and the distances to the parent, stored
page by page. A query first searches one part of its nearest pivot; its k-th
score bounds the second pass, which only goes to parts whose pivot may hold
something better, and there visits pages by rising lower bound. Bounds from
stored parent distances are tried before any distance is computed. Queries go
through a tree in blocks: a few pages at once are scored against all queries of
the block that need one of them, in one product of matrices (of floats where
those hold every sum exactly, which integers within their norms let one tell).

In the second pass the trees of neighbouring parts make a group, and a batch of
queries goes to a group as one packed cell: where bounds leave out little, as
for vectors without clusters, a query would else travel once a part. A group's
trees share the best that a query has found, so it returns k hits at most.

Defined cases: vectors that are null, or hold a null or a non-finite
component, and rows with a null id take no part; a shorter vector counts as
zero beyond its end; rows with the query's id are the query's own row; equal
scores go to the smaller id, and rows that repeat an id may each be found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.llm.common import in_arrow, of_cogroup, of_task, pack, partitions, pick, settle, unpack
from barquet.session import ship_package

K, EVERY, SCALE, PIVOTS = 5, 50, 256.0, 64
PAGE = 48
LEAST_PART, MOST_PART = 128, 8192
#: Queries handled at once in a part, and the pages that they are scored against at once.
BLOCK, AT_ONCE = 512, 32
#: Groups of trees in the second pass, at most: as many as let its queries weigh as much as the points so many times over, or LEAST_GROUPS.
WEIGHT, LEAST_GROUPS = 2, 32


def _vectors(scale: float):
    def run(batches):
        for batch in batches:
            batch = batch.select(["vec_id", "embedding"])
            batch = batch.filter(pc.and_(batch.column("vec_id").is_valid(), batch.column("embedding").is_valid()))
            lists = batch.column("embedding")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            ok = np.ones(len(size), bool)
            ok[np.repeat(np.arange(len(size)), size)[~np.isfinite(x)]] = False
            x, size, ids = x[np.repeat(ok, size)], size[ok], batch.column("vec_id").filter(pa.array(ok))
            ends = np.concatenate([[0], np.cumsum(size)])
            if len(size) and size[0] and (size == size[0]).all():
                rows = x.reshape(len(size), -1)
                norm2 = np.einsum("ij,ij->i", rows, rows)
            else:
                norm2 = np.array([float(x[a:b] @ x[a:b]) for a, b in zip(ends, ends[1:])], np.float64)
            cells = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([ids, cells, pa.array(norm2, pa.float64()), pa.array(size, pa.int64())], ["vec_id", "v", "norm2", "dim"])
    return run


def matrix(cells, dim: int) -> np.ndarray:
    if dim and len(cells) and all(len(c) == 8 * dim for c in cells):
        return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), dim)
    out = np.zeros((len(cells), dim))
    for i, c in enumerate(cells):
        x = np.frombuffer(c, np.float64)
        out[i, :len(x)] = x
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole components as 16-bit numbers where they all fit."""
    return x.astype(np.int16) if not x.size or -32768 <= x.min() and x.max() <= 32767 else x


class Space:
    """The lifted metric: data points get sqrt(top - |x|^2) as a last component, queries 0."""

    def __init__(self, dim: int, top: float):
        self.dim, self.top = dim, top
        self.slack = 1e-7 * (1.0 + np.sqrt(top))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top - (x * x).sum(1, keepdims=True), 0.0))], 1)

    def ask(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], 1)

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All distances between the rows of a and of b."""
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(d2, 0.0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of a point with the given score from each query."""
        return np.sqrt(np.maximum((q * q).sum(1) + self.top - 2.0 * score, 0.0))


class Best:
    """The best k of each query so far, by falling score and rising id, and the score that a further one must have."""

    def __init__(self, bound: np.ndarray, k: int):
        self.k, self.bound = k, np.array(bound, np.float64)
        self.score = np.full((len(bound), k), -np.inf)
        self.id = np.full((len(bound), k), np.iinfo(np.int64).max)

    def put(self, rows, ids, scores) -> None:
        k = self.k
        better = (scores > self.score[rows, k - 1]) | (ids < self.id[rows, k - 1])
        rows, ids, scores = rows[better], ids[better], scores[better]
        touched = np.unique(rows)
        if not len(touched):
            return
        r = np.concatenate([np.repeat(touched, k), rows])
        i = np.concatenate([self.id[touched].reshape(-1), ids])
        s = np.concatenate([self.score[touched].reshape(-1), scores])
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        top = rank < k
        self.score[r[top], rank[top]] = s[top]
        self.id[r[top], rank[top]] = i[top]
        self.bound[touched] = np.maximum(self.bound[touched], self.score[touched, k - 1])

    def hits(self):
        """(query row, id, score) arrays."""
        r, c = np.nonzero(np.isfinite(self.score))
        return r, self.id[r, c], self.score[r, c]


class Tree:
    """One part: pages with routing vectors, covering radii and parent distances.

    ``ids``, ``x`` (components) and ``last`` (the lifting one) are in page
    order; page i holds rows cut[i] to cut[i + 1] with their distances to its
    routing vector; ``up`` is the routing vector's distance to the part's pivot.
    """

    FIELDS = ("ids", "x", "last", "own", "cut", "centers", "up", "radius")

    def __init__(self, ids, x, last, own, cut, centers, up, radius):
        self.ids, self.x, self.last, self.own, self.cut, self.centers, self.up, self.radius = ids, x, last, own, cut, centers, up, radius

    @property
    def points(self) -> np.ndarray:
        return np.concatenate([self.x.astype(np.float64), self.last[:, None]], 1)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, space: Space, pivot: np.ndarray) -> "Tree":
        points = space.lift(x)
        order = np.lexsort((ids,))
        ids, points = ids[order], points[order]
        far = space.distance(points, pivot[None, :])[:, 0]
        # routing vectors: evenly along the distance to the pivot
        by = np.argsort(far, kind="stable")
        routing = points[by[::PAGE]]
        nearest = np.concatenate([space.distance(points[a:a + 4096], routing).argmin(1) for a in range(0, len(points), 4096)])
        order = np.argsort(nearest, kind="stable")
        ids, points, nearest = ids[order], points[order], nearest[order]
        # a crowded routing vector gets several pages
        at = np.arange(len(ids)) - np.searchsorted(nearest, nearest)
        new = np.flatnonzero((at % PAGE) == 0)
        centers = routing[nearest[new]]
        cut = np.append(new, len(ids))
        own = np.sqrt(np.maximum(((points - np.repeat(centers, np.diff(cut), 0)) ** 2).sum(1), 0.0))
        return cls(ids, narrow(points[:, :-1]), points[:, -1].copy(), own, cut, centers, space.distance(centers, pivot[None, :])[:, 0], np.maximum.reduceat(own, new))

    def search(self, space: Space, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, pivot: np.ndarray, k: int):
        """Best k of each query with a score of at least ``bound``: (query row, id, score) arrays."""
        best = Best(bound, k)
        self.improve(space, q_ids, q, best, pivot, np.arange(len(q)))
        return best.hits()

    def improve(self, space: Space, q_ids: np.ndarray, q: np.ndarray, best: Best, pivot: np.ndarray, rows: np.ndarray) -> None:
        """Put into ``best`` what this tree has for the given rows of q."""
        # no sum of products passes the product of the norms: below 2**24 floats hold all of them
        kind = np.float32 if max(1.0, (q * q).sum(1).max(initial=0.0)) * space.top < 2.0 ** 48 else np.float64
        for a in range(0, len(rows), BLOCK):
            self._block(space, q_ids, q, best, pivot, rows[a:a + BLOCK], kind)

    def _block(self, space: Space, q_ids, q, best: Best, pivot, rows, kind) -> None:
        own_q, asked = q[rows], space.ask(q[rows])
        limit = space.reach(own_q, best.bound[rows]) + space.slack
        # stored parent distances first: pages that cannot come near are never measured
        low = np.abs(space.distance(asked, pivot[None, :]) - self.up[None, :]) - self.radius[None, :]
        pages = np.flatnonzero((low <= limit[:, None]).any(0))
        exact = space.distance(asked, self.centers[pages])
        low = np.maximum(low[:, pages], exact - self.radius[pages][None, :])
        order = np.argsort(low.min(0), kind="stable") if len(rows) else np.zeros(0, np.int64)
        given = own_q.astype(kind)
        for a in range(0, len(order), AT_ONCE):
            cols = order[a:a + AT_ONCE]
            need = low[:, cols] <= limit[:, None]
            live, cols = np.flatnonzero(need.any(1)), cols[need.any(0)]
            if not len(live):
                continue
            # entries whose distance to the page's routing vector lets no query of the block come near are left out
            near, far = (exact[live][:, cols] - limit[live][:, None]).min(0), (exact[live][:, cols] + limit[live][:, None]).max(0)
            begin, size = self.cut[pages[cols]], self.cut[pages[cols] + 1] - self.cut[pages[cols]]
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            own = self.own[at]
            at = at[(own >= np.repeat(near, size)) & (own <= np.repeat(far, size))]
            if not len(at):
                continue
            score = given[live] @ self.x[at].astype(kind).T
            if kind is np.float64:
                score = np.rint(score)
            ids, asks = self.ids[at], rows[live]
            least = best.bound[asks]
            hit = score >= least[:, None]
            if np.count_nonzero(hit) > 4 * best.k * len(live) and len(at) > best.k:
                # of these entries only the best k can stay
                score[ids[None, :] == q_ids[asks][:, None]] = -np.inf
                least = np.maximum(least, np.partition(score, len(at) - best.k, 1)[:, len(at) - best.k])
                hit = score >= least[:, None]
            r, c = np.divmod(np.flatnonzero(hit), len(at))
            ok = ids[c] != q_ids[asks[r]]
            r, c = r[ok], c[ok]
            if len(r):
                best.put(asks[r], ids[c], score[r, c].astype(np.float64))
                limit = np.minimum(limit, space.reach(own_q, best.bound[rows]) + space.slack)

    def pack(self) -> bytes:
        import io
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, cell: bytes) -> "Tree":
        import io
        z = np.load(io.BytesIO(cell))
        return cls(*(z[f] for f in cls.FIELDS))


class Index:
    """Pivots, their radii, points and parts (driver side, a row a pivot) and the table of trees, a row a part."""

    def __init__(self, space: Space, pivots: np.ndarray, radius: np.ndarray, counts: np.ndarray, parts: np.ndarray, trees: DataFrame | None):
        self.space, self.pivots, self.radius, self.counts, self.parts, self.trees = space, pivots, radius, counts, parts, trees
        self.first = np.concatenate([[0], np.cumsum(parts)])

    def pivot_of(self, part: int) -> np.ndarray:
        return self.pivots[np.searchsorted(self.first, part, "right") - 1]

    def groups(self, n: int) -> np.ndarray:
        """The group of each part: neighbours with about as many points in each of n groups."""
        size = np.repeat(self.counts / self.parts, self.parts)
        before = np.cumsum(size) - size / 2
        return np.minimum(before * n / max(1, self.counts.sum()), n - 1).astype(np.int64)


def integer_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, v (components floor(scale * x) as packed doubles), norm2, dim; rows that take no part are left out."""
    return in_arrow(pick(vectors, "vec_id", "embedding"), _vectors(scale), "vec_id long, v binary, norm2 double, dim long")


def build_index(points: DataFrame, n_pivots: int = PIVOTS) -> Index | None:
    """Index of :func:`integer_vectors`; None for an empty table."""
    spark = points.sparkSession
    ship_package(spark)
    n, top, dim = points.agg(F.count("*"), F.max("norm2"), F.max("dim")).first()
    if not n:
        return None
    space = Space(max(1, int(dim)), float(top))
    u = F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = points.filter(u < min(1.0, 4.0 * n_pivots / n)).orderBy(u, "vec_id", "v").limit(n_pivots).collect() or points.orderBy("vec_id", "v").limit(1).collect()
    pivots = space.lift(np.unique(matrix([r["v"] for r in sample], space.dim), axis=0))

    def nearest(batches):
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), space.dim)
            d = space.distance(space.lift(x), pivots)
            p = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            x = narrow(x)
            cells = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.itemsize * space.dim).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("hash"), cells, pa.array(p, pa.int32()), pa.array(d[np.arange(len(d)), p])],
                                             ["vec_id", "hash", "v", "pivot", "far"])

    # computed for the counts and again for the parts: cheaper than the room of one more copy
    dealt = in_arrow(points.select("vec_id", "v", F.xxhash64("vec_id", "v").alias("hash")), of_task(nearest), "vec_id long, hash long, v binary, pivot int, far double")
    per = {r[0]: (r[1], r[2]) for r in dealt.groupBy("pivot").agg(F.count("*"), F.max("far")).collect()}  # a row a pivot
    rows = int(np.clip(n // (4 * partitions(spark)), LEAST_PART, MOST_PART))
    counts = np.array([per.get(i, (0, 0.0))[0] for i in range(len(pivots))])
    parts = np.maximum(1, -(-counts // rows))
    index = Index(space, pivots, np.array([per.get(i, (0, -np.inf))[1] for i in range(len(pivots))]), counts, parts, None)
    first, own = (F.array(*[F.lit(int(x)) for x in xs]) for xs in (index.first, parts))
    part = F.element_at(first, F.col("pivot") + 1) + F.pmod("hash", F.element_at(own, F.col("pivot") + 1).cast("long")).cast("int")

    def build(key, table):
        p = key[0].as_py()
        ids, x = table.column("vec_id").to_numpy(), np.zeros((table.num_rows, space.dim))
        cells = table.column("v").to_pylist()
        size = np.array([len(c) for c in cells])
        for kind in (np.int16, np.float64):
            own = np.flatnonzero(size == np.dtype(kind).itemsize * space.dim)
            if len(own):
                x[own] = np.frombuffer(b"".join(cells[i] for i in own), kind).reshape(len(own), space.dim)
        tree = Tree.build(ids, x, space, index.pivot_of(p))
        return pa.table({"part": pa.array([p], pa.int32()), "tree": pa.array([tree.pack()], pa.binary())})

    index.trees = settle(dealt.select("vec_id", "v", part.cast("int").alias("part")).groupBy("part").applyInArrow(build, "part int, tree binary"), "mtree")
    return index


_ASKED = "part int, query_id long, v binary"
_NEAR = "query_id long, v binary, part int, ids array<long>, scores array<double>"
_CELLS = "group int, width int, cell binary"
_FOUND = "query_id long, vec_id long, score double"


def _near(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """Every query with the best k of the part that it asks."""
    plain = Index(index.space, index.pivots, index.radius, index.counts, index.parts, None)

    def run(key, trees, queries):
        schema = pa.schema([("query_id", pa.int64()), ("v", pa.binary()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        if not queries.num_rows:
            return schema.empty_table()
        part = key[0].as_py()
        queries = queries.select(["query_id", "v", "part"])
        ids = queries.column("query_id").to_numpy()
        r, i, s = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if trees.num_rows:
            tree = Tree.unpack(trees.column("tree")[0].as_py())
            r, i, s = tree.search(plain.space, ids, matrix(queries.column("v").to_pylist(), plain.space.dim), np.full(len(ids), -np.inf), plain.pivot_of(part), k)
        ends = pa.array(np.searchsorted(r, np.arange(len(ids) + 1)), pa.int32())
        return queries.append_column("ids", pa.ListArray.from_arrays(ends, pa.array(i, pa.int64()))).append_column("scores", pa.ListArray.from_arrays(ends, pa.array(s, pa.float64()))).cast(schema)
    return index.trees.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(run, _NEAR)


def _dealt(index: Index, group: np.ndarray, k: int):
    """A batch of queries as one cell for each group with a part that may hold something better."""
    space, pivots, radius = index.space, index.pivots, index.radius
    pivot = np.repeat(np.arange(len(index.parts)), index.parts)
    first = [np.unique(pivot[group == g]) for g in range(int(group.max()) + 1)]

    def run(batches):
        for batch in batches:
            ids, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("query_id", "part"))
            q = matrix(batch.column("v").to_pylist(), space.dim)
            full = batch.column("n").to_numpy(zero_copy_only=False) >= k
            low = np.where(full, batch.column("low").fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            limit = np.where(full, space.reach(q, low) + space.slack, np.inf)
            may = (space.distance(space.ask(q), pivots) - radius[None, :] <= limit[:, None]) & np.isfinite(radius)[None, :]
            bound, x = np.where(full, low, -np.inf), narrow(q)
            for g, own in enumerate(first):
                rows = np.flatnonzero(may[:, own].any(1))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([x.itemsize], pa.int32()), pa.array([pack(ids[rows], home[rows].astype(np.int32), bound[rows], x[rows])], pa.binary())],
                                                     ["group", "width", "cell"])
    return run


def _far(index: Index, known: DataFrame, n_groups: int, k: int) -> DataFrame:
    """The best k that each group of trees has for a query outside the part it asked, as far as they may matter."""
    spark = known.sparkSession
    plain = Index(index.space, index.pivots, index.radius, index.counts, index.parts, None)
    space, group = plain.space, plain.groups(n_groups)

    def run(trees, queries):
        out, kinds = [], {2: np.int16, 8: np.float64}
        grown = [(p, Tree.unpack(c)) for p, c in sorted(zip(trees.column("part").to_pylist(), trees.column("tree").to_pylist()))] if queries.num_rows else []
        for width, cell in zip(queries.column("width").to_pylist(), queries.column("cell").to_pylist()):
            ids, home, bound, x = unpack(cell, np.int64, np.int32, np.float64, f"V{width * space.dim}")
            q = x.view(kinds[width]).reshape(len(ids), space.dim).astype(np.float64)
            best = Best(bound, k)
            for part, tree in grown:
                tree.improve(space, ids, q, best, plain.pivot_of(part), np.flatnonzero(home != part))
            r, i, s = best.hits()
            out.append(pa.table({"query_id": pa.array(ids[r], pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())}))
        return pa.concat_tables(out) if out else pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]).empty_table()

    of_part = spark.createDataFrame([(p, int(g)) for p, g in enumerate(group)], "part int, group int")
    trees = index.trees.join(F.broadcast(of_part), "part").select("group", "part", "tree")
    cells = in_arrow(known, of_task(_dealt(plain, group, k)), _CELLS)
    return trees.groupBy("group").cogroup(cells.groupBy("group")).applyInArrow(of_cogroup(run), _FOUND)


def top_k(points: DataFrame, queries: DataFrame, k: int = K, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``points`` for every row of ``queries`` (both as :func:`integer_vectors` gives them)."""
    spark = points.sparkSession
    index = build_index(points, n_pivots)
    empty = "query_id long, rank int, vec_id long, score long"
    if index is None:
        return spark.createDataFrame([], empty)
    space, pivots, parts, first = index.space, index.pivots, index.parts, index.first

    def start(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            q = matrix(batch.column("v").to_pylist(), space.dim)
            p = space.distance(space.ask(q), pivots).argmin(1) if len(q) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((first[p] + ids % parts[p]).astype(np.int32)), batch.column("vec_id"), batch.column("v")], ["part", "query_id", "v"])

    near = settle(_near(index, in_arrow(queries.select("vec_id", "v"), start, _ASKED), k), "mtree")
    # a row a query: its first part and, where that gave k hits, the least of their scores
    known = near.groupBy("query_id", "v", "part").agg(F.sum(F.size("ids")).alias("n"), F.min(F.array_min("scores")).alias("low"))
    n_groups = min(int(parts.sum()), partitions(spark), max(LEAST_GROUPS, WEIGHT * int(index.counts.sum()) // max(1, near.count())))
    far = _far(index, known, n_groups, k)
    hits = near.select("query_id", F.inline(F.arrays_zip("ids", "scores")).alias("vec_id", "score")).unionByName(far)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
