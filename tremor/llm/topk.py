"""Exact top-k by inner product with a dual-tree search over cover trees.

Data and queries are cut into blocks; each block is indexed once.  A cover tree's node is a centre, the largest distance
from it to the node's points (its covering radius) and a range of points.  A node's children have centres that are
further apart than half its radius, each the point farthest from those before it, until all points are covered within
that (or ``FANOUT`` centres stand; a child that is still wide is cut again).  A task walks the trees of a query block and a
data block together: a pair of nodes is left out when no inner product between their points can reach the worst k-th
score in the query node,

    <q, p>  <=  <cq, cp> + Rq |cp| + Rp |cq| + Rq Rp,

and pairs are taken in the order of that bound.

Rows are dealt to blocks by the nearest of a few pivots (the rows of the smallest hashes, ``PIVOTS`` at most), so that a
block is a neighbourhood; a pivot with many rows has several blocks.  A query block first meets the data block of the
best bound between their roots.  The k-th scores that this gives go with it to the others, and pairs of blocks whose
bound is below the worst of them are dropped before their trees are sent anywhere.  The k best of each query and block
are merged by a window.

The result is exact: ties go to the smaller id, and a pair whose bound equals the k-th score is still looked at.
Components are integers, floor(scale * x), so scores are exact as long as they are below 2**53.

Vectors that are null, empty or hold null or non-finite components, and rows without id, take no part; zero vectors do.
A query meets every row with another id (rows that repeat the query's id are its own); repeated rows are candidates of
their own.  Vectors of different lengths are not compared.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import blocks as B

#: Rows of a data block and of a query block.
DATA, QUERIES, LEAF, FANOUT = 8192, 2048, 48, 96
#: Rows that blocks gather around.
PIVOTS = 256


class Tree:
    """points (in tree order), ids; arrays of nodes: centre, radius, range [lo, hi) and children (empty: a leaf)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(points))
        self.points, self.ids = points.astype(np.float64), ids
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.range: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow(0, len(points), self.points.mean(axis=0).round() if len(points) else None)
        self.points, self.ids = self.points[self.order], ids[self.order]
        self.centre = np.array(self.centre)
        self.norm = np.linalg.norm(self.centre, axis=1)
        self.radius = np.array(self.radius)

    def _node(self, lo: int, hi: int, centre: np.ndarray) -> int:
        far = np.linalg.norm(self.points[self.order[lo:hi]] - centre, axis=1)
        self.centre.append(centre)
        self.radius.append(float(far.max()) if len(far) else 0.0)
        self.range.append((lo, hi))
        self.children.append([])
        return len(self.radius) - 1

    def _grow(self, lo: int, hi: int, centre: np.ndarray) -> None:
        """Cut nodes into children, with a stack in place of recursion."""
        if hi == lo:
            return
        todo = [self._node(lo, hi, centre)]
        while todo:
            k = todo.pop()
            lo, hi = self.range[k]
            if hi - lo <= LEAF or self.radius[k] == 0:
                continue
            own = self.order[lo:hi].copy()
            x = self.points[own]
            near = np.linalg.norm(x - self.centre[k], axis=1)
            of, reach, centres = np.full(len(own), -1), self.radius[k] / 2, []
            first = int(near.argmin())
            best = np.full(len(own), np.inf)
            while True:  # the point farthest from all centres is the next one, until all are covered
                d = np.linalg.norm(x - x[first], axis=1)
                of[d < best] = len(centres)
                best = np.minimum(best, d)
                centres.append(x[first])
                first = int(best.argmax())
                if best[first] <= reach or len(centres) >= FANOUT:
                    break
            size = np.bincount(of, minlength=len(centres))
            # children of few points go together under the parent's centre, so that no leaf is tiny
            few = np.flatnonzero(size <= LEAF // 4)
            big = [c for c in np.argsort(-size).tolist() if size[c] > LEAF // 4]
            sets = [(np.flatnonzero(of == c), centres[c]) for c in big]
            rest = np.flatnonzero(np.isin(of, few))
            if len(rest) == len(own):  # nothing gathers: leaves in order of distance
                rest = rest[np.argsort(near)]
            sets += [(part, self.centre[k]) for part in np.array_split(rest, -(-len(rest) // LEAF))] if len(rest) else []
            if len(sets) == 1 and len(sets[0][0]) == len(own):
                sets = [(part, sets[0][1]) for part in np.array_split(sets[0][0], 2)]
            at = lo
            for part, c in sets:
                self.order[at : at + len(part)] = own[part]
                child = self._node(at, at + len(part), c)
                self.children[k].append(child)
                at += len(part)
            todo += self.children[k]


def search(q: Tree, p: Tree, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query (in q's order) the k best scores, highest first, and their ids; -inf and -1 where there are fewer.

    floor: scores (in q's order) below which nothing need be found.
    """
    n = len(q.ids)
    score, ids = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    least = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)  # the k-th score, or the floor
    if not n or not len(p.ids):
        return score, ids

    def bounds(a: list[int], b: list[int]) -> np.ndarray:
        rq, rp = q.radius[a][:, None], p.radius[b][None]
        return q.centre[a] @ p.centre[b].T + rq * p.norm[b][None] + rp * q.norm[a][:, None] + rq * rp

    def slack(x: float) -> float:
        return x + 1e-9 * abs(x) + 1e-6

    stack = [(float(bounds([0], [0])[0, 0]), 0, 0)]
    while stack:
        bound, a, b = stack.pop()
        lo, hi = q.range[a]
        if slack(bound) < least[lo:hi].min():
            continue
        ca, cb = q.children[a], p.children[b]
        if not ca and not cb:
            s, e = p.range[b]
            new = q.points[lo:hi] @ p.points[s:e].T
            new[q.ids[lo:hi][:, None] == p.ids[s:e][None]] = -np.inf
            rows = np.flatnonzero((np.isfinite(new) & (new >= least[lo:hi, None])).any(axis=1))
            if len(rows):
                both = np.concatenate([score[lo + rows], new[rows]], axis=1)
                name = np.concatenate([ids[lo + rows], np.broadcast_to(p.ids[s:e], (len(rows), e - s))], axis=1)
                top = np.lexsort((name, -both), axis=1)[:, :k]
                score[lo + rows], ids[lo + rows] = np.take_along_axis(both, top, 1), np.take_along_axis(name, top, 1)
                least[lo + rows] = np.maximum(least[lo + rows], score[lo + rows, -1])
            continue
        left = ca if ca and (not cb or q.radius[a] > p.radius[b]) else [a]
        right = cb if left == [a] else [b]
        u = bounds(left, right)
        worst = np.array([least[slice(*q.range[x])].min() for x in left])
        ok = u + 1e-9 * np.abs(u) + 1e-6 >= worst[:, None]
        for flat in np.argsort(u, axis=None):  # the best bound comes to the top of the stack
            x, y = divmod(int(flat), len(right))
            if ok[x, y]:
                stack.append((float(u[x, y]), left[x], right[y]))
    ids[np.isneginf(score)] = -1
    return score, ids


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def _indexed(table: pa.Table) -> pa.Table:
    v = table["vector"].combine_chunks()
    ids, size = table["id"].to_numpy(), np.array(v.value_lengths())
    order = np.argsort(ids, kind="stable")  # rows arrive in any order; the tree shall not depend on it
    x = np.array(v.flatten()).reshape(len(ids), -1)
    assert (size == x.shape[1]).all()
    tree = Tree(x[order], ids[order])
    root = [pa.array([tree.centre[0].tolist()], pa.list_(pa.float64())), pa.array([float(tree.radius[0])]), pa.array([float(tree.norm[0])])]
    return pa.table([table["block"][:1], pa.array([int(size[0])], pa.int32()), pa.array([B.press(pickle.dumps(tree))], pa.binary()), *root], ["block", "dims", "tree", "centre", "radius", "norm"])


def _around(rows: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """rows with the number of the nearest pivot of their length (0, if there is none)."""
    of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(p) for p in pivots}:
        own = [k for k, p in enumerate(pivots) if len(p) == size]
        of[size] = np.array(own), np.array([pivots[k] for k in own], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["vector"]
            size, flat = np.array(v.value_lengths()), np.array(v.flatten())
            at, out = np.cumsum(size) - size, np.zeros(len(v), np.int32)
            for d in np.unique(size).tolist():
                on = np.flatnonzero(size == d)
                if d in of:
                    own, p = of[d]
                    for lo in range(0, len(on), 4096):
                        part = on[lo : lo + 4096]
                        x = flat[at[part][:, None] + np.arange(d)].astype(np.float64)
                        out[part] = own[((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)]
            yield pa.record_batch([batch["id"], v, pa.array(out)], ["id", "vector", "pivot"])

    return rows.select("id", "vector").mapInArrow(nearest, "id long, vector array<long>, pivot int")


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """An index for each block: ``name``, dims, tree and the root's centre, radius and norm. rows: id, vector, pivot.

    The rows around a pivot are dealt by a hash of the row to as many blocks as they need, so equal ids can't crowd one.
    """
    many = F.broadcast(rows.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(most)).alias("parts")))  # PIVOTS rows at most
    dealt = rows.withColumn("dims", F.size("vector")).join(many, "pivot")
    block = (F.col("dims").cast("long") * F.lit(PIVOTS) + F.col("pivot")) * F.lit(1 << 32) + F.pmod(F.xxhash64("id", "vector"), "parts")
    schema = "block long, dims int, tree binary, centre array<double>, radius double, norm double"
    return B.stored(dealt.select(block.alias("block"), "id", "vector").groupBy("block").applyInArrow(_indexed, schema)).withColumnRenamed("block", name)


HITS = "query_id long, vec_id long, score long"


def _hits(q: Tree, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.isfinite(score))
    return q.ids[i], ids[i, j], score[i, j].astype(np.int64)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Tree, Tree]]:
    for k, (a, b) in enumerate(zip(batch["asked"], batch["tree"], strict=True)):
        yield k, *(pickle.loads(B.unpress(t.as_py())) for t in (a, b))


def searched(rows: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits (query_id, vec_id, score), all pairs of blocks (q, d, bound), and those that were looked at after the first of
    each query block."""
    B.small_batches(rows.sparkSession)
    shards = B.shards(rows.sparkSession, 1)
    n = rows.count()
    pivots = rows.orderBy(F.xxhash64("id", "vector"), "id", "vector").limit(min(PIVOTS, max(1, 2 * n // DATA))).collect()
    near = _around(rows, [r.vector for r in pivots])
    data = _blocks(near, DATA, "d")
    asked = _blocks(near.filter(F.col("id") % every == 0).dropDuplicates(["id", "vector"]), QUERIES, "q")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, q, p in _opened(batch):
                score, ids = search(q, p, k)
                floor = score[:, -1]
                hits = [pa.array([x], pa.list_(pa.int64())) for x in _hits(q, score, ids)]
                yield pa.record_batch([batch["q"].slice(at, 1), pa.array([float(floor.min())]), pa.array([B.press(floor)], pa.binary()), *hits], ["q", "low", "floor", "query_id", "vec_id", "score"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, q, p in _opened(batch):
                found = _hits(q, *search(q, p, k, B.unpress(batch["floor"][at].as_py(), np.float64)))
                yield pa.record_batch([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    trees = lambda pairs: pairs.join(asked.select("q", F.col("tree").alias("asked")), "q").join(data.select("d", "tree"), "d")
    roots = asked.select("q", "dims", F.col("centre").alias("qc"), F.col("radius").alias("qr"), F.col("norm").alias("qn")).join(data.select("d", "dims", "centre", "radius", "norm"), "dims")
    dot = F.aggregate(F.zip_with("qc", "centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    bound = dot + F.col("qr") * F.col("norm") + F.col("radius") * F.col("qn") + F.col("qr") * F.col("radius")
    pairs = B.stored(roots.select("q", "d", bound.alias("bound")))
    best = pairs.groupBy("q").agg(F.max_by("d", F.struct("bound", "d")).alias("d"))
    lists = "array<long>"
    begun = B.stored(trees(best).repartition(shards, "q").select("q", "asked", "tree").mapInArrow(first, f"q long, low double, floor binary, query_id {lists}, vec_id {lists}, score {lists}"))
    hits = begun.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("h")).select("h.query_id", "h.vec_id", "h.score")
    slack = F.abs("bound") * 1e-9 + 1e-6
    left = pairs.join(best, ["q", "d"], "left_anti").join(begun.select("q", "low", "floor"), "q").filter(F.col("bound") + slack >= F.col("low")).select("q", "d", "floor")
    more = trees(left).repartition(shards, "q", "d").select("asked", "tree", "floor").mapInArrow(rest, HITS)
    return hits.union(more), pairs, left


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best for each row whose id is divisible by ``every``."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = B.stored(x.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("vector")))
    best, _, _ = searched(rows, k, every)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same for the table ``embeddings`` in DuckDB.
ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 50 = 0) q JOIN e p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v)
),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
