"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a random direction and stands for the cap of vectors whose projection on it exceeds a threshold.  Directions
are products: after a random rotation (signs and Hadamard steps) the space is cut into two halves, each with a random
codebook, and every pair of codewords is a filter; several rotations give independent families.  The filters that a
vector exceeds are listed from the two lists of half scores without trying all pairs (list decoding).

Equal vectors are collapsed first.  Vectors that share a filter are compared in double precision; a pair is counted in
the smallest filter that both exceed and nowhere else, so nothing is counted twice and no pair is sent out: a group
sends each member's number of links and a spanning forest.  A filter with the same members as a smaller one is left out.
A filter with many vectors is dealt to several tasks by pairs of member blocks.

Codebooks grow with the square root of the number of vectors, and thresholds with them, so that the vectors that share a
filter by chance stay few for each vector.  A pair at cosine 0.9 exactly shares a filter with probability 0.98 to 1 for
codebooks of 1024 to 32768 words, at 0.92 and above practically always (64 dimensions; measured in tests).  No link
below the threshold is ever reported.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, link with nothing and are
their own component (null for a null id).  Vectors of different lengths don't link.  Rows with equal ids are rows of
their own.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B
from .components import components
from .hashing import mix

#: Members of a filter that are compared in one task; a larger filter is cut into blocks of about this size.
LARGE = 1024


class Plan(NamedTuple):
    """Words of a codebook, families, and the threshold in standard deviations of a random projection."""

    words: int = 1024
    families: int = 6
    sigmas: float = 4.0


DEFAULT = Plan()


def plan(n: int) -> Plan:
    """Parameters for n vectors."""
    words = max(1024, 1 << (math.ceil(6 * math.sqrt(n)) - 1).bit_length())
    exceed = 33 * (words / 1024) ** 0.6  # filters of a family that a vector exceeds, were projections normal
    return Plan(words, 6 if words == 1024 else 8, NormalDist().inv_cdf(1 - exceed / words**2))


@lru_cache(maxsize=4)
def codes(dims: int, words: int, families: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Signs and two codebooks for each family; dims: a power of two."""
    out = []
    for k in range(families):
        r = np.random.default_rng(1000 * dims + k)
        signs = r.choice([-1.0, 1.0], (3, dims))
        books = []
        for n in (dims // 2, dims - dims // 2):
            c = r.standard_normal((words, n))
            books.append(c / (np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(2)))
        out.append((signs, *books))
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows, of unit scale."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def decode(x: np.ndarray, own: Plan = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """All (row, filter) with the filter exceeded; x: vectors of one length, not zero."""
    n, d = x.shape
    dims = max(64, 1 << (d - 1).bit_length())  # a short vector stands in a random subspace
    unit = np.zeros((n, dims))
    unit[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    t = own.sigmas / np.sqrt(dims)
    rows, found = [], []
    for k, (signs, left, right) in enumerate(codes(dims, own.words, own.families)):
        y = unit
        for s in signs:
            y = hadamard(y * s)
        a, b = y[:, : dims // 2] @ left.T, y[:, dims // 2 :] @ right.T
        ra, ia = np.nonzero(a >= (t - b.max(axis=1))[:, None])
        rb, ib = np.nonzero(b >= (t - a.max(axis=1))[:, None])
        first = np.searchsorted(rb, np.arange(n + 1))
        count = np.diff(first)[ra]  # partners of each left word
        one = np.repeat(np.arange(len(ra)), count)
        two = np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[ra], count)
        on = a[ra[one], ia[one]] + b[rb[two], ib[two]] >= t
        one, two = one[on], two[on]
        rows.append(ra[one])
        found.append(((d * own.families + k) * own.words + ia[one]) * own.words + ib[two])
    row, code = np.concatenate(rows), np.concatenate(found)
    # spread over the longs, so that ranges and the order of filters say nothing about families
    code = mix(code.astype(np.uint64)).view(np.int64)
    order = np.lexsort((code, row))
    return row[order], code[order]


def usable(vector: Column) -> Column:
    """True for vectors with components that are all finite and not all zero."""
    x = lambda f: F.exists(vector, f)
    bad = x(lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & x(lambda v: v != 0), F.lit(False))


def _listed(batches: Iterator[pa.RecordBatch], params: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(16, (1 << 20) // params.words)  # a step's scores against a codebook stay within 8 MB
        for lo in range(0, batch.num_rows, step):
            b = batch.slice(lo, step)
            size = np.array(b["vector"].value_lengths().to_pylist(), np.int64)
            flat, at = b["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(size)])
            lists: list[np.ndarray] = [None] * b.num_rows
            raw: list[bytes] = [b""] * b.num_rows
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                x = flat[(at[own][:, None] + np.arange(d))]
                x = x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))  # exact; squares stay finite
                row, code = decode(x, params)
                for i, v in zip(own.tolist(), x, strict=True):
                    raw[i] = v.tobytes()
                for i, c in zip(own.tolist(), np.split(code, np.searchsorted(row, np.arange(1, len(own)))), strict=True):
                    lists[i] = c
            yield pa.record_batch([b["node"], b["rep"], b["size"], pa.array(raw, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["node", "rep", "size", "raw", "filters"])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs over n members: (member, root)."""
    up = np.arange(n)
    while True:
        m = up.copy()
        np.minimum.at(m, i, up[j])
        np.minimum.at(m, j, up[i])
        m = np.minimum(m, m[m])
        if (m == up).all():
            return [(k, r) for k, r in enumerate(up.tolist()) if k != r]
        up = m


class Runs:
    """Rows of sorted batches as whole runs of equal keys, over batch borders; a part holds many small runs."""

    def __init__(self, batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 4096):
        self.batches, self.key, self.rows = batches, key, rows

    def __iter__(self) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Tables, and the first row of each of their runs with the number of rows at the end."""
        held: list[pa.RecordBatch] = []
        for batch in self.batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= self.rows:
                table = pa.Table.from_batches(held).combine_chunks()
                heads = self._heads(table)
                if len(heads) > 1:
                    last = int(heads[-1])
                    yield table.slice(0, last), heads
                    held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, np.append(self._heads(table), table.num_rows)

    def _heads(self, table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in self.key:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)


def meet(n: int, member: np.ndarray, column: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """How many columns each two of n members share (float32, exact); slices of columns of at most ``most`` cells."""
    both, width = np.zeros((n, n), np.float32), max(1, most // n)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        has = np.zeros((n, width), np.float32)
        has[member[a:b], column[a:b] - lo] = 1
        both += has @ has.T
    return both


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for table, heads in Runs(batches, ["filter", "i", "j"]):
        out: list[tuple[int, int | None, int]] = []
        node, size, f = (table[c].to_numpy() for c in ("node", "size", "filter"))
        own = table["own"].to_numpy()
        i_of, j_of = table["i"].to_numpy(), table["j"].to_numpy()
        raw = table["raw"].combine_chunks()
        lists = table["filters"].combine_chunks()
        for lo, hi in zip(heads.tolist(), heads[1:].tolist()):
            n = hi - lo
            if n < 2:
                continue
            vec = [np.frombuffer(raw[k].as_py(), np.float64) for k in range(lo, hi)]
            if len({len(v) for v in vec}) > 1:  # a filter belongs to one length but for chance
                continue
            v = np.stack(vec)
            norm = np.sqrt((v * v).sum(axis=1))
            near = (v @ v.T) / (norm[:, None] * norm) >= threshold
            near &= np.triu(np.ones((n, n), bool), 1)
            if i_of[lo] != j_of[lo]:
                near &= own[lo:hi][:, None] != own[lo:hi]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            first = f[lo]
            filters = [lists[k].values.to_numpy() for k in range(lo, hi)]
            low = [x[x < first] for x in filters]
            if n <= 6:
                sets = [set(x.tolist()) for x in low]
                keep = np.array([not (sets[x] & sets[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            else:
                _, which = np.unique(np.concatenate(low), return_inverse=True)
                member = np.repeat(np.arange(n), [len(x) for x in low])
                shared = np.bincount(which) > 1 if len(which) else np.zeros(0, bool)
                column = np.cumsum(shared) - 1
                on = shared[which] if len(which) else np.zeros(0, bool)
                keep = meet(n, member[on], column[which[on]])[a, b] == 0
            a, b = a[keep], b[keep]
            w = np.bincount(a, size[lo:hi][b], n) + np.bincount(b, size[lo:hi][a], n)
            out += [(int(node[lo + k]), None, int(w[k])) for k in np.flatnonzero(w).tolist()]
            out += [(int(node[lo + x]), int(node[lo + y]), 0) for x, y in forest(n, a, b)]
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "links"])
        B.trim()


def kept_groups(light: DataFrame, key: str, node: str, weight: str | None = None) -> DataFrame:
    """Groups with two nodes or more; of groups with the same nodes only the one with the smallest key.

    Columns: key, n (nodes) and total (sum of the members' weights; n without weight).
    """
    total = F.sum(weight) if weight else F.count("*")
    groups = light.groupBy(key).agg(F.count("*").alias("n"), total.alias("total"), F.expr(f"bit_xor(xxhash64({node}))").alias("p1"), F.expr(f"bit_xor(xxhash64(1, {node}))").alias("p2")).filter("n > 1")
    return groups.groupBy("n", "total", "p1", "p2").agg(F.min(key).alias(key)).select(key, "n", "total")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """A row for each input row: id, n_links, component_id (smallest id reachable), kept (id is component_id)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("node", F.when(F.col("id").isNotNull() & usable(F.col("vector")), F.xxhash64(F.transform("vector", lambda v: v + F.lit(0.0)))))
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    params = plan(rows.count())
    nodes = B.stored(classes.mapInArrow(lambda it: _listed(it, params), "node long, rep long, size long, raw binary, filters array<long>"))
    light = nodes.select(F.explode("filters").alias("filter"), "node")
    members = light.join(kept_groups(light, "filter", "node"), "filter").join(nodes.select("node", "size", "raw", "filters"), "node")
    # A filter with up to LARGE members is one task's (0, 0); the members of a larger one go to all pairs with their block.
    k = F.ceil(F.col("n") / F.lit(LARGE)).cast("int")
    wide = members.withColumn("own", F.pmod(F.xxhash64(F.lit(17), "node"), k).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    spread = wide.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    dealt = spread.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    found = B.stored(dealt.mapInArrow(lambda it: _verified(it, threshold), "a long, b long, links long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("b is not null").select("a", "b"))
    least = parts.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    of = parts.join(least, "root").select("node", "least")
    each = nodes.select("node", "rep", "size").join(links, "node", "left").join(of, "node", "left")
    facts = each.select("node", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("least", "rep").alias("component"))
    out = rows.select("id", "node").join(facts, "node", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
