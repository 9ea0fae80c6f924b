"""Exact top-k and cap filters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm import caps, topk
from tremor.llm.components import components


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (0, [0.0, 0.0]), (5, [float("nan"), 1.0]), (100, []), (150, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (8, [-1.0, 2.0]), (9, [float("inf"), 1.0]), (10, [None, 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("block", "node", "id", "filter", "vector")})


def brute_top(rows, k=5):
    rows = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)): (i, v) for i, v in rows if i % 50 == 0}.values():
        found = sorted((-int(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("table", ["vectors", "odd"])
def test_top_k(spark, table, request):
    df = request.getfixturevalue(table)
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert got == brute_top([(r.vec_id, r.embedding) for r in df.collect()])
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_over_many_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "DATA", 60)
    monkeypatch.setattr(topk, "QUERIES", 4)
    got = sorted(tuple(r) for r in topk.top_k(vectors).collect())
    assert got == brute_top([(r.vec_id, r.embedding) for r in vectors.collect()])


@pytest.mark.parametrize("kind", ["grid", "line", "same", "clusters"])
def test_trees_search_exactly(kind):
    r = np.random.default_rng(3)
    x = {"grid": r.integers(-3, 4, (900, 4)), "line": np.outer(np.arange(900), [1, 2, 3]), "same": np.ones((900, 3), int), "clusters": r.integers(-200, 200, (9, 8))[r.integers(0, 9, 900)] + r.integers(-2, 3, (900, 8))}[kind].astype(float)
    ids = r.permutation(900)
    q, p = topk.Tree(x[:70], ids[:70]), topk.Tree(x, ids)
    score, found = topk.search(q, p, 5)
    for k, i in enumerate(q.ids):
        want = sorted((-int(q.points[k] @ v), j) for v, j in zip(x, ids) if j != i)[:5]
        assert list(zip((-score[k]).astype(int).tolist(), found[k].tolist())) == want
    assert sorted(p.ids.tolist()) == list(range(900))


def brute_links(rows, threshold=0.9):
    n, link = len(rows), {k: set() for k in range(len(rows))}
    good = lambda i, v: i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for a in range(n):
        for b in range(a):
            (i, v), (j, w) = rows[a], rows[b]
            if good(i, v) and good(j, w) and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                    link[a].add(b)
                    link[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[k][0] for k in seen), default=None) if rows[a][0] is not None else None
        out.append((rows[a][0], len(link[a]), least, least is not None and least == rows[a][0]))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_far_blocks_are_not_looked_at(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    r = np.random.default_rng(12)
    way = r.standard_normal((12, 24))
    way *= 4000 / np.linalg.norm(way, axis=1, keepdims=True)
    x = np.floor(way[np.arange(1500) % 12] + r.standard_normal((1500, 24)) * 60).astype(np.int64)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<long>")
    hits, pairs, left = topk.searched(rows, 5, 20)
    assert left.count() < pairs.count() // 2  # of pairs of blocks beside the first of each query block
    got = {}
    for h in hits.collect():
        got.setdefault(h.query_id, set()).add((-h.score, h.vec_id))
    for q in range(0, 1500, 20):
        score = x @ x[q]
        want = sorted((-int(s), k) for k, s in enumerate(score.tolist()) if k != q)[:5]
        assert sorted(got[q])[:5] == want


def test_cap_filters_on_odd_rows(spark, odd):
    got = sorted((tuple(r) for r in caps.near_duplicates(odd).collect()), key=key)
    assert got == sorted(brute_links([(r.vec_id, r.embedding) for r in odd.collect()]), key=key)
    assert caps.near_duplicates(odd.limit(0)).collect() == []


def test_cap_filters_on_groups(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = []
    for k, size in enumerate([1, 2, 5, 40, 120]):
        c = r.standard_normal(64)
        rows += [c / np.linalg.norm(c) + r.standard_normal(64) * s / 8 for s in r.choice([0.1, 0.25, 0.33], size)]
    rows += rows[:3] + list(r.standard_normal((60, 64)))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    monkeypatch.setattr(caps, "LARGE", 16)  # large filters are dealt by pairs of blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = sorted(tuple(x) for x in caps.near_duplicates(df).collect()), sorted(brute_links(rows))
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert 0.995 * there <= found <= there
    assert all(a[1] <= b[1] for a, b in zip(got, want))


@pytest.mark.parametrize("n", [1000, 100_000, 1_000_000])
def test_recall_at_the_threshold(n):
    r = np.random.default_rng(9)
    x = r.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((400, 64))
    y -= x * (x * y).sum(axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    lists = []
    for v in (x, y):
        row, code = caps.decode(v, caps.plan(n))
        lists.append([set(code[row == k].tolist()) for k in range(400)])
    assert np.mean([bool(a & b) for a, b in zip(*lists)]) >= 0.97


@pytest.mark.parametrize("n", [1000, 29_127, 29_128, 1_000_000])
def test_recall_on_both_sides_of_a_change_of_plan(n):
    assert (caps.plan(29_127).words, caps.plan(29_128).words) == (1024, 2048)
    r = np.random.default_rng(1)
    x, y = r.standard_normal((2, 800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * (x * y).sum(axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = (set(zip(*map(np.ndarray.tolist, caps.decode(v, caps.plan(n))))) for v in (x, y))
    assert len({row for row, _ in a & b}) >= 0.98 * len(x)


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(i, 99) for i in range(50)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up
