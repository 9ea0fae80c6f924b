"""Impact propagation: literal cases, a plain model on random graphs, invariants."""

import random
from collections import deque

import pytest

from tremor.operators import traversal

EDGES = [("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("e", "a"), ("f", "e"), ("g", "x"), ("c", "x")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(s, d, i) for i, (s, d) in enumerate(pairs)], "src string, dst string, ord long")


def roots_of(spark, rows):
    return spark.createDataFrame([(s, m, i) for i, (s, m) in enumerate(rows)], "symbol_id string, mode string, ord long")


def impact(spark, pairs, rows):
    got = traversal.propagate(edges_of(spark, pairs), roots_of(spark, rows)).collect()
    return {r.symbol_id: (r.depth, r.role) for r in got}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", "deep")], {"b": 1, "e": 1, "c": 2, "f": 2, "d": 3}),
        ([("a", "shallow")], {"b": 1, "e": 1}),
        ([("a", "deep"), ("b", "deep")], {"c": 1, "e": 1, "d": 2, "f": 2}),
        ([("a", "deep"), ("x", "shallow")], {"b": 1, "e": 1, "g": 1, "c": 2, "f": 2, "d": 3}),
        ([("x", "shallow"), ("g", "deep")], {"c": 1}),
        ([], {}),
    ],
)
def test_literal_cases(spark, rows, want):
    got = impact(spark, EDGES, rows)
    assert {k: d for k, (d, _) in got.items()} == want
    assert all((role == "direct") == (d == 1) for d, role in got.values())


def test_two_roots_give_two_paths(spark):
    got = traversal.explain(edges_of(spark, EDGES), roots_of(spark, [("a", "deep"), ("b", "deep")]))
    by = {r.symbol_id: r.paths for r in traversal.paths_by_symbol(got).collect()}
    assert by["c"] == [["a", "b", "c"], ["b", "c"]]


def model(pairs, rows):
    """Breadth-first search by queue, one deep root after the other; edges in their order."""
    back = {}
    for s, d in pairs:
        back.setdefault(d, [])
        if s not in back[d]:
            back[d].append(s)
    names = {s for s, _ in rows}
    depth, paths = {}, {}
    for root in dict.fromkeys(s for s, m in rows if m == "deep"):
        seen, todo = {root: [root]}, deque([root])
        while todo:
            n = todo.popleft()
            for s in back.get(n, []):
                if s not in seen:
                    seen[s] = [*seen[n], s]
                    todo.append(s)
        for n, p in seen.items():
            depth[n] = min(depth.get(n, 1 << 30), len(p) - 1)
            if n not in names:
                paths.setdefault(n, []).append(p)
    near = {}
    deep_roots = {s for s, m in rows if m == "deep"}
    for root in dict.fromkeys(s for s, m in rows if m == "shallow" and s not in deep_roots):
        for s in back.get(root, []):
            if s not in names and s not in depth and s not in near:
                near[s] = [root, s]
    out = {n: d for n, d in depth.items() if n not in names} | dict.fromkeys(near, 1)
    return out, paths | {n: [p] for n, p in near.items()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_match_the_model(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    pairs = list(dict.fromkeys((r.choice(nodes), r.choice(nodes)) for _ in range(26)))
    pairs = [(s, d) for s, d in pairs if s != d]
    rows = [(n, r.choice(["deep", "shallow"])) for n in r.sample(nodes, 4)]
    depth, paths = model(pairs, rows)
    assert {k: d for k, (d, _) in impact(spark, pairs, rows).items()} == depth
    got = traversal.explain(edges_of(spark, pairs), roots_of(spark, rows))
    assert {x.symbol_id: x.paths for x in traversal.paths_by_symbol(got).collect()} == paths
    reach = traversal.reach_by_root(edges_of(spark, pairs), roots_of(spark, rows)).collect()
    assert sorted((x.symbol_id, x.root_id, x.depth) for x in reach) == sorted((n, p[0], len(p) - 1) for n, ps in paths.items() for p in ps)


def test_it_never_stops_early_in_silence(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(6)]
    with pytest.raises(RuntimeError):
        traversal.propagate(edges_of(spark, chain), roots_of(spark, [("n0", "deep")]), most=3).collect()


def test_hubs_are_dealt_in_slices(spark, monkeypatch):
    rows = [("h", "deep"), ("z", "deep"), ("k", "shallow")]
    pairs = [(f"n{i}", "h") for i in range(40)] + [(f"m{i}", f"n{i % 3}") for i in range(30)] + [(f"s{i}", "k") for i in range(20)] + [("h", "m1"), ("k", "z")]
    plain = impact(spark, pairs, rows)
    paths = {tuple(r.path) for r in traversal.explain(edges_of(spark, pairs), roots_of(spark, rows)).collect()}
    by_root = {tuple(r) for r in traversal.reach_by_root(edges_of(spark, pairs), roots_of(spark, rows)).collect()}
    monkeypatch.setattr(traversal, "HUB", 4)
    assert traversal._Edges(edges_of(spark, pairs)).sliced
    assert impact(spark, pairs, rows) == plain and len(plain) > 80
    assert {tuple(r.path) for r in traversal.explain(edges_of(spark, pairs), roots_of(spark, rows)).collect()} == paths
    assert {tuple(r) for r in traversal.reach_by_root(edges_of(spark, pairs), roots_of(spark, rows)).collect()} == by_root
