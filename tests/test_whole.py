"""Queries over whole tables against plain Python."""

import re

import pytest

from test_oracles import SF, duck  # noqa: F401  duck is a fixture
from test_traversal import model
from tremor.functions import text as X
from tremor.plans import graph_queries as G, intent_queries as I, registry
from tremor.sources.workspaces import Workspace


def tokens(x):
    spaced = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", x))
    return {t for t in re.split("[^a-z0-9]+", spaced.lower()) if t and (len(x) <= 4 or len(t) > 2)}


def overlap(a, b):
    ta, tb = tokens(a), tokens(b)
    return 1.0 if a == b else len(ta & tb) / len(ta | tb) if ta and tb else 0.0


def by_name(hint, name):
    h, n = hint.lower(), name.lower()
    if h == n:
        return 1.0
    if h in n or n in h:
        ratio = min(len(h), len(n)) / max(len(h), len(n))
        return 0.5 + 0.3 * ratio if ratio >= 0.4 else 0.0
    return 0.9 * overlap(hint, name) if overlap(hint, name) >= 0.25 else 0.0


def by_file(hint, path):
    h, p = hint.lower(), path.lower()
    return 1.0 if h == p else 0.6 if h in p else 0.5 * overlap(h, p) if overlap(h, p) >= 0.2 else 0.0


def by_words(prompt, name):
    words = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", prompt.lower()) if len(w) >= 3 and w not in X.STOPWORDS))
    t, n = tokens(name), name.lower()
    points = [1.0 if w in t else 0.7 if any(x.startswith(w) or w.startswith(x) for x in t) else 0.4 if w in n else 0.0 for w in words]
    return min(1.0, sum(points) / len(words)) if words else 0.0


def brute_intents(symbols):
    """Resolved (intent, rank, id, score, source), keyword scores and best keywords, as millionths."""
    micro = lambda x: int(x * 1_000_000 + 0.5)
    resolved, scores, best = set(), set(), {}
    place = {t: k for k, t in enumerate(("region", "nation", "customer", "supplier", "orders"))}
    for i, prompt, _, sh, fh, _ in I.INTENTS:
        hinted, worded = [], []
        for r in symbols:
            more, at = 0.05 if r.is_exported else 0.0, (place[r.tbl], r.k)
            s, f = (max((g(h, x) for h in hints), default=0.0) for g, hints, x in ((by_name, sh, r.name), (by_file, fh, r.file_path[4:])))
            plain = 0.7 * s + 0.3 * f if sh and fh else s if sh else 0.4 * f
            if (s or f) and min(1.0, plain + more) >= 0.45:
                hinted.append((-min(1.0, plain + more), at, r.id))
            if w := by_words(prompt, r.name):
                worded.append((-min(1.0, w + more), at, r.id))
        scores |= {(i, sid, micro(-s)) for s, _, sid in worded}
        best[i] = (micro(max((-s for s, _, _ in worded), default=0.0)), bool(hinted) or any(-s >= 0.3 for s, _, _ in worded))
        top = sorted(hinted)[:20] or sorted(x for x in worded if -x[0] >= 0.25)[:10]
        resolved |= {(i, n + 1, sid, micro(-s), "hints" if hinted else "keywords") for n, (s, _, sid) in enumerate(top)}
    return resolved, scores, best


def test_intents_are_resolved_against_all_symbols(spark):
    symbols = Workspace(spark, SF).star_symbols().collect()
    resolved, scores, best = brute_intents(symbols)
    run = lambda name: registry.QUERIES[name](spark, SF).collect()
    assert {(r.intent_id, r["rank"], r.symbol_id, r.score, r.source) for r in run("resolve_topk")} == resolved
    assert {(r.intent_id, r.id, r.score) for r in run("keyword_scores")} == scores
    assert {r.intent_id: (r.best_keyword, r.is_relevant) for r in run("relevance")} == best
    assert best[7][1] and any(i == 7 and sid.endswith("#Order77") for i, _, sid, _, _ in resolved)
    tables = {r.id: r.tbl for r in symbols}
    assert {tables[sid] for _, sid, _ in scores} == {"region", "nation", "orders"}


def test_placed_symbols_have_places_of_their_own(spark):
    got = Workspace(spark, SF).placed_symbols().select("ord", "tbl").collect()
    assert len({r.ord for r in got}) == len(got) and {r.tbl for r in got} == {"region", "nation", "customer", "supplier", "orders"}


def test_repo_context_counts_all_symbols(spark):
    symbols = Workspace(spark, SF).star_symbols().collect()
    text = registry.QUERIES["repo_context"](spark, SF).first().context
    files, shown = {r.file_path[4:] for r in symbols}, text.split("\n\n")
    head, *listed = shown[1].split("\n")
    assert len(listed) == min(150, len(files)) and head == f"Source files ({len(listed)}{f' ({len(files) - 150} more not shown)' if len(files) > 150 else ''}):"
    head, *listed = shown[2].split("\n")
    assert len(listed) == 400 and head == f"Indexed symbols (400 ({len(symbols) - 400} more not shown), exported first):"
    assert all(", exported]" in x for x in listed) and sum(x.is_exported for x in symbols) >= 400


@pytest.fixture(scope="module")
def cycles(duck):  # noqa: F811
    """Edges of all line items, in the order of their places."""
    lines = duck.sql("SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')").fetchall()
    pairs = {(f"part#{p}", f"supplier#{s}") if flag == "A" else (f"supplier#{s}", f"part#{p}") for p, s, flag in lines}
    return sorted(pairs, key=">".join)


def test_cyclic_graph_has_all_line_items(spark, duck, cycles):  # noqa: F811
    kept = duck.sql("SELECT count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity <= 2").fetchall()[0][0]
    assert len(cycles) > 10 * kept and {tuple(r) for r in Workspace(spark, SF).cyc_edges().collect()} == set(cycles)
    neighbours = {}
    for src, dst in cycles:
        neighbours.setdefault(dst, []).append(src)
    assert {r.dst: r.neighbours for r in registry.QUERIES["adjacency"](spark, SF).collect()} == {k: ",".join(sorted(v)) for k, v in neighbours.items()}


def test_impact_over_all_line_items(spark, cycles):
    run = lambda name: registry.QUERIES[name](spark, SF).collect()
    depths = lambda name: {r.symbol_id: (r.depth, r.role) for r in run(name)}
    with_role = lambda d: {k: (n, "direct" if n == 1 else "indirect") for k, n in d.items()}
    assert depths("impact_cyclic") == with_role(model(cycles, [("supplier#0", "deep")])[0])
    depth, paths = model(cycles, [(s, m) for s, m, _ in G.MIXED])
    assert depths("impact_mixed") == with_role(depth)
    assert sorted((r.symbol_id, r.root_id, r.path, r.depth) for r in run("impact_paths")) == sorted((n, p[0], ">".join(p), len(p) - 1) for n, ps in paths.items() for p in ps)
    gone = {"supplier#0", "supplier#3"}
    left = [(s, d) for s, d in cycles if s not in gone]  # edges to what is gone are those of before
    assert depths("in_editor") == with_role(model(left + [e for e in cycles if e[0] in gone and e[1] in gone], [(g, "deep") for g in sorted(gone)])[0])
