"""Impact propagation: breadth-first search along reverse edges to a fixed point.

``edges(src, dst)`` reads "src depends on dst", so a change of dst reaches src.  Roots carry a mode: *deep* roots reach
everything, *shallow* ones their direct dependents.  All roots of all runs move in one frontier, level by level; each
level is checkpointed, so plans stay small and a lost executor costs no earlier level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremor.operators.numbering import numbered
from tremor.plans.lineage import cut, cut_dealt

#: Levels after which the search gives up with an error; it never stops early in silence.
MOST = 10_000
#: Edges into one symbol that a task joins.
HUB = 1_000_000


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _levels(start: DataFrame, keys: list[str], step, most: int) -> DataFrame:
    """Semi-naive iteration: rows of ``start`` and all rows that steps add, each key once, at its first level."""
    seen, frontier = [start], start
    for _ in range(most):
        reached = seen[0].select(*keys) if len(seen) == 1 else _union([s.select(*keys) for s in seen])
        frontier = cut(step(frontier).join(reached, keys, "left_anti"))
        if frontier.isEmpty():
            return _union(seen)
        seen.append(frontier)
        if len(seen) > 8:
            seen = [cut(_union(seen))]
    raise RuntimeError(f"impact has not settled after {most} levels")


class _Edges:
    """Distinct edges, dealt by dst and kept: each level joins with them in place and shuffles only its frontier.

    The edges of a hub, a dst with more than HUB of them, are dealt in slices; a frontier's hubs go to all of theirs.
    """

    def __init__(self, edges: DataFrame, *columns):
        self.parts = n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kept = cut(edges.select("src", "dst", *columns).distinct())  # asked for twice
        self.hubs = cut(kept.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("dst", F.ceil(F.col("n") / HUB).cast("int").alias("slices")))
        self.sliced = not self.hubs.isEmpty()
        if self.sliced:  # hubs are at most one for every HUB edges; Spark checks their size before it broadcasts
            salt = F.pmod(F.xxhash64("src"), F.coalesce("slices", F.lit(1))).cast("int")
            kept = kept.join(self.hubs, "dst", "left").withColumn("slice", salt).drop("slices")
        self.table = cut_dealt(kept, n, "dst", *(["slice"] if self.sliced else []))

    def out_of(self, frontier: DataFrame, node: str = "node") -> DataFrame:
        """Rows of the frontier with each edge into their node."""
        if not self.sliced:
            return frontier.join(self.table, F.col(node) == F.col("dst"))
        wide = frontier.join(self.hubs.select(F.col("dst").alias("_hub"), "slices"), F.col(node) == F.col("_hub"), "left")
        wide = wide.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("_hub", "slices")
        wide = wide.repartition(self.parts, node, "_slice")  # as the edges are, else they would be dealt as the hubs' join deals the frontier
        return wide.join(self.table, (F.col(node) == F.col("dst")) & (F.col("_slice") == F.col("slice"))).drop("_slice", "slice")


def _with_run(roots: DataFrame) -> DataFrame:
    return roots if "run" in roots.columns else roots.withColumn("run", F.lit(0))


def role_of(depth: Column) -> Column:
    return F.when(depth == 1, "direct").otherwise("indirect")


def propagate(edges: DataFrame, roots: DataFrame, most: int = MOST) -> DataFrame:
    """Impacted symbols: run, symbol_id, depth, role. roots: symbol_id, mode and, for several runs at once, run.

    Depth is the smallest over deep roots.  A search passes through other roots, but roots are never listed.  What deep
    roots reach keeps its depth even if a shallow root depends on it directly.
    """
    roots = cut(_with_run(roots).select("run", "symbol_id", "mode").distinct())
    edges = _Edges(edges)
    deep = roots.filter("mode = 'deep'").select("run", F.col("symbol_id").alias("node"), F.lit(0).alias("depth"))

    def step(frontier: DataFrame) -> DataFrame:
        return edges.out_of(frontier).select("run", F.col("src").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()

    reached = _levels(deep, ["run", "node"], step, most)
    names = roots.select("run", F.col("symbol_id").alias("node")).distinct()
    listed = reached.filter("depth > 0").join(names, ["run", "node"], "left_anti")
    near = edges.out_of(roots.filter("mode = 'shallow'"), "symbol_id").select("run", F.col("src").alias("node")).distinct()
    near = near.join(names, ["run", "node"], "left_anti").join(reached.select("run", "node"), ["run", "node"], "left_anti").withColumn("depth", F.lit(1))
    out = listed.unionByName(near)
    return out.select("run", F.col("node").alias("symbol_id"), "depth", role_of(F.col("depth")).alias("role"))


def reach_by_root(edges: DataFrame, roots: DataFrame, most: int = MOST) -> DataFrame:
    """Which roots reach a symbol: run, symbol_id, root_id, depth; what ``explain`` gives, without the paths."""
    roots = cut(_with_run(roots).groupBy("run", "symbol_id").agg(F.min("ord").alias("ord"), F.max(F.col("mode") == "deep").alias("is_deep")))
    edges = _Edges(edges)
    start = roots.filter("is_deep").select("run", F.col("symbol_id").alias("root_id"), F.col("symbol_id").alias("node"), F.lit(0).alias("depth"))

    def step(frontier: DataFrame) -> DataFrame:
        return edges.out_of(frontier).select("run", "root_id", F.col("src").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()

    reached = _levels(start, ["run", "root_id", "node"], step, most)
    names = roots.select("run", F.col("symbol_id").alias("node"))
    deep = reached.filter("depth > 0").join(names, ["run", "node"], "left_anti").select("run", "node", "root_id", "depth")
    near = _shallow(edges, roots, names, reached).select("run", "node", "root_id", F.lit(1).alias("depth"))
    return deep.unionByName(near).select("run", F.col("node").alias("symbol_id"), "root_id", "depth")


def _shallow(edges: _Edges, roots: DataFrame, names: DataFrame, reached: DataFrame) -> DataFrame:
    """Direct dependents of shallow roots that are no roots and that no deep root reaches, with the first such root."""
    near = edges.out_of(roots.filter("not is_deep"), "symbol_id").select("run", F.col("src").alias("node"), F.col("symbol_id").alias("root_id"), F.col("ord").alias("root_ord"))
    near = near.join(names, ["run", "node"], "left_anti").join(reached.select("run", "node").distinct(), ["run", "node"], "left_anti")
    return near.groupBy("run", "node").agg(F.min_by("root_id", "root_ord").alias("root_id"), F.min("root_ord").alias("root_ord"))


def explain(edges: DataFrame, roots: DataFrame, most: int = MOST, asked: DataFrame | None = None) -> DataFrame:
    """Paths: run, symbol_id, root_id, root_ord, path, depth of the path; one for each deep root, at most one shallow.

    roots also have ord, edges may have ord (their place, else by (src, dst)); asked: the symbols (symbol_id) whose paths
    are wanted, else all.  Of equally short paths from a root the one found first stands, which is the one with the
    smallest sequence of edge places.  A symbol that a deep root reaches has no shallow path; of several shallow roots the
    first one counts.

    The search keeps a parent for each node and nothing longer: a level's nodes are numbered in the order of their paths,
    and a node's parent is the one with the smallest number, then the smallest place of the edge.
    """
    roots = cut(_with_run(roots).groupBy("run", "symbol_id").agg(F.min("ord").alias("ord"), F.max(F.col("mode") == "deep").alias("is_deep")))
    place = F.struct(F.col("ord")) if "ord" in edges.columns else F.struct("src", "dst")
    edges = _Edges(edges, place.alias("place"))
    start = roots.filter("is_deep").select("run", F.col("symbol_id").alias("root_id"), F.col("ord").alias("root_ord"), F.col("symbol_id").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank"))

    def step(frontier: DataFrame) -> DataFrame:
        first = F.min(F.struct("rank", "place", "node")).alias("by")
        found = edges.out_of(frontier).groupBy("run", "root_id", "root_ord", "src", (F.col("depth") + 1).alias("depth")).agg(first)
        ranked = numbered(found, "rank", "by.rank", "by.place", "src", "root_ord", "run", "root_id")
        return ranked.select("run", "root_id", "root_ord", F.col("src").alias("node"), F.col("by.node").alias("parent"), "depth", "rank")

    reached = _levels(start, ["run", "root_id", "node"], step, most).drop("rank")
    names = roots.select("run", F.col("symbol_id").alias("node"))
    deep, near = reached.filter("depth > 0").join(names, ["run", "node"], "left_anti"), _shallow(edges, roots, names, reached)
    if asked is not None:
        own = asked.select(F.col("symbol_id").alias("node")).distinct()
        deep, near = deep.join(own, "node", "left_semi"), near.join(own, "node", "left_semi")
    near = near.select("run", "node", "root_id", "root_ord", F.array("root_id", "node").alias("path"))
    found = _climbed(reached, deep).unionByName(near)
    return found.select("run", F.col("node").alias("symbol_id"), "root_id", "root_ord", "path", (F.size("path") - 1).alias("depth"))


def _climbed(reached: DataFrame, asked: DataFrame) -> DataFrame:
    """run, node, root_id, root_ord, path of the asked nodes, from parents by pointer doubling.

    Jumps of 1, 2, 4 and so on steps are tables of their own; every ancestor is a sum of distinct jumps, in one way.
    """
    deepest = asked.agg(F.max("depth")).first()[0] or 0
    jump = cut(reached.filter("parent is not null").select("run", "root_id", F.col("node").alias("at"), F.col("parent").alias("up")))
    jumps = [jump]
    while 2 << (len(jumps) - 1) <= deepest:
        half = jumps[-1]
        onward = half.select("run", "root_id", F.col("at").alias("up"), F.col("up").alias("top"))
        jumps.append(cut(half.join(onward, ["run", "root_id", "up"]).select("run", "root_id", "at", F.col("top").alias("up"))))
    rows = asked.select("run", "root_id", "root_ord", "node", F.col("node").alias("at"), F.col("depth").alias("place"))
    for k in reversed(range(len(jumps))):
        both = F.array(F.struct("at", "place"), F.struct(F.col("up").alias("at"), (F.col("place") - (1 << k)).alias("place")))
        joined = rows.join(jumps[k], ["run", "root_id", "at"], "left")
        rows = joined.select("run", "root_id", "root_ord", "node", F.explode(F.filter(both, lambda x: x["at"].isNotNull())).alias("x")).select("run", "root_id", "root_ord", "node", "x.at", "x.place")
    path = F.array_sort(F.collect_list(F.struct("place", "at")))
    return rows.groupBy("run", "node", "root_id", "root_ord").agg(F.transform(path, lambda x: x["at"]).alias("path"))


def paths_by_symbol(paths: DataFrame) -> DataFrame:
    """All paths of a symbol in the order of their roots."""
    ordered = F.array_sort(F.collect_list(F.struct("root_ord", "path")))
    return paths.groupBy("run", "symbol_id").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))
