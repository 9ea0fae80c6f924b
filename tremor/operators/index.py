"""The symbol index and the dependency graph: build, look up, filter, locate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremor.functions.text import name_of_first, normal_path, units16
from tremor.operators import intervals
from tremor.operators.numbering import numbered
from tremor.plans.lineage import cut

#: Symbol kinds that an extractor may emit.
KINDS = ("function", "class", "method", "property", "interface", "type", "enum", "variable")


# Path filters; they differ on purpose.


def in_index(path: Column, root: str) -> Column:
    """Sources of the workspace without dependencies and build output."""
    skip = ["/node_modules/", "/.next/", "/dist/", "/out/"]
    p = normal_path(path)
    ok = p.startswith(root.rstrip("/"))
    for s in skip:
        ok = ok & ~p.contains(s)
    return ok


def in_graph(path: Column, root: str) -> Column:
    """As in_index, without the compiler's library declarations."""
    return in_index(path, root) & ~normal_path(path).rlike(r"/typescript/lib/lib\..*\.d\.ts")


def watched(path: Column, root: str, cache: str = "/.tremor/") -> Column:
    """Script files of the workspace outside dependencies and the cache folder."""
    p = normal_path(path)
    return p.startswith(root.rstrip("/")) & ~p.contains("/node_modules/") & ~p.contains(cache) & script(p)


def script(path: Column) -> Column:
    return path.rlike(r"\.(ts|tsx|js|jsx)$")


def build_index(symbols: DataFrame, root: str | None = None) -> DataFrame:
    """One row for each id: values of its last row, order of its first one (by ord)."""
    rows = symbols.filter(in_index(F.col("file_path"), root)) if root else symbols
    values = [c for c in rows.columns if c not in ("id", "ord")]
    last = F.max_by(F.struct(*values), "ord").alias("v")
    return rows.groupBy("id").agg(last, F.min("ord").alias("ord")).select("id", "v.*", "ord")


def upsert_edges(edges: DataFrame, *more: DataFrame) -> DataFrame:
    """Set union of edge tables."""
    out = edges.select("src", "dst")
    for m in more:
        out = out.union(m.select("src", "dst"))
    return out.distinct()


def build_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from resolved references (owner, target): both ends indexed, no loops, each once.

    refs: columns ``src`` (the innermost indexed owner) and ``dst`` (the referenced symbol).
    """
    known = symbols.select("id").distinct()
    kept = refs.filter("src <> dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def owners(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (file_path, pos, dst) with the innermost symbol around them as src; those outside of all are dropped."""
    s = symbols.select("file_path", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "ord", "id")
    found = intervals.smallest_around(refs.select("file_path", F.col("pos").alias("at")).distinct(), s, "file_path")
    return refs.join(found.select("file_path", F.col("at").alias("pos"), F.col("id").alias("src")), ["file_path", "pos"]).select("file_path", "pos", "dst", "src")


def dependents(edges: DataFrame, ids: list[str]) -> DataFrame:
    return edges.filter(F.col("dst").isin(ids)).select("dst", "src").distinct()


def dependencies(edges: DataFrame, ids: list[str]) -> DataFrame:
    return edges.filter(F.col("src").isin(ids)).select("src", "dst").distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_distinct("src").alias("owners"), F.count("*").alias("edges"), F.count_distinct("dst").alias("targets"))


def adjacency(edges: DataFrame, key: str = "src", value: str = "dst") -> DataFrame:
    """Sorted neighbours of each node."""
    return edges.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("neighbours"))


def ghosts(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ends of edges that are no indexed symbol."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(symbols.select("id"), "id", "left_anti")


# Positions.


def char_range(text: Column, start_line: Column, end_line: Column) -> Column:
    """(start, end) offsets, in UTF-16 units, of a range of lines (from 1, clamped); (0, -1) for an empty text.

    The end is the place before the next line's start, or the last character in the last line.
    """
    lines = F.split(text, "\n")
    n = F.size(lines)
    lo = F.least(F.greatest(start_line, F.lit(1)), n)
    hi = F.least(F.greatest(end_line, F.lit(1)), n)
    before = lambda k: F.aggregate(F.slice(lines, 1, k), F.lit(0), lambda acc, x: acc + units16(x) + 1)
    end = F.when(hi >= n, units16(text) - 1).otherwise(before(hi) - 1)
    return F.struct(F.when(text == "", 0).otherwise(before(lo - 1)).alias("start"), F.when(text == "", -1).otherwise(end).alias("end"))


def line_index(contents: DataFrame) -> DataFrame:
    """A row for each line of each text: file_path, line (from 1), start and end (places of its first and last unit, the
    line feed included), n_lines and units of the file.  Computed once for a version of a file, whatever asks for it."""
    lines = contents.filter("text is not null").select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    sized = lines.select("file_path", (F.col("line") + 1).alias("line"), (units16(F.col("body")) + 1).alias("size"))
    file = Window.partitionBy("file_path")
    upto = file.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(upto).cast("int")
    ends = sized.select("file_path", "line", (end - F.col("size")).alias("start"), (end - 1).alias("end"))
    totals = ends.groupBy("file_path").agg(F.max("line").alias("n_lines"), F.max("end").alias("units"))
    return ends.join(totals, "file_path")


def line_ranges(hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """file_path, start, end: offsets of hunks (file_path, new_start, new_count), looked up in a line index.

    The same as ``char_range``, at the cost of two lookups a hunk.
    """
    asked = hunks.filter("new_count > 0").select("file_path", "new_start", (F.col("new_start") + F.col("new_count") - 1).alias("new_end")).distinct()
    totals = lines.filter("line = 1").select("file_path", "n_lines", "units")
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(1)), F.col("n_lines")).cast("int")
    own = asked.join(totals, "file_path").select("file_path", clamp("new_start").alias("line"), clamp("new_end").alias("last"), "n_lines", "units").distinct()
    first = own.join(lines.select("file_path", "line", "start"), ["file_path", "line"])
    ended = first.join(lines.select("file_path", F.col("line").alias("last"), F.col("end").alias("end")), ["file_path", "last"])
    return ended.select("file_path", "start", F.when(F.col("last") >= F.col("n_lines"), F.col("units") - 1).otherwise(F.col("end")).cast("int").alias("end"))


def overlapping(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols whose offsets meet a range of their file (both closed), each once. ranges: file_path, start, end."""
    return intervals.meeting(symbols, ranges, "file_path", "start_pos", "end_pos")


def hunk_symbols(hunks: DataFrame, contents: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ids of symbols that changed lines touch. hunks: file_path, new_start, new_count; contents: file_path, text.

    A hunk of no lines and a file without content touch nothing.
    """
    asked = contents.select("file_path", "text").join(hunks.filter("new_count > 0").select("file_path"), "file_path", "left_semi")
    return overlapping(line_ranges(hunks, line_index(asked)), symbols).select("id").distinct()


def innermost(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each probe (probe_id, file_path, line) the smallest symbol around the line, earliest first on ties; or null."""
    s = symbols.select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "ord", "id")
    found = intervals.smallest_around(probes.select("file_path", F.col("line").alias("at")).distinct(), s, "file_path")
    return probes.join(found.select("file_path", F.col("at").alias("line"), "id"), ["file_path", "line"], "left").select(*probes.columns, "id")


def graph_elements(edges: DataFrame, symbols: DataFrame, roots: DataFrame, impact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, symbol_id, label, role, degree) and edges (id, source, target) for a drawing.

    Nodes are all ends of edges and all roots and impacted symbols; dense ids follow symbol ids, edge ids follow ends.
    """
    edges = cut(edges.select("src", "dst"))  # asked for by ends, degrees and arrows, as nodes are by both ends of arrows
    ends = edges.select(F.col("src").alias("symbol_id")).union(edges.select(F.col("dst").alias("symbol_id")))
    every = ends.union(roots.select("symbol_id")).union(impact.select("symbol_id")).distinct()
    role = F.when(F.col("is_root"), "root").when(F.col("role").isNotNull(), F.col("role")).otherwise("other")
    label = F.coalesce("name", name_of_first(F.col("symbol_id")))
    known = every.join(symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id", "left")
    known = known.join(roots.select("symbol_id").distinct().withColumn("is_root", F.lit(True)), "symbol_id", "left").join(impact.select("symbol_id", "role"), "symbol_id", "left")
    degree = ends.groupBy("symbol_id").agg(F.count("*").alias("degree"))
    nodes = numbered(known.join(degree, "symbol_id", "left"), "at", "symbol_id").select(F.concat(F.lit("n"), "at").alias("id"), "symbol_id", label.alias("label"), role.alias("role"), F.coalesce("degree", F.lit(0)).alias("degree"))
    nodes = cut(nodes)
    arrows = numbered(edges, "at", "src", "dst").select("src", "dst", F.concat(F.lit("e"), "at").alias("id"))
    a, b = nodes.select(F.col("symbol_id").alias("src"), F.col("id").alias("source")), nodes.select(F.col("symbol_id").alias("dst"), F.col("id").alias("target"))
    return nodes, arrows.join(a, "src").join(b, "dst").select("id", "source", "target")


def session_view(nodes: DataFrame, arrows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are part of the session, and edges between them."""
    shown = nodes.filter("role <> 'other'")
    ids = shown.select("id")
    inside = arrows.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, inside
