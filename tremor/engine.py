"""The engine's entry points: impact of staged changes, of an edit, and of a described change."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tremor.operators import diff, incremental, index, intent, report, roots as R, traversal
from tremor.plans.lineage import cut


class Impact(NamedTuple):
    """roots (symbol_id, mode, reason, ord), impact (symbol_id, depth, role), and the tables to explain them."""

    roots: DataFrame
    impact: DataFrame
    symbols: DataFrame
    edges: DataFrame
    root_path: str

    def paths(self) -> DataFrame:
        return traversal.explain(self.edges, self.roots)

    def listed(self) -> DataFrame:
        return report.refs(report.involved(self.roots, self.impact), self.symbols, self.root_path)

    def report(self, source: str) -> DataFrame:
        return report.document(self.listed(), self.roots, self.edges, source)

    def drawing(self) -> tuple[DataFrame, DataFrame]:
        return index.graph_elements(self.edges, self.symbols, self.roots, self.impact)


def staged_impact(state: incremental.State, staged: DataFrame, contents: DataFrame, hunks: DataFrame, symbols: DataFrame, edges: DataFrame, root: str, strict: bool = False) -> Impact:
    """Impact of staged files on the live graph.

    staged: status, file_path, old_file_path; contents: file_path, text as staged; symbols, edges: what extraction finds in
    the staged files.  By default symbols that go (removed, or of deleted files) are deep roots, renamed files also count
    under their old paths and copies leave their source; ``strict`` takes ghosts of the graph as the only deleted roots.
    """
    files = staged.filter(index.script(F.col("file_path")))
    live = files.filter("status <> 'D'").select("file_path")
    left = files.filter("status = 'D'").select("file_path")
    moved = files.filter("status in ('R', 'C')" if strict else "status = 'R'").filter("old_file_path is not null").select(F.col("old_file_path").alias("file_path"))
    gone = left.union(moved)
    bare = incremental.remove_files(state, gone)
    own = symbols.join(live, "file_path", "left_semi").select(*symbols.columns)
    changed = incremental.change_files(bare, live, own, edges, strict)
    ripple = changed.changes.filter("change = 'ripple'").select("symbol_id")
    ghosts = index.ghosts(changed.state.edges, changed.state.symbols).select(F.col("id").alias("symbol_id"))
    if strict:
        deleted = ghosts
    else:
        lost = state.symbols.join(left, "file_path", "left_semi").select(F.col("id").alias("symbol_id"))
        deleted = ghosts.union(changed.changes.filter("change = 'removed'").select("symbol_id")).union(lost).distinct()
    everywhere = state.symbols if strict else state.symbols.select("id", "file_path").union(changed.state.symbols.select("id", "file_path"))
    renamed = R.renamed(changed.state.symbols if strict else everywhere, files, old_paths=not strict)
    body = index.hunk_symbols(hunks, contents, changed.state.symbols).select(F.col("id").alias("symbol_id"))
    found = cut(R.dedup(R.candidates(deleted=deleted, ripple=ripple, renamed=renamed, body=body)))  # asked for again and again
    impact = traversal.propagate(state.edges, found).drop("run")
    return Impact(found, impact, changed.state.symbols, state.edges, root)


def edit_impact(changed: incremental.Changed, root: str) -> Impact:
    """Impact of an edit: changed signatures and removed symbols, whose dependents from before count."""
    edges = diff.restored_edges(changed.state.edges, changed.before)
    ripple = changed.changes.filter("change = 'ripple'").select("symbol_id")
    removed = changed.changes.filter("change = 'removed'").select("symbol_id")
    found = cut(R.dedup(R.candidates(deleted=removed, ripple=ripple)))
    return Impact(found, traversal.propagate(edges, found).drop("run"), changed.state.symbols, edges, root)


def predicted_impact(intents: DataFrame, state: incremental.State, root: str) -> tuple[DataFrame, DataFrame]:
    """Resolved symbols and predicted impact of described changes."""
    resolved = intent.resolve(intents, state.symbols, root)
    return resolved, intent.predict(intents, resolved, state.edges)
