"""Maintenance of the index and graph, file by file.

State is a pair of tables (symbols, edges); operators return new ones.  With ``strict`` a removal drops every edge that
touches a file, also edges that other files own; by default edges from other files to symbols that still stand after the
change are kept, so that survivors don't lose their dependents.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tremor.operators import diff
from tremor.operators.index import build_index, upsert_edges
from tremor.plans.lineage import cut

#: Paths that are sent to all executors; more of them meet the symbols by a shuffle.
FEW = 10_000


class State(NamedTuple):
    symbols: DataFrame
    edges: DataFrame


def _paths(files: DataFrame) -> DataFrame:
    """The files' paths, once each; few of them are sent to the symbols, which a shuffle by path would put in as many tasks
    as there are large files."""
    paths = cut(files.select("file_path").distinct())
    return F.broadcast(paths) if paths.count() <= FEW else paths


def remove_files(state: State, files: DataFrame, keep_incoming: DataFrame | None = None) -> State:
    """The state without the files' symbols and every edge that touches one.

    keep_incoming: ids (column id) to which edges from other files stay.
    """
    paths = _paths(files)
    dead = cut(state.symbols.join(paths, "file_path", "left_semi").select("id"))  # asked for by both ends of edges
    left = state.symbols.join(paths, "file_path", "left_anti").select(*state.symbols.columns)
    owned = state.edges.select("src", "dst").join(dead.withColumnRenamed("id", "src"), "src", "left_anti")
    gone = dead if keep_incoming is None else dead.join(keep_incoming.select("id"), "id", "left_anti")
    return State(left, owned.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))


def add_files(state: State, symbols: DataFrame, edges: DataFrame) -> State:
    """Upsert of a file's symbols and edges; what the file had before stays."""
    later = state.symbols.agg(F.coalesce(F.max("ord"), F.lit(-1)) + 1).scalar()  # one value, asked for when the plan runs
    new = symbols.withColumn("ord", F.col("ord") + later)
    return State(build_index(state.symbols.unionByName(new)), upsert_edges(state.edges, edges))


class Changed(NamedTuple):
    state: State
    changes: DataFrame
    before: DataFrame


def change_files(state: State, files: DataFrame, symbols: DataFrame, edges: DataFrame, strict: bool = False) -> Changed:
    """Replace files by their new symbols and edges; with the signature changes and the dependents of removed symbols."""
    paths = _paths(files)
    old = state.symbols.join(paths, "file_path", "left_semi")
    bare = remove_files(state, paths, None if strict else symbols)
    new = add_files(bare, symbols, edges)
    changes = cut(diff.signature_diff(old, symbols, everywhere=new.symbols))  # a row for each symbol of the files, asked for again and again
    removed = changes.filter("change = 'removed'").select(F.col("symbol_id").alias("id"))
    return Changed(new, changes, cut(diff.dependents_before(state.edges, removed)))


def rename_file(state: State, old_path: str, symbols: DataFrame, edges: DataFrame) -> State:
    """Remove the old path, add the new one's symbols and edges."""
    gone = state.symbols.filter(F.col("file_path") == old_path).select("file_path")
    return add_files(remove_files(state, gone), symbols, edges)


def rebuild(symbols: DataFrame, edges: DataFrame) -> State:
    """The state from scratch."""
    return State(build_index(symbols), upsert_edges(edges))


def warm_start(state: State, current: DataFrame, cached: DataFrame, symbols: DataFrame, edges: DataFrame, strict: bool = False) -> State:
    """Bring a cached state up to date: stale files are replaced, vanished ones removed.

    current, cached: file_path, sha1; symbols, edges: what extraction finds in all current files (only stale ones count).
    """
    stale = diff.stale_files(current, cached)
    fresh = symbols.join(stale, "file_path", "left_semi").select(*symbols.columns)
    own = edges.join(fresh.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    updated = change_files(state, stale, fresh, own, strict).state
    return remove_files(updated, diff.vanished_files(updated.symbols, current))


def cache_valid(symbols: DataFrame, edges: DataFrame, cached_hash: str | None, project_hash: str) -> bool:
    """Whether a cached state may be used: same project, nothing empty."""
    return cached_hash == project_hash and not symbols.isEmpty() and not edges.isEmpty()
