"""Snapshots compared: signatures, stale and vanished files, dependents of what is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def signature_diff(old: DataFrame, new: DataFrame, everywhere: DataFrame | None = None) -> DataFrame:
    """symbol_id, change: safe, ripple, added or removed. old, new: id, signature_hash of one scope (a file, a set).

    An id that is gone from the scope but stands in ``everywhere`` (all ids after the change) is not removed.
    """
    a, b = old.select("id", F.col("signature_hash").alias("was")), new.select("id", F.col("signature_hash").alias("now"))
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), "id", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "safe").otherwise("ripple")
    out = both.select(F.col("id").alias("symbol_id"), change.alias("change"))
    if everywhere is None:
        return out
    elsewhere = everywhere.select(F.col("id").alias("symbol_id")).distinct().withColumn("stands", F.lit(True))
    return out.join(elsewhere, "symbol_id", "left").filter("change <> 'removed' or stands is null").drop("stands")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def ripples(changes: DataFrame) -> bool:
    """Whether dependents must be looked at."""
    return not changes.filter("change in ('ripple', 'removed')").isEmpty()


def stale_files(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose hash is empty or not the cached one (a file that isn't cached is stale). Both: file_path, sha1."""
    was = cached.select("file_path", F.col("sha1").alias("was"))
    return current.join(was, "file_path", "left").filter((F.col("sha1") == "") | ~F.col("sha1").eqNullSafe(F.col("was"))).select("file_path")


def vanished_files(symbols: DataFrame, current: DataFrame) -> DataFrame:
    """Files of the index that are no longer there."""
    return symbols.select("file_path").distinct().join(current.select("file_path"), "file_path", "left_anti")


def dependents_before(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Dependents of removed ids before removal (removed_id, src), for those that had one."""
    return edges.join(removed.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("removed_id"), "src").distinct()


def restored_edges(edges: DataFrame, before: DataFrame) -> DataFrame:
    """Edges in which the dependents of removed ids are those from before (removed_id, src), not today's."""
    gone = before.select(F.col("removed_id").alias("dst")).distinct()
    return edges.select("src", "dst").join(gone, "dst", "left_anti").select("src", "dst").union(before.select("src", F.col("removed_id").alias("dst"))).distinct()
