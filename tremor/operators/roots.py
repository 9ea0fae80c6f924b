"""Change roots: candidates from several sources, one root for each symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Reasons, weakest first, and how far a change of that reason reaches.
REASONS = {"body-change": "shallow", "renamed": "deep", "signature-ripple": "deep", "deleted": "deep"}


def priority(reason: Column) -> Column:
    out = F.lit(-1)
    for rank, name in enumerate(REASONS):
        out = F.when(reason == name, rank).otherwise(out)
    return out


def mode_of(reason: Column) -> Column:
    return F.when(reason == "body-change", "shallow").otherwise("deep")


def candidates(**sources: DataFrame) -> DataFrame:
    """Union of sources in the order deleted, ripple, renamed, body; each has symbol_id. Columns: symbol_id, reason, ord."""
    names = {"deleted": "deleted", "ripple": "signature-ripple", "renamed": "renamed", "body": "body-change"}
    parts = [sources[k].select("symbol_id", F.lit(r).alias("reason"), F.struct(F.lit(i).alias("source"), F.col("symbol_id").alias("own")).alias("ord")) for i, (k, r) in enumerate(names.items()) if k in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedup(rows: DataFrame) -> DataFrame:
    """One root for each symbol: the strongest reason, placed where the symbol appeared first."""
    best = F.max(F.struct(priority(F.col("reason")).alias("rank"), F.col("reason"))).alias("best")
    return rows.groupBy("symbol_id").agg(best, F.min("ord").alias("ord")).select("symbol_id", mode_of(F.col("best.reason")).alias("mode"), F.col("best.reason").alias("reason"), "ord")


def renamed(symbols: DataFrame, staged: DataFrame, old_paths: bool = True) -> DataFrame:
    """Symbols of renamed or copied files, by new path and (for renames, if old_paths) by old path too."""
    moved = staged.filter("status in ('R', 'C')")
    paths = moved.select("file_path")
    if old_paths:
        paths = paths.union(moved.filter("status = 'R' and old_file_path is not null").select(F.col("old_file_path").alias("file_path")))
    return symbols.join(paths.distinct(), "file_path", "left_semi").select(F.col("id").alias("symbol_id")).distinct()


def of_intent(change_type: Column, affects_api: Column) -> Column:
    """(mode, reason) of a described change."""
    reason = F.when(change_type == "delete", "deleted").when(affects_api, "signature-ripple").otherwise("body-change")
    return F.struct(mode_of(reason).alias("mode"), reason.alias("reason"))
