"""Joins of places and intervals whose rows grow with both inputs, not with their product.

A *cell* is a run of 2**level places that starts at a multiple of its length.  An interval is the disjoint union of at
most two cells of each level; a place lies in one cell of each level.  So intervals leave what is asked for at their
cells, where equal cells are put together before anything meets, and places look at their own cells.  Neither long nor
nested nor equal intervals make more rows than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _shift(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _cells(start: Column, end: Column) -> Column:
    """Cells (level, cell) of the closed interval, empty if it ends before it starts; places are not negative."""
    one = lambda level, cell: F.struct(level.alias("level"), cell.alias("cell"))
    length = F.greatest(end - start + 1, F.lit(1))

    def of(level: Column) -> Column:
        lo = _shift(start + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        hi = _shift(end + 1, level)
        left = F.when((lo < hi) & (lo % 2 == 1), one(level, lo))
        right = F.when((lo + lo % 2 < hi) & (hi % 2 == 1), one(level, hi - 1))
        return F.array(left, right)

    top = F.length(F.bin(length)) - 1
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), of)), lambda x: x.isNotNull())


def smallest_around(places: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The smallest span around each place, the one with the smallest ord on ties; places outside of all are left out.

    places: key, at; spans: key, start, end (closed), ord, id.  Returns key, at, id.
    """
    s = spans.select(key, F.greatest(F.col("start").cast("long"), F.lit(0)).alias("start"), F.col("end").cast("long").alias("end"), F.struct((F.col("end") - F.col("start")).alias("size"), F.col("ord"), F.col("id")).alias("best"))
    cells = s.filter("end >= start").select(key, F.inline(F.transform(_cells(F.col("start"), F.col("end")), lambda c: F.struct(c["level"].alias("level"), c["cell"].alias("cell")))), "best")
    kept = cells.groupBy(key, "level", "cell").agg(F.min("best").alias("best"))
    deep = kept.groupBy(key).agg(F.max("level").alias("top"))  # a place looks no higher than its key has cells
    p = places.filter("at >= 0").select(key, F.col("at").cast("long").alias("_at"), F.col("at")).join(deep, key)
    asked = p.select(key, "at", "_at", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    asked = asked.select(key, "at", "level", _shift(F.col("_at"), F.col("level")).alias("cell"))
    found = asked.join(kept, [key, "level", "cell"]).groupBy(key, "at").agg(F.min("best").alias("best"))
    return found.select(key, "at", F.col("best.id").alias("id"))


def meeting(spans: DataFrame, ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The spans (columns start and end, closed) that meet a range of their key (start, end), with all their columns.

    In the order of places, a span meets a range if the largest end of the ranges that start up to the span's end is not
    before the span's start: one sorted pass over both.
    """
    r = ranges.select(F.col(key).alias("_key"), F.col("start").cast("long").alias("_place"), F.col("end").cast("long").alias("_reach"), F.lit(0).alias("_kind"), F.lit(None).cast(spans.select(F.struct(*spans.columns)).schema[0].dataType).alias("_row"))
    s = spans.select(F.col(key).alias("_key"), F.col(end).cast("long").alias("_place"), F.lit(None).cast("long").alias("_reach"), F.lit(1).alias("_kind"), F.struct(*spans.columns).alias("_row"))
    upto = Window.partitionBy("_key").orderBy("_place", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = r.filter("_reach >= _place").unionByName(s).withColumn("_most", F.max("_reach").over(upto))
    return marked.filter((F.col("_kind") == 1) & (F.col("_most") >= F.col(f"_row.{start}"))).select("_row.*")
