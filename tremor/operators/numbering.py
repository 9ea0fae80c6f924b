"""Dense numbers and carried values along an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremor.plans.lineage import cut

#: monotonically_increasing_id has the partition above these bits and the row in it below.
_ROW_BITS = 33


def _dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in ranges of the order, sorted, with _at: partition and row in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut(dealt)  # ranges follow a sample: they are drawn once


def parted(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in ranges of the order, with _part, the range's place among them, and _at, which grows along the order."""
    return _dealt(df, *order).withColumn("_part", F.shiftright("_at", _ROW_BITS))


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a column ``name``: 0, 1, 2 and so on along the order, which should be total.

    Rows are dealt by ranges of the order and sorted there; a row's number is its place in its range and the rows of the
    ranges before, of which there is one count each.
    """
    dealt = _dealt(df, *order)
    part = F.shiftright("_at", _ROW_BITS)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))  # a row for each partition
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return dealt.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + row).drop("_at", "_part", "_before")


def carried(df: DataFrame, name: str, value: Column, *order: Column | str) -> DataFrame:
    """df with a column ``name``: along the order, which should be total, the last value up to the row that is not null.

    A range carries its own values forward; what it begins with comes from the last values of the ranges before, of which
    there is one each.
    """
    dealt = parted(df.withColumn("_value", value), *order)
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = dealt.groupBy("_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(lasts.select("_part", before.alias("_before")))  # a row for each partition
    own = dealt.withColumn("_own", F.last("_value", ignorenulls=True).over(upto))
    return own.join(starts, "_part").withColumn(name, F.coalesce("_own", "_before")).drop("_at", "_part", "_value", "_own", "_before")
