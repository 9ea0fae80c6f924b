"""Edges stored in both directions, so that a lookup reads a few files whatever the graph's size.

There are two copies, one by src and one by dst.  A copy is dealt to folders by a hash of its key, about ROWS edges each,
and sorted by the key, so that bounds and Bloom filters of row groups leave out most of a file as well.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremor.plans.lineage import cut

#: Edges of a folder; a hub with more of them makes its folder larger, in several files.
ROWS = 1_000_000
_DDL = "src string, dst string"


class Stored(NamedTuple):
    """folder: where the copies are; buckets: folders of each."""

    spark: SparkSession
    folder: str
    buckets: int

    def _of(self, key: str, ids: list[str]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], _DDL)
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        wanted = [r[0] for r in asked.select(_bucket(F.col("id"), self.buckets)).distinct().collect()]  # as many as ids, at most
        top = f"{self.folder}/{key}"
        there = [r for r in wanted if _exists(self.spark, f"{top}/bucket={r}")]
        if not there:
            return self.spark.createDataFrame([], _DDL)
        return self.spark.read.schema(_DDL).parquet(*(f"{top}/bucket={b}" for b in there)).filter(F.col(key).isin(ids))

    def dependents(self, ids: list[str]) -> DataFrame:
        """dst, src of the edges that lead to the ids."""
        return self._of("dst", ids).select("dst", "src")

    def dependencies(self, ids: list[str]) -> DataFrame:
        """src, dst of the edges that start from the ids."""
        return self._of("src", ids).select("src", "dst")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def store(edges: DataFrame, folder: str, rows: int = ROWS) -> Stored:
    """Write distinct edges in both directions; a file's Bloom filter is sized by the edges that it may hold."""
    spark, kept = edges.sparkSession, cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    buckets = max(1, -(-kept.count() // rows))
    for key in ("src", "dst"):
        dealt = kept.withColumn("bucket", _bucket(F.col(key), buckets)).repartition("bucket", F.pmod(F.xxhash64(F.lit(1), "src", "dst"), F.lit(2)))
        out = dealt.sortWithinPartitions("bucket", key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true")
        out = out.option(f"parquet.bloom.filter.expected.ndv#{key}", str(rows))
        out.option("maxRecordsPerFile", rows).partitionBy("bucket").parquet(f"{folder}/{key}")
    return Stored(spark, folder, buckets)
