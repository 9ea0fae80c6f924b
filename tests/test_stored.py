"""Carried values, diffs as tables of lines, and edges stored in both directions."""

import json
import random

from pyspark.sql import functions as F

from tremor.operators.numbering import carried
from tremor.plans import cache_queries
from tremor.sources import adjacency, formats
from tremor.sources.workspaces import Workspace


def test_values_are_carried_over_the_borders_of_ranges(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None] * 9 + ["a", "b", ""])) for i in range(500)]
    r.shuffle(rows)
    want, last = {}, None
    for i, v in sorted(rows):
        last = v if v is not None else last
        want[i] = last
    df = spark.createDataFrame(rows, "at long, v string").repartition(7)
    assert {x.at: x.got for x in carried(df, "got", F.col("v"), "at").collect()} == want
    assert carried(df.limit(0), "got", F.col("v"), "at").columns == ["at", "v", "got"]


def test_a_diff_of_many_lines_stays_dealt(spark):
    n = 200_000
    line = F.when(F.col("id") % 1000 == 0, F.concat(F.lit("+++ b/f"), (F.col("id") / 1000).cast("int"))).when(F.col("id") % 10 == 5, F.concat(F.lit("@@ -1 +"), F.col("id") % 1000, F.lit(" @@"))).otherwise("+x")
    found = formats.diff_lines(spark.range(n).select(F.col("id").alias("at"), line.alias("line")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes become one partition
    try:
        assert found.count() == n // 10 and found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.filter(F.col("file_path") == "f7").agg(F.min("new_start"), F.max("new_start"), F.count("*")).first()[:] == (5, 995, 100)


def test_lookups_read_few_files(spark, tmp_path):
    edges = spark.range(20_000).select(F.concat(F.lit("s"), F.col("id") % 5000).alias("src"), F.concat(F.lit("d"), F.col("id") % 7000).alias("dst"))
    kept = adjacency.store(edges.union(edges), str(tmp_path / "g"), 500)
    assert kept.buckets == 40
    for ids in (["d3"], ["d3", "d6999", "none"], []):
        up, down = kept.dependents(ids), kept.dependencies([i.replace("d", "s") for i in ids])
        assert {tuple(x) for x in up.collect()} == {tuple(x) for x in edges.filter(F.col("dst").isin(ids)).select("dst", "src").collect()}
        assert {tuple(x) for x in down.collect()} == {tuple(x) for x in edges.filter(F.col("src").isin([i.replace("d", "s") for i in ids])).collect()}
        assert len(up.inputFiles()) <= 2 * len(ids) and len(down.inputFiles()) <= 2 * len(ids)
    assert adjacency.store(edges.limit(0), str(tmp_path / "none")).dependents(["a"]).count() == 0


def test_filters_of_small_folders_are_small(spark, tmp_path):
    edges = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("d"), "id").alias("dst"))
    adjacency.store(edges, str(tmp_path), 500)
    sizes = [f.stat().st_size for f in tmp_path.rglob("*.parquet")]
    assert len(sizes) >= 16 and max(sizes) < 50_000  # a filter of the default size has a megabyte


def test_a_symbol_cache_is_one_object_in_several_files(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit('s"\n,{}'), F.format_string("%02d", "id")).alias("id"), "id").toDF("id", "k").repartition(3)
    entries = rows.select("id", F.struct("id", F.concat(F.lit("}\r\n"), "k").alias("name"), F.col("k").cast("int").alias("startLine")).alias("entry"))
    formats.write_symbol_lines(entries, str(tmp_path / "c"))
    files = sorted((tmp_path / "c").glob("part-*"))
    whole = json.loads("".join(f.read_text() for f in files))
    assert sum(f.stat().st_size > 0 for f in files) > 1 and list(whole) == sorted(whole) and len(whole) == 50
    got = formats.read_symbol_lines(spark, str(tmp_path / "c")).orderBy("ord").collect()
    assert [(r.ord, r.id, r.name, r.start_line) for r in got] == [(i, k, v["name"], v["startLine"]) for i, (k, v) in enumerate(whole.items())]
    formats.write_symbol_lines(entries.limit(0), str(tmp_path / "none"))
    assert formats.read_symbol_lines(spark, str(tmp_path / "none")).count() == 0


def test_a_symbol_cache_is_no_single_row(spark, monkeypatch):
    monkeypatch.setattr(formats, "read_json_text", None)  # a file as one value
    assert cache_queries.symbol_cache(Workspace(spark, "/root/testdata/sf0.001")).count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
