"""Joins of places and intervals against plain loops, and their rows on a large file."""

import random

from pyspark.sql import functions as F

from tremor.operators import index, intervals

SPANS = "file_path string, start int, end int, ord int, id string"


def spans(spark, rows):
    return spark.createDataFrame([(f, s, e, i, f"s{i}") for i, (f, s, e) in enumerate(rows)], SPANS)


def test_smallest_around_equals_a_loop(spark):
    r = random.Random(1)
    rows = [(f"f{r.randrange(3)}", s := r.randrange(0, 200), s + r.choice([-1, 0, 1, 7, 40, 150])) for _ in range(150)]
    places = [(f"f{r.randrange(4)}", r.randrange(-1, 360)) for _ in range(300)]
    want = {}
    for f, p in places:
        around = [(e - s, i) for i, (g, s, e) in enumerate(rows) if g == f and s <= p <= e]
        if around and p >= 0:
            want[f, p] = f"s{min(around)[1]}"
    got = intervals.smallest_around(spark.createDataFrame(places, "file_path string, at int").distinct(), spans(spark, rows), "file_path")
    assert {(x.file_path, x.at): x.id for x in got.collect()} == want


def test_meeting_equals_a_loop(spark):
    r = random.Random(2)
    rows = [(f"f{r.randrange(3)}", s := r.randrange(0, 200), s + r.choice([0, 1, 7, 40])) for _ in range(150)]
    ranges = [(f"f{r.randrange(3)}", s := r.randrange(0, 260), s + r.choice([-1, 0, 2, 15])) for _ in range(25)]
    want = {f"s{i}" for i, (f, s, e) in enumerate(rows) if any(g == f and a <= b and s <= b and e >= a for g, a, b in ranges)}
    got = intervals.meeting(spans(spark, rows), spark.createDataFrame(ranges, "file_path string, start int, end int"), "file_path", "start", "end").collect()
    assert sorted(x.id for x in got) == sorted(want)


def test_a_large_file_makes_rows_in_proportion(spark):
    """100,000 nested symbols and as many probes: each probe lies in up to 50,000 of them."""
    n = 100_000
    nested = spark.range(n).select(F.lit("f").alias("file_path"), F.col("id").cast("int").alias("start"), (2 * n - F.col("id")).cast("int").alias("end"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("s"), F.col("id")).alias("id"))
    places = spark.range(n).select(F.lit("f").alias("file_path"), (2 * F.col("id")).cast("int").alias("at"))
    found = intervals.smallest_around(places, nested, "file_path")
    wrong = found.filter(F.col("id") != F.concat(F.lit("s"), F.least(F.col("at"), 2 * n - F.col("at"), F.lit(n - 1))))
    assert found.count() == n and wrong.isEmpty()
    assert nested.select(F.sum(F.size(intervals._cells(F.col("start").cast("long"), F.col("end").cast("long"))))).first()[0] <= 36 * n
    touched = intervals.meeting(nested, places.select("file_path", F.col("at").alias("start"), F.col("at").alias("end")), "file_path", "start", "end")
    assert touched.count() == n


def test_line_index_equals_the_plain_sum(spark):
    texts = ["", "a", "ab\ncd\n", "x\n\U0001F600y\n\nlast line", "\n\n"]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)] + [("none", None)], "file_path string, text string")
    hunks = spark.createDataFrame([(f"f{i}", a, c) for i in range(len(texts)) for a in (0, 1, 2, 3, 9) for c in (0, 1, 2, 5)] + [("none", 1, 1), ("gone", 1, 1)], "file_path string, new_start int, new_count int")
    got = {tuple(x) for x in index.line_ranges(hunks, index.line_index(files)).collect()}
    there = hunks.filter("new_count > 0").join(files.filter("text is not null"), "file_path")
    plain = there.select("file_path", index.char_range(F.col("text"), F.col("new_start"), F.col("new_start") + F.col("new_count") - 1).alias("r")).select("file_path", "r.start", "r.end")
    assert got == {tuple(x) for x in plain.collect()}
