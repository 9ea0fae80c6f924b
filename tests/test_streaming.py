"""Change events in batch and as streams."""

import datetime
import random

from pyspark.sql import functions as F

from tremor.streaming import events as E
from tremor.streaming.latest import latest_wins_stream


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def events(spark, rows):
    return spark.createDataFrame([(i, at(ms), path, kind, "h1") for i, (ms, path, kind) in enumerate(rows)], "event_id long, ts timestamp, file_path string, kind string, handler string")


def test_one_timer_for_all_files(spark):
    got = E.debounce(events(spark, [(0, "A", "edit"), (200, "B", "edit"), (900, "A", "edit")]), "300 milliseconds")
    assert [(r.event_id, r.n_events) for r in got.orderBy("started").collect()] == [(1, 2), (2, 1)]


def test_own_saves_hide_external_changes_for_five_seconds(spark):
    rows = [(0, "F", "save"), (5000, "F", "external"), (5001, "F", "external"), (10, "G", "external"), (20, "F", "edit")]
    assert [r.event_id for r in E.suppress_own_saves(events(spark, rows)).orderBy("event_id").collect()] == [0, 2, 3, 4]


def test_latest_run_wins(spark):
    runs = spark.createDataFrame([(1, "k", at(0), at(10)), (2, "k", at(5), at(20)), (3, "j", at(0), at(1)), (4, "j", at(2), at(3))], "run_id long, key string, started timestamp, ended timestamp")
    assert [r.run_id for r in E.latest_wins(runs).orderBy("run_id").collect()] == [2, 3, 4]


def test_routes(spark):
    got = E.route(events(spark, [(0, "a", "edit"), (1, "a", "external"), (2, "a", "nothing")]))
    assert [r.action for r in got.orderBy("event_id").collect()] == ["change", "create"]
    paths = spark.createDataFrame([("/ws/.git/HEAD",), ("/ws/.git/refs/heads/a/b",), ("/ws/.git/index",), ("/ws/HEAD",)], "p string")
    assert [tuple(r) for r in paths.select(E.is_ref(F.col("p")), E.is_staging(F.col("p"))).collect()] == [(True, False), (True, False), (False, True), (False, False)]


def _stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_debounce_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("f").alias("file_path"), F.lit("edit").alias("kind"), F.lit("h1").alias("handler"))
    source = _stream(spark, table, str(tmp_path / "in"))
    query = E.debounce(source.withWatermark("ts", "1 minute"), "60 seconds").writeStream.format("memory").queryName("bursts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.event_id, r.n_events) for r in spark.table("bursts").collect()}
    assert got == {(r.event_id, r.n_events) for r in E.debounce(table, "60 seconds").collect()}


def test_stream_suppression(spark, tmp_path):
    rows = [(0, "F", "save"), (4000, "F", "external"), (9000, "F", "external"), (0, "G", "save"), (9000, "H", "external"), (600000, "Z", "save"), (600000, "Z2", "external")]
    e = events(spark, rows)
    saves, external = _stream(spark, e.filter("kind = 'save'"), str(tmp_path / "s")), _stream(spark, e.filter("kind = 'external'"), str(tmp_path / "e"))
    query = E.suppress_own_saves_stream(external, saves).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("kept").collect()) == [2, 4]  # the last one waits for the watermark


def test_handlers_run_by_action(spark, tmp_path):
    source = _stream(spark, events(spark, [(0, "a", "edit"), (1, "b", "delete"), (2, "c", "edit")]), str(tmp_path / "in"))
    seen = []
    E.apply_stream(source, lambda action, df: seen.append((action, sorted(r.file_path for r in df.collect()))), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [("change", ["a", "c"]), ("delete", ["b"])]


def _runs(spark, rows):
    return spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in rows], "run_id long, key string, started timestamp, ended timestamp")


def _shown(spark, source, folder, name):
    """All rows the stream has written after one more run over the source."""
    out, cp = str(folder / f"out-{name}"), str(folder / f"cp-{name}")
    found = latest_wins_stream(spark.readStream.schema("run_id long, key string, started timestamp, ended timestamp").parquet(source), "1 hour")
    found.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination(240)
    return sorted((r.key, r.run_id) for r in spark.read.schema("key string, run_id long").parquet(out).collect())


def test_latest_wins_stream_equals_batch_whatever_the_order(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, f"k{r.randrange(5)}", s := r.randrange(0, 600_000, 500), s + r.choice([0, 500, 20_000, 200_000])) for i in range(120)]
    end = [(1000, "end", 90_000_000, 90_000_001)]
    want = sorted((x.key, x.run_id) for x in E.latest_wins(_runs(spark, rows)).collect())
    for name in ("a", "b"):
        r.shuffle(rows)
        source = str(tmp_path / f"in-{name}")
        for part in (rows[:50], rows[50:90], rows[90:] + rows[:5], end):  # a restart after each; five runs are read twice
            _runs(spark, part).coalesce(1).write.mode("append").parquet(source)
            got = _shown(spark, source, tmp_path, name)
        assert got == want, name


def test_latest_wins_stream_waits_for_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    _runs(spark, [(1, "k", 0, 10), (2, None, 0, 1), (3, "k", 5, 7)]).coalesce(1).write.parquet(source)
    assert _shown(spark, source, tmp_path, "w") == []
    _runs(spark, [(4, "z", 10_000_000, 10_000_000)]).coalesce(1).write.mode("append").parquet(source)
    assert _shown(spark, source, tmp_path, "w") == [("k", 3)]
