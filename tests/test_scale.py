"""Tables that grow are never sent whole to the driver, to the executors or to one task."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tremor.operators import incremental, index, intent, report, traversal
from tremor.plans import cache_queries, change_queries, intent_queries as Q, lineage, report_queries
from tremor.sources import scripts
from tremor.sources.workspaces import Workspace
from tremor.streaming import events as E, latest

SF = "/root/testdata/sf0.001"


def broadcast_scans(df) -> list[str]:
    """Scans of files below a broadcast of the plan."""
    inside, found = None, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        inside = None if inside is not None and depth <= inside else inside
        if inside is not None and "Scan parquet" in line:
            found.append(line)
        if inside is None and "BroadcastExchange" in line:
            inside = depth
    return found


@pytest.mark.parametrize("few", [intent.FEW, 0])
def test_symbols_are_paired_with_intents_without_a_broadcast_of_symbols(spark, monkeypatch, few):
    monkeypatch.setattr(intent, "FEW", few)
    w = Workspace(spark, SF)
    assert not broadcast_scans(intent.keyword_candidates(Q.intents(w), Q.symbols(w)))


def test_both_ways_of_pairing_give_the_same_pairs(spark, monkeypatch):
    symbols = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["z"]), ("c", ["y"])], "id string, keys array<string>")
    asked = spark.createDataFrame([(1, ["y", "x"]), (2, ["z", "q"]), (3, [])], "intent_id long, keys array<string>")
    for few in (intent.FEW, 0):
        monkeypatch.setattr(intent, "FEW", few)
        pairs = intent._paired(symbols, asked)
        assert sorted(tuple(r) for r in pairs.select("intent_id", "id").collect()) == [(1, "a"), (1, "c"), (2, "b")] and "keys" not in pairs.columns


def test_edges_of_the_star_are_joined_without_a_broadcast_of_symbols(spark):
    assert not broadcast_scans(Workspace(spark, SF).star_edges())


def test_files_of_one_split_are_read_by_all_tasks_and_once(spark):
    df = spark.range(40).coalesce(1).selectExpr("concat('/ws/f', id, '.ts') AS file_path", "concat('function f', id, '() { return g', id, '() } function g', id, '() {}') AS content")
    assert df.rdd.getNumPartitions() == 1 < scripts.extract_symbols(df).rdd.getNumPartitions()
    read = scripts.read(df)
    symbols = scripts.extract_symbols(read)
    edges = scripts.walk_references(read, symbols, "/ws")
    for out in (symbols, edges, scripts.imports(read)):
        assert "MapIn" not in out._jdf.queryExecution().executedPlan().toString()
    assert symbols.count() == 80 and {(r.src, r.dst) for r in edges.collect()} == {(f"/ws/f{k}.ts#f{k}", f"/ws/f{k}.ts#g{k}") for k in range(40)}


def test_a_stored_report_is_no_single_row(spark, monkeypatch):
    monkeypatch.setattr(report, "document", None)  # one row that holds all
    w = Workspace(spark, SF)
    got = cache_queries.stored_report(w).first()
    edges, roots, listed = report_queries._parts(w)
    parts = report.sections(listed, roots, edges)
    assert got.roots == 4 and got.apis == parts["impacted_apis"].count() and got.unknown == parts["impact_zones"].filter("zone = 'unknown'").count()
    ranks = sorted(r["rank"] for r in parts["impact_zones"].select("rank").collect())
    assert ranks == list(range(listed.count()))


def test_bursts_of_one_handler_are_many_tasks(spark):
    r = random.Random(7)
    rows, at = [], 0
    for i in range(400):
        at += r.choice([0, 1, 59, 60, 61, 300])  # at 60 seconds a burst has fired
        rows.append((i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at), f"f{i}", "edit", r.choice(["h", None])))
    want = []
    for h in ("h", None):
        for i, ts, path, _, _ in sorted(x for x in rows if x[4] == h):
            if not want or want[-1][0] != h or (ts - want[-1][2]).total_seconds() >= 60:
                want.append([h, ts, ts, 0, i])
            want[-1][2:] = [ts, want[-1][3] + 1, i]
    r.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, file_path string, kind string, handler string").repartition(5)
    found = E.debounce(events, "60 seconds")
    assert sorted([x.handler or "", x.started, x.n_events, x.event_id] for x in found.collect()) == sorted([h or "", a, n, i] for h, a, _, n, i in want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes become one partition
    try:
        assert E.debounce(events.filter("handler = 'h'"), "60 seconds").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_streamed_bursts_of_one_handler_are_many_tasks_and_keep_late_events(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    df = spark.range(300).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 7 + (id div 10) * 100) AS ts", "concat('f', id) AS file_path", "'edit' AS kind", "'h' AS handler")
    for part in ("event_id >= 95", "event_id < 95"):  # a burst is cut in two, the earlier part comes later
        df.filter(part).coalesce(1).write.mode("append").parquet(source)
        E.debounce_stream(spark.readStream.schema(df.schema).parquet(source), "60 seconds", kept, str(tmp_path / "cp")).awaitTermination(240)
    assert sorted((r.event_id, r.n_events) for r in E.stored_bursts(spark, kept).collect()) == [(k * 10 + 9, 10) for k in range(30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert E.stored_bursts(spark, kept).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_burst_of_a_stream_is_kept_by_the_driver(spark, monkeypatch):
    from pyspark.sql.streaming import DataStreamWriter

    monkeypatch.setattr(DataStreamWriter, "queryName", None)  # a memory sink needs a name
    assert change_queries.stream_debounce(Workspace(spark, SF)).count() > 100


def test_symbols_of_changed_files_are_found_without_a_shuffle_by_path(spark, monkeypatch):
    w = Workspace(spark, SF)
    state = change_queries._state(w)
    files = state.symbols.filter(F.col("file_path") == change_queries._FILE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of some size
    try:
        few = incremental.remove_files(state, files)
        assert "hashpartitioning(file_path" not in few.symbols._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(incremental, "FEW", 0)
        many = incremental.remove_files(state, files)
        for a, b in zip(few, many, strict=True):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("few", [intent.FEW, 0])
def test_symbols_that_an_intent_deletes_are_no_single_task(spark, monkeypatch, few):
    monkeypatch.setattr(intent, "FEW", few)
    w = Workspace(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of some size
    try:
        found = cache_queries.shadow_index(w)
        assert ("hashpartitioning(intent_id#" in re.sub(r"intent_id#\d+L?, id", "both", found._jdf.queryExecution().executedPlan().toString())) == (few == 0)
        assert found.count() == w.star_symbols().filter("not (tbl = 'orders' and k % 4 = 1)").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_types_of_a_small_file_are_worked_out_by_all_tasks(spark):
    w = Workspace(spark, SF)
    for found in (change_queries.canonical_members(w), change_queries.signatures(w)):
        assert w.table("part").rdd.getNumPartitions() == 1 < found.rdd.getNumPartitions()


def test_edges_are_made_once_for_a_search(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            made.add(1)
            yield r

    rows = [(f"s{i}", f"s{i // 3}") for i in range(1, 40)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitions(counted), "src string, dst string")
    roots = spark.createDataFrame([("s0", "deep", 0)], "symbol_id string, mode string, ord long")
    assert traversal.explain(edges, roots).count() == 39 and made.value == 39


@pytest.mark.parametrize("hub", [traversal.HUB, 5])
def test_a_level_shuffles_its_frontier_and_no_edges(spark, monkeypatch, hub):
    monkeypatch.setattr(traversal, "HUB", hub)
    edges = traversal._Edges(spark.range(2000).selectExpr("concat('s', id) AS src", "concat('d', id % 100) AS dst"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of some size
    try:
        level = edges.out_of(lineage.cut(spark.range(3).selectExpr("concat('d', id) AS node")))
        lines = level._jdf.queryExecution().executedPlan().toString().splitlines()
        at = [i for i, x in enumerate(lines) if "Scan ExistingRDD" in x and "src#" in x]
        assert len(at) == 1 and "Filter" in lines[at[0] - 1] and "Join" in "".join(lines[:at[0]]) and not any(k in x for x in lines[at[0] - 2 : at[0]] for k in ("Exchange", "Sort [")) and level.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_are_made_once_for_a_drawing(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            made.add(1)
            yield r

    edges = spark.createDataFrame(spark.sparkContext.parallelize([(f"s{i}", "s0") for i in range(1, 40)], 2).mapPartitions(counted), "src string, dst string")
    symbols = spark.createDataFrame([("s0", "s0")], "id string, name string")
    none = spark.createDataFrame([], "symbol_id string, role string")
    nodes, arrows = index.graph_elements(edges, symbols, none, none)
    assert (nodes.count(), arrows.count(), made.value) == (40, 39, 39)


def test_latest_wins_of_a_stream_calls_no_python_for_a_key(spark, monkeypatch):
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    w = Workspace(spark, SF)
    got = sorted((x.run_id, x.key) for x in change_queries.stream_latest_wins(w).collect())
    assert got == sorted((x.run_id, x.key) for x in change_queries.latest_wins(w).collect()) and len(got) > 100


RUN = "run_id long, key string, started timestamp, ended timestamp"


def _run_rows(spark, rows):
    at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    return spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in rows], RUN).coalesce(1)


def _decided(spark, source, folder):
    latest.latest_wins_batches(spark.readStream.schema(RUN).parquet(source), f"{folder}/kept", f"{folder}/cp", "1 hour").awaitTermination(240)
    return sorted((x.key, x.run_id) for x in latest.shown_runs(spark, f"{folder}/kept").collect())


def test_latest_wins_in_batches_equals_the_table_whatever_the_order(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, f"k{r.randrange(5)}", s := r.randrange(0, 600, 2), s + r.choice([0, 1, 2, 20, 200])) for i in range(150)]
    want = sorted((x.key, x.run_id) for x in E.latest_wins(_run_rows(spark, rows)).collect())
    r.shuffle(rows)
    for part in (rows[:60], rows[60:110], rows[110:] + rows[:5] + rows[110:115], [(1000, "end", 90_000, 90_001)]):  # runs are read twice, in one micro-batch too
        _run_rows(spark, part).write.mode("append").parquet(str(tmp_path / "in"))
        got = _decided(spark, str(tmp_path / "in"), tmp_path)
    assert got == want


def test_latest_wins_in_batches_waits_drops_late_runs_and_holds_no_more_than_it_needs(spark, tmp_path):
    source, got = str(tmp_path / "in"), []
    for part in (
        [(1, "k", 0, 10), (2, None, 0, 1), (3, "k", 5, 7), (4, "long", 0, 9_000)],  # nothing is decided within the hour
        [(5, "z", 10_000, 10_000)],  # moves the watermark to 6,400: k is decided, long has not ended
        [(6, "k", 6_400, 6_401), (7, "long", 6_401, 6_402), (8, "k", 8_000, 8_001)],  # 6 is late; 7 isn't and overtakes 4
        [(9, "z", 20_000, 20_000)],
    ):
        _run_rows(spark, part).write.mode("append").parquet(source)
        got.append(_decided(spark, source, tmp_path))
    assert got == [[], [("k", 3)], [("k", 3)], [("k", 3), ("k", 8), ("long", 7), ("z", 5)]]
    held = [sorted(x.run_id for x in spark.read.parquet(str(tmp_path / "kept" / f"seen-{k}")).collect()) for k in (0, 1)]
    assert held == [[4, 5, 7, 8], [5, 7, 8, 9]]  # what the third and the fourth micro-batch wrote


def test_a_batch_of_latest_wins_that_runs_again_takes_the_place_of_its_first_run(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in ([(1, "k", 0, 10), (2, "k", 20, 30)], [(3, "k", 25, 26), (4, "z", 9_000, 9_001)], [(5, "z", 90_000, 90_001)]):
        _run_rows(spark, part).write.mode("append").parquet(source)
        first = _decided(spark, source, tmp_path)
        last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda x: int(x.name))
        for f in (last, last.with_name(f".{last.name}.crc")):
            f.unlink()  # as if it had failed at its end
        assert _decided(spark, source, tmp_path) == first
    assert first == [("k", 1), ("k", 3), ("z", 4)]
