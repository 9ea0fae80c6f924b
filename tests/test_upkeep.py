"""The stream that keeps index and graph up, against reading all files anew."""

import datetime

from pyspark.sql import functions as F

from tremor import engine
from tremor.operators import incremental
from tremor.sources import scripts
from tremor.streaming import upkeep

SCHEMA = "event_id long, ts timestamp, kind string, file_path string, content string"
START = {"/ws/a.ts": "import { g } from './b';\nexport function f() { g() }", "/ws/b.ts": "export function g() { h() }\nfunction h() {}", "/ws/c.ts": "export const z = () => 1"}


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file_path string, content string")


def whole(spark, texts):
    df = files(spark, texts)
    symbols = scripts.extract_symbols(df)
    return sorted(r.id for r in symbols.collect()), sorted(map(tuple, scripts.walk_references(df, symbols, "/ws").collect()))


def state(spark, folder, **k):
    now = upkeep.current(spark, folder, **k)
    return sorted(r.id for r in now.symbols.collect()), sorted(map(tuple, now.edges.select("src", "dst").collect()))


def test_stream_follows_events(spark, tmp_path):
    log, source = str(tmp_path / "log"), tmp_path / "in"
    assert state(spark, log) == ([], [])
    upkeep.put(spark, log, 0, files(spark, START), "/ws", whole=True)
    assert state(spark, log) == whole(spark, START)
    saved = {**START, "/ws/c.ts": "export function zz() {}"}
    staged = []
    batches = [
        [("edit", "/ws/b.ts", "export function g() {}\nexport function k() { g() }"), ("edit", "/ws/b.ts", "export function g() { k() }\nexport function k() { g() }")],
        [("create", "/ws/d.ts", "import { k } from './b';\nclass D { m() { k() } }"), ("save", "/ws/c.ts", None), ("external", "/ws/.git/index", None)],
        [("delete", "/ws/a.ts", None), ("nothing", "/ws/c.ts", "x")],
    ]
    after = [
        {**START, "/ws/b.ts": batches[0][1][2]}, {**saved, "/ws/b.ts": batches[0][1][2], "/ws/d.ts": batches[1][0][2]},
        {"/ws/b.ts": batches[0][1][2], "/ws/c.ts": saved["/ws/c.ts"], "/ws/d.ts": batches[1][0][2]},
    ]
    source.mkdir()
    run = lambda: upkeep.follow(spark.readStream.schema(SCHEMA).parquet(str(source)), log, "/ws", str(tmp_path / "cp"), disk=lambda: files(spark, saved), on_staging=lambda s: staged.append(s.symbols.count())).awaitTermination(120)
    at, number = datetime.datetime(2024, 1, 1), 0
    for k, (events, want) in enumerate(zip(batches, after)):
        rows = [(number + i, at + datetime.timedelta(seconds=number + i), *e) for i, e in enumerate(events)]
        number += len(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        run()
        assert state(spark, log) == whole(spark, want), k
    assert len(staged) == 1
    assert state(spark, log, before=1) == whole(spark, START)  # older versions can be read
    upkeep.put(spark, log, 2, files(spark, {"/ws/d.ts": batches[1][0][2], "/ws/c.ts": saved["/ws/c.ts"]}), "/ws")  # a batch that runs again
    assert state(spark, log) == whole(spark, after[2])


def test_another_commit_reads_all_files_again(spark, tmp_path):
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    upkeep.put(spark, log, 0, files(spark, START), "/ws", whole=True)
    now = {"/ws/a.ts": "export function only() {}"}
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "external", "/ws/.git/HEAD", None), (2, datetime.datetime(2024, 1, 1), "edit", "/ws/b.ts", "const n = 1")], SCHEMA).write.parquet(source)
    upkeep.follow(spark.readStream.schema(SCHEMA).parquet(source), log, "/ws", str(tmp_path / "cp"), disk=lambda: files(spark, now)).awaitTermination(120)
    assert state(spark, log) == whole(spark, {**now, "/ws/b.ts": "const n = 1"})  # the edit came after


MOVES = SCHEMA + ", old_path string"


def moved(spark, tmp_path, name, rows, **k):
    """Follow one batch of events (kind, file_path, content, old_path) after START."""
    log, source, at = str(tmp_path / f"log-{name}"), str(tmp_path / f"in-{name}"), datetime.datetime(2024, 1, 1)
    upkeep.put(spark, log, 0, files(spark, START), "/ws", whole=True)
    spark.createDataFrame([(i, at + datetime.timedelta(seconds=i), *r) for i, r in enumerate(rows)], MOVES).coalesce(1).write.parquet(source)
    upkeep.follow(spark.readStream.schema(MOVES).parquet(source), log, "/ws", str(tmp_path / f"cp-{name}"), **k).awaitTermination(120)
    return log


def test_saves_without_text_and_renames_lose_nothing(spark, tmp_path):
    new = "import { g } from './b';\nexport function f2() { g() }"
    log = moved(spark, tmp_path, "a", [("edit", "/ws/a.ts", new, None), ("save", "/ws/a.ts", None, None), ("rename", "/ws/b2.ts", None, "/ws/b.ts"), ("rename", "/ws/d.ts", START["/ws/c.ts"] + "0", "/ws/c.ts")])
    assert state(spark, log) == whole(spark, {"/ws/a.ts": new, "/ws/b2.ts": START["/ws/b.ts"], "/ws/d.ts": START["/ws/c.ts"] + "0"})


def test_chains_of_renames_and_deletions(spark, tmp_path):
    rows = [
        ("edit", "/ws/b.ts", "export function g() {}", None), ("rename", "/ws/x.ts", None, "/ws/b.ts"), ("rename", "/ws/y.ts", None, "/ws/x.ts"),  # b -> x -> y, with b's edit
        ("delete", "/ws/c.ts", None, None), ("save", "/ws/c.ts", None, None),  # gone: nothing has its text
        ("rename", "/ws/a1.ts", None, "/ws/a.ts"), ("edit", "/ws/a1.ts", "export const q = 2", None), ("rename", "/ws/a.ts", None, "/ws/a1.ts"),  # there and back, edited
        ("rename", "/ws/z.ts", None, "/ws/nowhere.ts"), ("create", "/ws/b.ts", "class B {}", None),
    ]
    log = moved(spark, tmp_path, "b", rows)
    assert state(spark, log) == whole(spark, {"/ws/y.ts": "export function g() {}", "/ws/a.ts": "export const q = 2", "/ws/b.ts": "class B {}"})


def test_a_rebuild_and_edits_of_one_batch_count_in_order(spark, tmp_path):
    now = {"/ws/a.ts": "export function only() {}", "/ws/b.ts": "export function b1() {}"}
    rows = [("edit", "/ws/a.ts", "export const lost = 1", None), ("external", "/ws/.git/HEAD", None, None), ("edit", "/ws/b.ts", "export function b2() {}", None), ("rename", "/ws/a2.ts", None, "/ws/a.ts")]
    log = moved(spark, tmp_path, "c", rows, disk=lambda: files(spark, now))
    assert state(spark, log) == whole(spark, {"/ws/a2.ts": now["/ws/a.ts"], "/ws/b.ts": "export function b2() {}"})


def test_ripples_of_a_batch_are_those_of_an_edit(spark, tmp_path):
    new = {"/ws/b.ts": "export function k() {}\nfunction h() {}"}  # g goes, which a's f depends on
    seen = []
    log = moved(spark, tmp_path, "d", [("edit", "/ws/b.ts", new["/ws/b.ts"], None)], on_ripple=lambda did: seen.append(sorted(map(tuple, did.changes.collect()))))
    before = upkeep.current(spark, log, before=1)
    own = scripts.extract_symbols(files(spark, new))
    edges = scripts.walk_references(files(spark, new), own, "/ws")
    want = incremental.change_files(before, files(spark, new), own, edges)
    rows = lambda x: sorted(map(tuple, x.collect()))
    for again in (True, False):
        did = upkeep.changed(spark, log, 1)
        assert rows(did.changes) == rows(want.changes.select("symbol_id", "change")) == seen[0]
        assert rows(did.before) == rows(want.before) == [("/ws/b.ts#g", "/ws/a.ts#f")]
        assert rows(engine.edit_impact(did, "/ws").impact) == rows(engine.edit_impact(want, "/ws").impact) == [("/ws/a.ts#f", 1, "direct")]
        if again:
            upkeep.put(spark, log, 1, files(spark, new), "/ws")  # the batch runs again


def test_a_log_with_snapshots_does_not_grow_for_its_readers(spark, tmp_path):
    log, texts = str(tmp_path / "log"), dict(START)
    upkeep.put(spark, log, 0, files(spark, START), "/ws", whole=True)
    read = []
    for v in range(1, 8):
        texts["/ws/b.ts"] = f"export function g() {{ h() }}\nfunction h() {{}}\nexport const n{v} = {v}"
        upkeep.put(spark, log, v, files(spark, {"/ws/b.ts": texts["/ws/b.ts"]}), "/ws")
        if len(upkeep._needed(spark, log, v + 1)) > 3:
            upkeep.compact(spark, log, v)
        now = upkeep.known(spark, log, v + 1, upkeep._buckets(files(spark, {"/ws/b.ts": ""}).select("file_path")))
        read.append(sum(len(x.inputFiles()) for x in now))
    assert max(read[3:]) <= max(read[:3]) and state(spark, log) == whole(spark, texts)
    assert state(spark, log, before=1) == whole(spark, START)
    assert now.symbols.select(F.count_distinct("file_path")).first()[0] <= len(texts)
