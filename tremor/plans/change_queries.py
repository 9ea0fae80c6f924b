"""Queries over snapshots, version-control text, maintenance and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremor import engine
from tremor.functions import types as Y
from tremor.operators import diff, incremental, index, report
from tremor.plans import lineage
from tremor.plans.registry import query
from tremor.sources import formats
from tremor.sources.workspaces import Workspace, oracle
from tremor.streaming import events as E
from tremor.streaming.latest import latest_wins_batches, shown_runs


def _signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("file_path").alias("id"), F.substring(F.sha2("text", 256), 1, 16).alias("signature_hash"))


_SIG = """, o AS (SELECT file_path AS id, substr(sha256(text), 1, 16) AS h FROM doc_old), n AS (SELECT file_path AS id, substr(sha256(text), 1, 16) AS h FROM doc_new),
c AS (SELECT coalesce(o.id, n.id) AS symbol_id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'safe' ELSE 'ripple' END AS change FROM o FULL JOIN n ON o.id = n.id)
"""


@query(oracle(_SIG + "SELECT * FROM c", "doc_old", "doc_new"))
def sig_diff(w: Workspace) -> DataFrame:
    return diff.signature_diff(_signatures(w.doc_old()), _signatures(w.doc_new()))


@query(oracle(_SIG + "SELECT change, count(*) AS n FROM c GROUP BY change", "doc_old", "doc_new"))
def change_counts(w: Workspace) -> DataFrame:
    return diff.change_counts(diff.signature_diff(_signatures(w.doc_old()), _signatures(w.doc_new())))


@query(oracle(" SELECT n.file_path FROM doc_new n LEFT JOIN doc_old o USING (file_path) WHERE o.file_path IS NULL OR sha1(n.text) <> sha1(o.text)", "doc_old", "doc_new"))
def stale_files(w: Workspace) -> DataFrame:
    return diff.stale_files(formats.content_hashes(w.doc_new()), formats.content_hashes(w.doc_old()))


@query(oracle(" SELECT file_path, sha1(text) AS sha1 FROM doc_new", "doc_new"))
def file_hashes(w: Workspace) -> DataFrame:
    return formats.content_hashes(w.doc_new())


@query(oracle(" SELECT file_path FROM doc_old WHERE file_path NOT IN (SELECT file_path FROM doc_new)", "doc_old", "doc_new"))
def vanished_files(w: Workspace) -> DataFrame:
    return diff.vanished_files(w.doc_old(), w.doc_new())


@query(oracle(" SELECT DISTINCT dst AS removed_id, src FROM star_edges WHERE dst IN (SELECT id FROM star_symbols WHERE tbl = 'customer' AND k % 5 = 0)", "star_edges"))
def pre_removal(w: Workspace) -> DataFrame:
    return diff.dependents_before(w.star_edges(), w.star_symbols().filter("tbl = 'customer' and k % 5 = 0"))


#: Length in UTF-16 units.
_UNITS = r"length(regexp_replace({}, '[^\x{{0}}-\x{{FFFF}}]', 'xx', 'g'))"
_RANGES = """, spans AS (SELECT h.file_path, n.text, h.new_start AS a, h.new_start + h.new_count - 1 AS b, h.new_count FROM doc_hunks h JOIN doc_new n USING (file_path)),
sp AS (SELECT *, len(string_split(text, chr(10))) AS lines FROM spans),
cl AS (SELECT *, least(greatest(a, 1), lines) AS lo, least(greatest(b, 1), lines) AS hi FROM sp),
r AS (SELECT file_path, new_count, CAST(list_sum(list_transform(string_split(text, chr(10))[1:lo - 1], lambda x: {u} + 1)) AS BIGINT) AS s0,
  CAST(list_sum(list_transform(string_split(text, chr(10))[1:hi], lambda x: {u} + 1)) AS BIGINT) AS e0, {ut} AS n, hi >= lines AS final, text FROM cl),
ranges AS (SELECT file_path, new_count, CASE WHEN text = '' THEN 0 ELSE CAST(coalesce(s0, 0) AS INTEGER) END AS "start", CASE WHEN text = '' THEN -1 WHEN final THEN CAST(n - 1 AS INTEGER) ELSE CAST(e0 - 1 AS INTEGER) END AS "end" FROM r)
""".replace("{u}", _UNITS.format("x")).replace("{ut}", _UNITS.format("text"))


@query(oracle(_RANGES + 'SELECT file_path, "start" AS start_pos, "end" AS end_pos FROM ranges', "doc_hunks"))
def line_to_char(w: Workspace) -> DataFrame:
    rows = w.hunks().join(w.doc_new(), "file_path")
    span = index.char_range(F.col("text"), F.col("new_start"), F.col("new_start") + F.col("new_count") - 1)
    return rows.select("file_path", span.alias("r")).select("file_path", F.col("r.start").alias("start_pos"), F.col("r.end").alias("end_pos"))


@query(oracle(_RANGES + 'SELECT DISTINCT s.id FROM ranges r JOIN doc_symbols s ON s.file_path = r.file_path AND s.start_pos <= r."end" AND s.end_pos >= r."start" WHERE r.new_count > 0', "doc_hunks", "doc_symbols"))
def hunk_symbols(w: Workspace) -> DataFrame:
    return index.hunk_symbols(w.hunks(), w.doc_new(), w.doc_symbols())


# Text of a version-control system, made from documents.


def _staged_text(w: Workspace) -> DataFrame:
    """A listing of one line for each document: modified, renamed, deleted, and blank or short ones."""
    p = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".ts"))
    tab = "\t"
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("M" + tab), p, F.lit("  "))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("R100" + tab), p, F.lit(tab + "new/"), p))
    line = line.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("D" + tab), p)).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("R090" + tab), p)).otherwise("   ")
    d = w.table("documents").withColumn("line", line)
    return d.groupBy((F.col("doc_id") % 50).alias("list_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n").alias("raw"))


@query(
    """SELECT doc_id % 50 AS list_id, CASE doc_id % 5 WHEN 0 THEN 'M' WHEN 2 THEN 'D' ELSE 'R' END AS status,
CASE WHEN doc_id % 5 = 1 THEN 'new/' ELSE '' END || 'f' || doc_id || '.ts' AS file_path, CASE WHEN doc_id % 5 = 1 THEN 'f' || doc_id || '.ts' END AS old_file_path FROM documents WHERE doc_id % 5 <> 4"""
)
def name_status_parse(w: Workspace) -> DataFrame:
    return formats.name_status(_staged_text(w), key="list_id")


def _diff_text(w: Workspace) -> DataFrame:
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    path = F.when(n % 7 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/src/d"), s(n), F.lit(".ts")))
    head = F.concat(F.lit("@@ -"), s(n % 9), F.lit(",2 +"), s(n % 90 + 1), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(","), s(n % 4))), F.lit(" @@ fn()"))
    text = F.concat_ws("\n", F.lit("diff --git a/x b/x"), F.lit("--- a/x"), path, head, F.lit("+added"), F.lit("@@ bad header @@"))
    d = w.table("documents").withColumn("text", text)
    return d.groupBy((n % 40).alias("diff_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("raw"))


@query(
    """SELECT doc_id % 40 AS diff_id, 'src/d' || doc_id || '.ts' AS file_path, CAST(doc_id % 90 + 1 AS INTEGER) AS new_start, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 4 END AS INTEGER) AS new_count
FROM documents WHERE doc_id % 7 <> 0 AND NOT (doc_id % 3 <> 0 AND doc_id % 4 = 0)"""
)
def hunk_parse(w: Workspace) -> DataFrame:
    return formats.diff_hunks(_diff_text(w), key="diff_id")


@query(
    """SELECT 'src/d' || doc_id || '.ts' AS file_path, CAST(doc_id % 90 + 1 AS INTEGER) AS new_start, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 4 END AS INTEGER) AS new_count
FROM documents WHERE doc_id % 7 <> 0 AND NOT (doc_id % 3 <> 0 AND doc_id % 4 = 0)"""
)
def hunk_lines(w: Workspace) -> DataFrame:
    """The same hunks out of one diff of all documents, as a table of lines."""
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    path = F.when(n % 7 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/src/d"), s(n), F.lit(".ts")))
    head = F.concat(F.lit("@@ -"), s(n % 9), F.lit(",2 +"), s(n % 90 + 1), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(","), s(n % 4))), F.lit(" @@ fn()"))
    lines = w.table("documents").select("doc_id", F.posexplode(F.array(F.lit("--- a/x"), path, F.lit("+added"), head, F.lit("@@ bad header @@"))).alias("k", "line"))
    return formats.diff_lines(lines.select((n * 10 + F.col("k")).alias("at"), "line"))


# Maintenance.


def _state(w: Workspace) -> incremental.State:
    return incremental.State(w.star_symbols().withColumn("ord", F.col("k")).select("id", "file_path", "name", "signature_hash", "ord"), w.star_edges())


_FILE = "/ws/src/customer/n3.ts"


@query(oracle(f""", dead AS (SELECT id FROM star_symbols WHERE file_path = '{_FILE}')
SELECT src, dst FROM star_edges WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead)""", "star_edges"))
def remove_file(w: Workspace) -> DataFrame:
    state = _state(w)
    return incremental.remove_files(state, state.symbols.filter(F.col("file_path") == _FILE)).edges


def _edited(w: Workspace) -> tuple[DataFrame, DataFrame]:
    """The file again: a third of its symbols gone, a third with another signature; each depends on region 0."""
    own = _state(w).symbols.filter(F.col("file_path") == _FILE).withColumn("n", F.pmod(F.col("ord"), F.lit(3)))
    new = own.filter("n <> 0").withColumn("signature_hash", F.when(F.col("n") == 1, "changed").otherwise(F.col("signature_hash"))).drop("n")
    return new, new.select(F.col("id").alias("src"), F.lit("/ws/src/region/all.ts#Region0").alias("dst"))


_CHANGED = f""", own AS (SELECT id, k % 3 AS n FROM star_symbols WHERE file_path = '{_FILE}')"""


@query(oracle(_CHANGED + " SELECT id AS symbol_id, CASE n WHEN 0 THEN 'removed' WHEN 1 THEN 'ripple' ELSE 'safe' END AS change FROM own", "star_symbols"))
def change_file_diff(w: Workspace) -> DataFrame:
    state = _state(w)
    return incremental.change_files(state, state.symbols.filter(F.col("file_path") == _FILE), *_edited(w)).changes


@query(
    oracle(
        _CHANGED + """ SELECT src, dst FROM star_edges WHERE src NOT IN (SELECT id FROM own) AND dst NOT IN (SELECT id FROM own WHERE n = 0)
UNION SELECT id, '/ws/src/region/all.ts#Region0' FROM own WHERE n <> 0""",
        "star_edges",
    )
)
def apply_change(w: Workspace) -> DataFrame:
    state = _state(w)
    return incremental.change_files(state, state.symbols.filter(F.col("file_path") == _FILE), *_edited(w)).state.edges


@query(oracle(_CHANGED + " SELECT src, dst FROM star_edges WHERE src NOT IN (SELECT id FROM own) AND dst NOT IN (SELECT id FROM own) UNION SELECT id, '/ws/src/region/all.ts#Region0' FROM own WHERE n <> 0", "star_edges"))
def apply_change_strict(w: Workspace) -> DataFrame:
    state = _state(w)
    return incremental.change_files(state, state.symbols.filter(F.col("file_path") == _FILE), *_edited(w), strict=True).state.edges


_REACH = """,
b AS (SELECT id, 0 AS depth FROM roots WHERE mode = 'deep' UNION SELECT e.src, b.depth + 1 FROM b JOIN star_edges e ON e.dst = b.id WHERE b.depth < 20),
reach AS (SELECT id, min(depth) AS depth FROM b GROUP BY id),
near AS (SELECT DISTINCT e.src AS id, 1 AS depth FROM roots r JOIN star_edges e ON e.dst = r.id WHERE r.mode = 'shallow' AND e.src NOT IN (SELECT id FROM roots) AND e.src NOT IN (SELECT id FROM reach)),
impact AS (SELECT * FROM reach WHERE id NOT IN (SELECT id FROM roots) UNION ALL SELECT * FROM near)
SELECT id AS symbol_id, 'root' AS role, reason, 0 AS depth FROM roots UNION ALL SELECT id, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END, NULL, CAST(depth AS INTEGER) FROM impact"""


@query(
    oracle(
        f""", own AS (SELECT id, k % 3 AS n FROM star_symbols WHERE file_path = '{_FILE}'),
c AS (SELECT id, 'deleted' AS reason, 3 AS p FROM own WHERE n = 0 UNION ALL SELECT id, 'deleted', 3 FROM star_symbols WHERE file_path = '/ws/src/nation/r4.ts' UNION ALL SELECT id, 'signature-ripple', 2 FROM own WHERE n = 1
  UNION ALL SELECT s.id, 'body-change', 0 FROM star_symbols s JOIN own USING (id) WHERE n <> 0 AND start_pos <= 1199 AND end_pos >= 1000),
roots AS (SELECT id, arg_max(reason, p) AS reason, CASE WHEN max(p) = 0 THEN 'shallow' ELSE 'deep' END AS mode FROM c GROUP BY id)"""
        + _REACH,
        "star_edges", recursive=True,
    )
)
def staged_impact(w: Workspace) -> DataFrame:
    """A file edited (a third of it gone, a third with other signatures, two lines of it touched) and a file deleted."""
    s = w.star_symbols()
    state = incremental.State(s.withColumn("ord", F.col("k")).drop("tbl", "k", "ptbl", "pk"), w.star_edges())
    own = state.symbols.filter(F.col("file_path") == _FILE).withColumn("n", F.pmod(F.col("ord"), F.lit(3))).filter("n <> 0")
    new = own.withColumn("signature_hash", F.when(F.col("n") == 1, "changed").otherwise(F.col("signature_hash"))).drop("n")
    staged = w.spark.createDataFrame([("M", _FILE, None), ("D", "/ws/src/nation/r4.ts", None)], "status string, file_path string, old_file_path string")
    contents = w.spark.range(1).select(F.lit(_FILE).alias("file_path"), F.repeat(F.concat(F.repeat(F.lit("x"), 99), F.lit("\n")), 60).alias("text"))
    hunks = w.spark.createDataFrame([(_FILE, 11, 2)], "file_path string, new_start int, new_count int")
    found = engine.staged_impact(state, staged, contents, hunks, new, state.edges.limit(0), "/ws")
    return report.involved(found.roots, found.impact)


@query(oracle(f", roots AS (SELECT id, 'deep' AS mode, CASE k % 3 WHEN 0 THEN 'deleted' ELSE 'signature-ripple' END AS reason FROM star_symbols WHERE file_path = '{_FILE}' AND k % 3 <> 2)" + _REACH, "star_edges", recursive=True))
def edit_impact(w: Workspace) -> DataFrame:
    state = _state(w)
    changed = incremental.change_files(state, state.symbols.filter(F.col("file_path") == _FILE), *_edited(w))
    found = engine.edit_impact(changed, "/ws")
    return report.involved(found.roots, found.impact)


@query(oracle(f" SELECT CASE WHEN file_path = '{_FILE}' THEN '/ws/src/moved.ts#' || name ELSE id END AS id, CASE WHEN file_path = '{_FILE}' THEN '/ws/src/moved.ts' ELSE file_path END AS file_path FROM star_symbols", "star_symbols"))
def rename_file(w: Workspace) -> DataFrame:
    state = _state(w)
    new = state.symbols.filter(F.col("file_path") == _FILE).withColumn("file_path", F.lit("/ws/src/moved.ts")).withColumn("id", F.concat("file_path", F.lit("#"), "name"))
    return incremental.rename_file(state, _FILE, new, state.edges.limit(0)).symbols.select("id", "file_path")


@query(
    oracle(
        """ SELECT n.file_path || '#m' AS id, substr(sha256(n.text), 1, 16) AS signature_hash FROM doc_new n""",
        "doc_new",
    )
)
def warm_start(w: Workspace) -> DataFrame:
    def symbols(docs: DataFrame) -> DataFrame:
        return docs.select(F.concat("file_path", F.lit("#m")).alias("id"), "file_path", F.lit("m").alias("name"), F.substring(F.sha2("text", 256), 1, 16).alias("signature_hash"), F.col("doc_id").alias("ord"))

    old, new = w.doc_old(), w.doc_new()
    none = w.spark.createDataFrame([], "src string, dst string")
    state = incremental.warm_start(incremental.State(symbols(old), none), formats.content_hashes(new), formats.content_hashes(old), symbols(new), none)
    return state.symbols.select("id", "signature_hash")


# Events.


_BURSTS = """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) < INTERVAL {gap} SECOND THEN 0 ELSE 1 END AS new FROM file_events),
s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS burst FROM g)
SELECT arg_max(event_id, (ts, event_id)) AS event_id, arg_max(file_path, (ts, event_id)) AS file_path, arg_max(kind, (ts, event_id)) AS kind, count(*) AS n_events FROM s GROUP BY burst"""


@query(oracle(_BURSTS.format(gap=60), "file_events"))
def debounce(w: Workspace) -> DataFrame:
    return E.debounce(w.file_events(), "60 seconds").select("event_id", "file_path", "kind", "n_events")


@query(
    oracle(
        """, e AS (SELECT *, 'h' || (event_id % 4) AS h, CASE event_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 900 END AS gap FROM file_events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY h ORDER BY ts, event_id) < to_seconds(gap) THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY h ORDER BY ts, event_id) AS burst FROM g)
SELECT h AS handler, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM s GROUP BY h, burst""",
        "file_events",
    )
)
def debounce_by_handler(w: Workspace) -> DataFrame:
    gap = F.when(F.col("event_id") % 4 == 0, "30 seconds").when(F.col("event_id") % 4 == 1, "60 seconds").when(F.col("event_id") % 4 == 2, "300 seconds").otherwise("900 seconds")
    own = w.file_events().withColumn("handler", F.concat(F.lit("h"), (F.col("event_id") % 4).cast("string")))
    return E.debounce(own, gap).select("handler", "event_id", "n_events")


@query(oracle(_BURSTS.format(gap=60), "file_events"))
def stream_debounce(w: Workspace) -> DataFrame:
    """The same through a stream: all files at hand."""
    spark, kept = w.spark, lineage.folder(w.spark)
    schema = w.table("events").schema
    raw = spark.readStream.schema(schema).parquet(f"{w.sf_dir}/events.parque[t]")  # a pattern: a stream takes no single file
    E.debounce_stream(w.file_events(raw), "60 seconds", kept, lineage.folder(spark)).awaitTermination()
    return E.stored_bursts(spark, kept).select("event_id", "file_path", "kind", "n_events")


_ROUTED = "CASE kind WHEN 'edit' THEN 'change' WHEN 'save' THEN 'note-save' WHEN 'create' THEN 'create' WHEN 'delete' THEN 'delete' ELSE 'create' END"


@query(oracle(f" SELECT {_ROUTED} AS action, kind, count(*) AS n FROM file_events GROUP BY ALL", "file_events"))
def event_routing(w: Workspace) -> DataFrame:
    return E.route(w.file_events()).groupBy("action", "kind").agg(F.count("*").alias("n"))


@query(
    oracle(
        """ SELECT e.event_id, e.file_path, e.kind FROM file_events e WHERE e.kind <> 'external'
OR NOT EXISTS (SELECT 1 FROM file_events s WHERE s.kind = 'save' AND s.file_path = e.file_path AND s.ts <= e.ts AND s.ts >= e.ts - INTERVAL 6 HOUR)""",
        "file_events",
    )
)
def self_save_suppress(w: Workspace) -> DataFrame:
    return E.suppress_own_saves(w.file_events(), "6 hours").select("event_id", "file_path", "kind")


_LATEST = oracle(
    """, r AS (SELECT event_id AS run_id, file_path AS key, ts AS started, ts + to_seconds(CAST(600 + event_id % 100 * 3600 AS BIGINT)) AS ended FROM file_events),
n AS (SELECT *, lead(started) OVER (PARTITION BY key ORDER BY started, run_id) AS newer FROM r)
SELECT run_id, key FROM n WHERE newer IS NULL OR newer > ended""",
    "file_events",
)


def _file_runs(events: DataFrame) -> DataFrame:
    ended = F.timestamp_seconds(F.unix_micros("ts") / 1000000 + 600 + F.col("event_id") % 100 * 3600)
    return events.select(F.col("event_id").alias("run_id"), F.col("file_path").alias("key"), F.col("ts").alias("started"), ended.alias("ended"))


@query(_LATEST)
def latest_wins(w: Workspace) -> DataFrame:
    return E.latest_wins(_file_runs(w.file_events())).select("run_id", "key")


@query(_LATEST)
def stream_latest_wins(w: Workspace) -> DataFrame:
    """The same through a stream with its state in a table; a run far in the future moves the watermark past all others."""
    spark, source, kept, state = w.spark, lineage.folder(w.spark), lineage.folder(w.spark), lineage.folder(w.spark)
    rows = _file_runs(w.file_events())
    rows.write.parquet(source)
    end = rows.agg(F.lit(-1).cast("long").alias("run_id"), F.lit("end").alias("key"), (F.max("ended") + F.expr("interval 2 days")).alias("started"), (F.max("ended") + F.expr("interval 2 days")).alias("ended"))
    found = lambda: latest_wins_batches(spark.readStream.schema(rows.schema).parquet(source), kept, state, "1 day").awaitTermination()
    found()
    end.write.mode("append").parquet(source)
    found()
    return shown_runs(spark, kept).select("run_id", "key")


# Types and signatures, on literal declarations.

_TYPES = [
    ("string | number", "number | string"), ("{ b: 1; a: 2 }", "{ a: 2; b: 1 }"), ("A<x | y> | B", "A<x | y> | B"), ("C | A<x | y>", "A<x | y> | C"), ("() => b | a", "() => b | a"),
    ("b  &\n a", "a & b"), ("{ b: 1; a: 2; }", "{ a: 2;; b: 1 }"), ("[z | y] | Map<string, number | null>", "Map<string, number | null> | [z | y]"), ("plain", "plain"), ("", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')".replace("\n", "' || chr(10) || '") for a, b in _TYPES) + ") t(raw, canonical)")
def canonicalize_type(w: Workspace) -> DataFrame:
    return w.spark.createDataFrame([(a,) for a, _ in _TYPES], "raw string").withColumn("canonical", Y.canonical_type(F.col("raw")))


@query(
    """SELECT p_partkey AS k, array_to_string(list_sort(['Map<' || p_name || ' | ' || p_brand || '>', p_type, p_brand]), ' | ') AS anyof,
array_to_string(list_sort(['[' || p_brand || ' & ' || p_name || ']', p_name || p_size, 'Z']), ' & ') AS allof,
'{ ' || array_to_string(list_sort(['size: ' || p_size, 'name?: ' || p_name, 'of(x: { b: 1; a: 2 }): ' || p_brand]), '; ') || ' }' AS members FROM part"""
)
def canonical_members(w: Workspace) -> DataFrame:
    p = Y.dealt(w.table("part"))
    cat = lambda *xs: Y.canonical_type(F.concat(*(F.col(x) if x.startswith("p_") else F.lit(x) for x in xs)))
    return p.select(
        F.col("p_partkey").alias("k"), cat("Map<", "p_name", " | ", "p_brand", "> |\n", "p_type", "  | ", "p_brand").alias("anyof"), cat("Z & ", "[", "p_brand", " & ", "p_name", "] & ", "p_name", "p_size").alias("allof"),
        cat(" { size: ", "p_size", "; of(x: { b: 1; a: 2 }): ", "p_brand", "; name?:\t", "p_name", " }").alias("members"),
    )


@query(
    """SELECT p_partkey AS k, '(' || p_name || ':' || CASE WHEN p_brand < p_type THEN p_brand || ' | ' || p_type ELSE p_type || ' | ' || p_brand END || ',n:number):void' AS callable,
'class:' || p_brand || ':[' || CASE WHEN p_name < p_type THEN p_name || ',' || p_type ELSE p_type || ',' || p_name END || ']' AS class_sig,
CASE WHEN 'B=' || p_size < 'A=' THEN 'B=' || p_size || ',A=' ELSE 'A=,B=' || p_size END AS enum_sig FROM part"""
)
def signatures(w: Workspace) -> DataFrame:
    p = Y.dealt(w.table("part"))
    names, kinds = F.array(F.col("p_name"), F.lit("n")), F.array(F.concat("p_type", F.lit(" | "), "p_brand"), F.lit("number"))
    members = F.array(F.lit("B"), F.lit("A"))
    return p.select(
        F.col("p_partkey").alias("k"), Y.sign_callable(names, kinds, F.lit("void")).alias("callable"), Y.sign_class(F.col("p_brand"), F.array("p_name", "p_type")).alias("class_sig"),
        Y.sign_enum(members, F.array(F.col("p_size").cast("string"), F.lit(None).cast("string"))).alias("enum_sig"),
    )
