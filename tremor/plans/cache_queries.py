"""Queries over caches, sinks and what is kept between runs: each writes and reads back what it returns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from tremor.operators import diff, incremental, intent, report
from tremor.plans import lineage
from tremor.plans.registry import query
from tremor.plans.report_queries import _parts, _sql as report_sql
from tremor.plans.source_queries import _FILES, _REFERENCES, _sources
from tremor.sources import formats
from tremor.sources.workspaces import Workspace, oracle
from tremor.streaming import events as E, upkeep


def _text_file(df: DataFrame, value: Column, folder: str) -> str:
    """One row's value as a text file."""
    df.select(value.alias("value")).coalesce(1).write.text(folder)
    return folder


def _customers(w: Workspace) -> DataFrame:
    return w.placed_symbols().filter("tbl = 'customer'")


# JSON caches, each one object in one file.

_CACHED = "id, name, kind, file_path, start_line, end_line, start_pos, end_pos, is_exported, signature_hash"


@query(oracle(f" SELECT {_CACHED}, CAST(NULL AS VARCHAR) AS parent_id, row_number() OVER (ORDER BY id) - 1 AS ord FROM star_symbols WHERE tbl = 'customer'", "star_symbols"))
def symbol_cache(w: Workspace) -> DataFrame:
    camel = {"filePath": "file_path", "startLine": "start_line", "endLine": "end_line", "startPos": "start_pos", "endPos": "end_pos", "isExported": "is_exported", "signatureHash": "signature_hash"}
    entry = F.struct("id", "name", "kind", *(F.col(c).alias(n) for n, c in camel.items()))
    folder = lineage.folder(w.spark)
    formats.write_symbol_lines(_customers(w).select("id", entry.alias("entry")), folder)
    return formats.read_symbol_lines(w.spark, folder)


@query(oracle(" SELECT src, dst FROM star_edges WHERE dst LIKE '%#Nation%' UNION ALL SELECT 'flat ' || src, dst FROM star_edges WHERE dst LIKE '%#Region%'", "star_edges"))
def edge_cache(w: Workspace) -> DataFrame:
    """Both forms of the file: with sections, and the older one without."""

    def lists(df: DataFrame) -> DataFrame:
        each = df.groupBy("src").agg(F.collect_list("dst").alias("to"))
        return each.agg(F.map_from_entries(F.collect_list(F.struct("src", "to"))).alias("m"))

    e = w.star_edges()
    present = F.to_json(F.struct(F.struct(F.col("m").alias("forward")).alias("present"), F.struct(F.map_from_arrays(F.array(F.lit("x")), F.array(F.array(F.lit("y")))).alias("forward")).alias("future")))
    new = formats.read_edges(w.spark, _text_file(lists(e.filter("dst like '%#Nation%'")), present, lineage.folder(w.spark)))
    old = formats.read_edges(w.spark, _text_file(lists(e.filter("dst like '%#Region%'")), F.to_json(F.struct(F.col("m").alias("forward"))), lineage.folder(w.spark)))
    return new.union(old.select(F.concat(F.lit("flat "), "src").alias("src"), "dst"))


@query(oracle(" SELECT file_path, sha1(text) AS sha1 FROM doc_new", "doc_new"))
def hash_cache(w: Workspace) -> DataFrame:
    rows = formats.content_hashes(w.doc_new()).agg(F.map_from_entries(F.collect_list(F.struct("file_path", "sha1"))).alias("m"))
    return formats.read_hashes(w.spark, _text_file(rows, F.to_json("m"), lineage.folder(w.spark)))


_METADATA = ['{"projectHash": "a1", "createdAt": "2024-01-01T00:00:00.000Z", "version": "1.0.0"}', '{"projectHash": "", "createdAt": "2024"}', '{"projectHash": "b"}', "{}", " [] ", "", "not json"]


@query("SELECT 0 AS at, 'a1' AS project_hash, '2024-01-01T00:00:00.000Z' AS created_at, '1.0.0' AS version")
def metadata_cache(w: Workspace) -> DataFrame:
    """Broken, empty and missing files give no row."""
    one = w.spark.range(1)
    found = [formats.read_metadata(w.spark, _text_file(one, F.lit(x), lineage.folder(w.spark))).withColumn("at", F.lit(k)) for k, x in enumerate(_METADATA)]
    found.append(formats.read_metadata(w.spark, lineage.folder(w.spark)).withColumn("at", F.lit(99)))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.select("at", "project_hash", "created_at", "version")


# Sinks.


@query(oracle(f" SELECT {_CACHED} FROM star_symbols WHERE tbl <> 'region'", "star_symbols"))
def stored_symbols(w: Workspace) -> DataFrame:
    """An empty table first, then all symbols, then all but the regions' in their place."""
    folder, columns = lineage.folder(w.spark), _CACHED.split(", ")
    formats.ensure_cache(w.spark, folder)
    s = w.star_symbols()
    for rows in (s, s.filter("tbl <> 'region'")):
        formats.write_symbols(rows.select(*columns), folder)
    return w.spark.read.parquet(f"{folder}/symbols").select(*columns)


@query(oracle(" SELECT src, dst, 'present' AS section FROM star_edges WHERE dst LIKE '%#Region%' UNION ALL SELECT src, dst, 'future' FROM star_edges", "star_edges"))
def stored_edges(w: Workspace) -> DataFrame:
    """Writing a section again leaves the other one."""
    folder, e = lineage.folder(w.spark), w.star_edges()
    formats.write_edges(e, folder)
    formats.write_edges(e, folder, "future")
    formats.write_edges(e.filter("dst like '%#Region%'"), folder)
    return w.spark.read.parquet(f"{folder}/edges").select("src", "dst", "section")


@query(oracle(" SELECT file_path, sha1(text) AS sha1 FROM doc_old", "doc_old"))
def stored_hashes(w: Workspace) -> DataFrame:
    folder = lineage.folder(w.spark)
    for rows in (w.doc_new(), w.doc_old()):
        formats.write_hashes(formats.content_hashes(rows), folder)
    return w.spark.read.parquet(f"{folder}/hashes")


@query(
    "SELECT * FROM (VALUES ('missing', false, false), ('made', true, false), ('written', true, true), ('other project', true, false), ('no edges', true, false)) t(step, ready, valid)"
)
def cache_states(w: Workspace) -> DataFrame:
    """Whether caches are there, and whether they may be used: same project, symbols and edges not empty."""
    spark, folder, settings = w.spark, lineage.folder(w.spark), '{"include": ["src"]}'
    own, rows = formats.project_hash(settings), []

    def look(step: str, hash_: str = own) -> None:
        ready = formats.cache_ready(spark, folder)
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        kept = [r.project_hash for r in read("metadata").limit(1).collect()] if ready else []
        rows.append((step, ready, bool(kept) and incremental.cache_valid(read("symbols"), read("edges"), kept[0], hash_)))

    look("missing")
    formats.ensure_cache(spark, folder)
    look("made")
    formats.write_symbols(w.star_symbols(), folder)
    formats.write_edges(w.star_edges(), folder)
    formats.write_metadata(spark, folder, own)
    look("written")
    look("other project", formats.project_hash(None))
    formats.write_edges(w.star_edges().limit(0).union(spark.createDataFrame([], "src string, dst string")), folder)
    formats.write_symbols(w.star_symbols().limit(0), folder)
    look("no edges")
    return spark.createDataFrame(rows, "step string, ready boolean, valid boolean")


@query(f"SELECT '{hashlib.sha256(b'{}').hexdigest()}' AS known, 'unknown' AS missing")
def project_hashes(w: Workspace) -> DataFrame:
    return w.spark.range(1).select(F.lit(formats.project_hash("{}")).alias("known"), F.lit(formats.project_hash(None)).alias("missing"))


@query(report_sql("SELECT count(*) FILTER (role = 'root') AS roots, count(*) FILTER (exported OR role = 'root') AS apis, count(DISTINCT rel_path) AS modules, count(*) FILTER (NOT indexed) AS unknown FROM listed"))
def stored_report(w: Workspace) -> DataFrame:
    """Figures of a report that was written as JSON and read again, all of it by sections."""
    edges, roots, listed = _parts(w)
    listed, folder = lineage.cut(listed), lineage.folder(w.spark)  # asked for by every section
    formats.write_report_sections(report.sections(listed, roots, edges), report.summary(listed), "edit", folder)

    def entries(section: str, schema: str, *figures: Column) -> DataFrame:
        text = w.spark.read.text(f"{folder}/impact/{section}")
        return text.select(F.from_json("value", schema).alias("d")).agg(*figures)

    apis = entries("impacted_apis", "struct<role: string>", F.count_if(F.col("d.role") == "root").alias("roots"), F.count("*").alias("apis"))
    modules = entries("impacted_modules", "struct<rel_path: string>", F.count("d.rel_path").alias("modules"))
    unknown = entries("impact_zones", "struct<zone: string>", F.count_if(F.col("d.zone") == "unknown").alias("unknown"))
    return apis.crossJoin(modules).crossJoin(unknown)  # one row each


@query("SELECT event_type AS type, arg_max(event_id, event_id) AS payload FROM events GROUP BY event_type")
def state_replay(w: Workspace) -> DataFrame:
    return formats.latest_by_type(w.table("events").select(F.col("event_type").alias("type"), F.col("event_id").alias("ts"), F.col("event_id").alias("payload")))


# Reports in their order, and the state from scratch.


@query(
    report_sql(
        """SELECT *, row_number() OVER (ORDER BY root_count DESC, total DESC, rel_path) - 1 AS rank FROM (SELECT rel_path, count(*) FILTER (role = 'root') AS root_count, count(*) FILTER (role = 'direct') AS direct_count,
count(*) FILTER (role = 'indirect') AS indirect_count, count(*) AS total FROM listed GROUP BY rel_path)"""
    )
)
def module_order(w: Workspace) -> DataFrame:
    return report.ranked_modules(_parts(w)[2])


@query(
    report_sql(
        """SELECT symbol_id, level, row_number() OVER (ORDER BY CASE level WHEN 'high' THEN 0 ELSE 1 END, CASE role WHEN 'root' THEN 0 WHEN 'direct' THEN 1 ELSE 2 END, symbol_id) - 1 AS rank
FROM (SELECT *, CASE WHEN role = 'root' AND reason IN ('deleted', 'signature-ripple') THEN 'high' WHEN role <> 'root' AND depth >= 3 THEN 'medium' END AS level FROM listed) WHERE level IS NOT NULL"""
    )
)
def risk_order(w: Workspace) -> DataFrame:
    return report.ranked_risks(_parts(w)[2]).select("symbol_id", "level", "rank")


@query(oracle(" SELECT id, CASE WHEN k % 3 = 0 THEN 'again' ELSE kind END AS kind, k AS ord FROM star_symbols WHERE tbl = 'orders'", "star_symbols"))
def rebuilt_state(w: Workspace) -> DataFrame:
    """Repeated declarations: the last one's values at the first one's place."""
    s = w.star_symbols().filter("tbl = 'orders'").select("id", "kind", F.col("k").alias("ord"), "k")
    again = s.filter("k % 3 = 0").select("id", F.lit("again").alias("kind"), (F.col("ord") + F.lit(1 << 40)).alias("ord"), "k")
    return incremental.rebuild(s.union(again).select("id", "kind", "ord"), w.star_edges()).symbols.select("id", "kind", "ord")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("file_path").alias("id"), F.sha1("text").alias("signature_hash"))


@query("SELECT 'other' AS scope, true AS ripples UNION ALL SELECT 'same', false UNION ALL SELECT 'more', false")
def ripple_trigger(w: Workspace) -> DataFrame:
    """Whether dependents must be looked at: changed and removed symbols count, new ones don't."""
    old, new = _hashed(w.doc_old()), _hashed(w.doc_new())
    pairs = {"other": (old, new), "same": (new, new), "more": (new.limit(0), new)}
    return w.spark.createDataFrame([(k, diff.ripples(diff.signature_diff(*p))) for k, p in pairs.items()], "scope string, ripples boolean")


@query(oracle(" SELECT id FROM star_symbols WHERE NOT (tbl = 'orders' AND k % 4 = 1)", "star_symbols"))
def shadow_index(w: Workspace) -> DataFrame:
    """The index without what one of two intents deletes."""
    s = w.star_symbols()
    intents = w.spark.createDataFrame([(1, "delete"), (2, "delete"), (3, "modify")], "intent_id long, change_type string")
    resolved = s.filter("tbl = 'orders'").select((F.col("k") % 4).alias("intent_id"), F.col("id").alias("symbol_id"))
    return intent.without_deleted(intents, resolved, s.select("id"), 1)


@query(
    f"""SELECT c_custkey AS k, replace(replace('{intent.PROMPT}', '{{context}}', CASE WHEN c_custkey % 2 = 0 THEN 'Use only names and paths of this list; leave a list empty if nothing fits.' || chr(10) || 'seen ' || c_custkey ELSE '' END), '{{prompt}}', c_name) AS text FROM customer"""
)
def model_prompt(w: Workspace) -> DataFrame:
    context = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("seen "), F.col("c_custkey").cast("string")))
    return w.table("customer").select(F.col("c_custkey").alias("k"), intent.prompt_text(F.col("c_name"), context).alias("text"))


# Events that reach the state.


@query(
    _FILES
    + """SELECT '/ws/base.ts#Base' AS id UNION ALL SELECT '/ws/base.ts#Kind' UNION ALL SELECT file_path || '#new' || k FROM f WHERE k % 3 = 0
UNION ALL SELECT file_path || '#' || x FROM (SELECT file_path, unnest(['help' || k, 'C' || k, 'C' || k || '.run', 'C' || k || '.size', 'Tone' || k, 'make' || k]) AS x FROM f WHERE k % 3 = 2)"""
)
def event_upkeep(w: Workspace) -> DataFrame:
    """Symbols after a stream of edits (unsaved text) and deletions over a project."""
    spark, log, events = w.spark, lineage.folder(w.spark), lineage.folder(w.spark)
    upkeep.put(spark, log, 0, _sources(w), "/ws", whole=True)
    c = w.table("customer").filter("c_custkey % 3 < 2")
    edit = F.col("c_custkey") % 3 == 0
    path = F.concat(F.lit("/ws/c"), F.col("c_custkey").cast("string"), F.lit(".ts"))
    text = F.when(edit, F.concat(F.lit("function new"), F.col("c_custkey").cast("string"), F.lit("() { return Base }")))
    rows = c.select(F.col("c_custkey").cast("long").alias("event_id"), F.current_timestamp().alias("ts"), F.when(edit, "edit").otherwise("delete").alias("kind"), path.alias("file_path"), text.alias("content"))
    rows.write.parquet(events)
    upkeep.follow(spark.readStream.schema(rows.schema).parquet(events), log, "/ws", lineage.folder(spark)).awaitTermination()
    return upkeep.current(spark, log).symbols.select("id")


_NAMES = "unnest(['help' || k, 'C' || k, 'C' || k || '.run', 'C' || k || '.size', 'Tone' || k, 'make' || k])"


@query(
    _FILES
    + f""", own AS (SELECT k, file_path, '/ws/m' || k || '.ts' AS moved, {_NAMES} AS name FROM f),
refs AS ({" UNION ALL ".join(f"SELECT k, file_path || {src} AS src, {dst} AS dst FROM f" for src, dst in _REFERENCES)}),
fresh AS (SELECT file_path || CASE k % 4 WHEN 0 THEN '#e' ELSE '#N' END || k AS id FROM f WHERE k % 4 IN (0, 2) UNION ALL SELECT moved || '#' || name FROM own WHERE k % 4 = 1)
SELECT 'symbol' AS what, '/ws/base.ts#Base' AS id UNION ALL SELECT 'symbol', '/ws/base.ts#Kind' UNION ALL SELECT 'symbol', file_path || '#' || name FROM own WHERE k % 4 = 3
UNION ALL SELECT 'symbol', id FROM fresh UNION ALL SELECT 'added', id FROM fresh
UNION ALL SELECT 'removed', file_path || '#' || name FROM own WHERE k % 4 < 3
UNION ALL SELECT DISTINCT 'before', dst || '<' || src FROM refs WHERE k % 4 < 3 AND NOT starts_with(dst, '/ws/base.ts')"""
)
def stream_moves(w: Workspace) -> DataFrame:
    """A micro-batch of edits that are saved without text, renames, and files that go and come back: the symbols after it,
    its signature changes, and the dependents that removed symbols had."""
    spark, log, events = w.spark, lineage.folder(w.spark), lineage.folder(w.spark)
    upkeep.put(spark, log, 0, _sources(w), "/ws", whole=True)
    k = F.col("c_custkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    path, none = text("/ws/c", k, ".ts"), F.lit(None).cast("string")
    row = lambda n, kind, path, content=none, old=none: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), path.alias("file_path"), content.alias("content"), old.alias("old_path"))
    edited = F.array(row(0, "edit", path, text("function e", k, "() { return Base }")), row(1, "save", path))
    moved = F.array(row(0, "rename", text("/ws/m", k, ".ts"), none, path))
    again = F.array(row(0, "delete", path), row(1, "create", path, text("class N", k, " {}")))
    rows = w.table("customer").filter(k % 4 < 3).select(k.alias("k"), F.explode(F.when(k % 4 == 0, edited).when(k % 4 == 1, moved).otherwise(again)).alias("e"))
    rows = rows.select((F.col("k") * 2 + F.col("e.n")).cast("long").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), "e.kind", "e.file_path", "e.content", "e.old_path")
    rows.coalesce(1).write.parquet(events)
    upkeep.follow(spark.readStream.schema(rows.schema).parquet(events), log, "/ws", lineage.folder(spark)).awaitTermination()
    did = upkeep.changed(spark, log, 1)
    found = did.state.symbols.select(F.lit("symbol").alias("what"), "id").union(did.changes.select("change", "symbol_id"))
    return found.union(did.before.select(F.lit("before"), F.concat("removed_id", F.lit("<"), "src")))


@query("SELECT '.git/HEAD' AS path, true AS ref, false AS staging UNION ALL SELECT '.git/refs/heads/a/b', true, false UNION ALL SELECT '.git/index', false, true UNION ALL SELECT 'src/HEAD', false, false")
def event_triggers(w: Workspace) -> DataFrame:
    paths = w.spark.createDataFrame([(".git/HEAD",), (".git/refs/heads/a/b",), (".git/index",), ("src/HEAD",)], "path string")
    return paths.select("path", E.is_ref(F.col("path")).alias("ref"), E.is_staging(F.col("path")).alias("staging"))
