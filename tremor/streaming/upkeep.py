"""The index and graph kept up by a stream of change events.

What is known of the files is a log in a folder.  A version holds the files that changed, with their text, symbols and
edges, or, as a *snapshot*, all files.  What holds now is, for each file, what its last version since the last snapshot
says; ``compact`` writes the state as a snapshot, so that no read goes further back.  A version counts once its mark is
in the manifest, an empty file that is written last; a micro-batch that runs again writes its version over.

All tables are dealt to BUCKETS folders by a hash of the path of the file they belong to, and edges are there twice: by
the file they start from and by the file they lead to.  So a micro-batch reads the folders of its own files, of files
that they import, and of files that depend on symbols that go; it writes its own files only.

Events are taken in the order of (ts, event_id).  A file's text is the last text that an event since its last deletion
has; without one, that of ``disk``, then the one known from before (not after a deletion).  A file that has none is gone.
A rename (old_path, file_path) deletes the old path and creates the new one with the text it had, if the event has none.
A change of commit (action 'rebuild') reads all files of ``disk`` again; events before it count no more, events after it
do.  Without ``disk`` it is ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremor.operators import diff
from tremor.operators.incremental import Changed, State
from tremor.plans.lineage import cut
from tremor.sources import scripts
from tremor.sources.formats import EDGES, SYMBOLS
from tremor.streaming.events import is_ref, is_staging, route

Disk = Callable[[], DataFrame]
BUCKETS = 64
#: Versions after a snapshot from which on ``follow`` writes the next one.
COMPACT = 16


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


_TABLES = {
    "files": "file_path string, content string, version long, bucket int",
    "symbols": _ddl(SYMBOLS) + ", version long, bucket int",
    "edges": "file_path string, " + _ddl(EDGES) + ", version long, bucket int",
    "back": "file_path string, " + _ddl(EDGES) + ", version long, bucket int",
    "changes": "symbol_id string, change string, version long, bucket int",
    "before": "removed_id string, src string, version long, bucket int",
}


def bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def path_of(symbol_id: Column) -> Column:
    return F.regexp_replace(symbol_id, "#[^#]*$", "")


def _buckets(paths: DataFrame) -> list[int]:
    """Buckets of the paths (first column); BUCKETS numbers at most."""
    return [r[0] for r in paths.select(bucket(F.col(paths.columns[0]))).distinct().collect()]


class Version(NamedTuple):
    number: int
    whole: bool

    @property
    def name(self) -> str:
        return f"{self.number:012d}-{'snapshot' if self.whole else 'delta'}"


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, folder: str) -> list[Version]:
    """All versions of the manifest, by number; a snapshot comes after a delta of its number."""
    fs, where = _hadoop(spark, f"{folder}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(Version(int(n.split("-")[0]), n.endswith("snapshot")) for n in names if "-" in n)


def _needed(spark: SparkSession, folder: str, before: int | None) -> list[Version]:
    """The last snapshot and what came after it."""
    known = [v for v in versions(spark, folder) if before is None or v.number < before]
    last = max((v.number for v in known if v.whole), default=-1)
    return [v for v in known if v.number > last or (v.whole and v.number == last)]


def _read(spark: SparkSession, folder: str, name: str, of: list[Version], buckets: list[int] | None) -> DataFrame:
    if not of:
        return spark.createDataFrame([], _TABLES[name])
    top = f"{folder}/data/{name}"
    rows = spark.read.schema(_TABLES[name] + ", at string").option("basePath", top).parquet(*(f"{top}/at={v.name}" for v in of)).drop("at")
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


class Known(NamedTuple):
    """What the log says: texts of files, symbols, edges by the file they start from, also those to what doesn't stand."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame


def known(spark: SparkSession, folder: str, before: int | None = None, buckets: list[int] | None = None) -> Known:
    """What all versions say, or those before one; of all files, or of those in some buckets."""
    of = _needed(spark, folder, before)
    last = _last(spark, folder, of, buckets)
    own = lambda name: _read(spark, folder, name, of, buckets).join(last, ["file_path", "version"], "left_semi")
    texts = own("files").filter("content is not null").select("file_path", "content", "version")
    return Known(texts, own("symbols").select(*SYMBOLS.names), own("edges").select("file_path", "src", "dst"))


def _last(spark: SparkSession, folder: str, of: list[Version], buckets: list[int] | None) -> DataFrame:
    return _read(spark, folder, "files", of, buckets).groupBy("file_path").agg(F.max("version").alias("version"))


def current(spark: SparkSession, folder: str, before: int | None = None) -> State:
    """The state after all versions, or after those before one. Edges to symbols that don't stand are left out."""
    now = known(spark, folder, before)
    return State(now.symbols, now.edges.join(now.symbols.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))


def _dependents(spark: SparkSession, folder: str, of: list[Version], removed: DataFrame) -> DataFrame:
    """Dependents (removed_id, src) of removed ids, from the folders that lead to their files."""
    where = _buckets(removed.select(path_of(F.col("id"))))
    if not where:
        return spark.createDataFrame([], "removed_id string, src string")
    own = _read(spark, folder, "back", of, where)
    asked = cut(own.join(removed.select(F.col("id").alias("dst")), "dst", "left_semi"))
    last = _last(spark, folder, of, _buckets(asked.select("file_path")))
    return asked.join(last, ["file_path", "version"], "left_semi").select(F.col("dst").alias("removed_id"), "src").distinct()


def _write(spark: SparkSession, folder: str, version: Version, **tables: DataFrame) -> None:
    """Write a version, its tables side by side, and then its mark."""

    def one(name: str, rows: DataFrame) -> None:
        where = {"back": path_of(F.col("dst")), "changes": path_of(F.col("symbol_id")), "before": path_of(F.col("removed_id"))} if name in ("back", "changes", "before") else {}
        out = rows.withColumn("bucket", bucket(where.get(name, F.col("file_path"))))
        if "version" not in out.columns:
            out = out.withColumn("version", F.lit(version.number).cast("long"))
        names = [x.split()[0] for x in _TABLES[name].split(", ")]
        out.select(*names).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/{name}/at={version.name}")

    with ThreadPoolExecutor(len(tables)) as pool:
        for done in [pool.submit(one, *x) for x in tables.items()]:
            done.result()
    fs, mark = _hadoop(spark, f"{folder}/manifest/{version.name}")
    fs.create(mark, True).close()


def put(spark: SparkSession, folder: str, version: int, files: DataFrame, root: str, whole: bool = False, strict: bool = False) -> None:
    """Write a version: files (file_path, content; null content: gone) are read and walked against all symbols then known.

    whole: they are all files there are; then no signature changes are kept.
    """
    files = cut(files.select(scripts.normal_path(F.col("file_path")).alias("file_path"), "content").filter("file_path is not null").dropDuplicates(["file_path"]))
    texts = files.filter("content is not null")
    read = scripts.read(texts)
    found = cut(scripts.extract_symbols(read).select(*SYMBOLS.names))
    of = _needed(spark, folder, version)
    if whole:
        around = found
    else:
        near = _buckets(files.select("file_path").union(scripts.import_targets(read)))
        around = known(spark, folder, version, near).symbols.join(files.select("file_path"), "file_path", "left_anti").select(*SYMBOLS.names).unionByName(found)
    edges = scripts.walk_references(read, around, root, strict)
    edges = cut(edges.join(found.select(F.col("id").alias("src"), "file_path").distinct(), "src").select("file_path", "src", "dst"))
    tables = {"files": files if not whole else texts, "symbols": found, "edges": edges, "back": edges}
    if not whole:
        old = known(spark, folder, version, near).symbols.join(files.select("file_path"), "file_path", "left_semi")
        changes = cut(diff.signature_diff(old, found))
        tables |= {"changes": changes, "before": _dependents(spark, folder, of, changes.filter("change = 'removed'").select(F.col("symbol_id").alias("id")))}
    _write(spark, folder, Version(version, whole), **tables)


def compact(spark: SparkSession, folder: str, version: int) -> None:
    """Write the state after a version as a snapshot."""
    now = known(spark, folder, version + 1)
    of = _needed(spark, folder, version + 1)
    last = _last(spark, folder, of, None)
    own = lambda name: _read(spark, folder, name, of, None).join(last, ["file_path", "version"], "left_semi")
    _write(spark, folder, Version(version, True), files=now.files, symbols=own("symbols").drop("bucket"), edges=own("edges").drop("bucket"), back=own("back").drop("bucket"))


def changed(spark: SparkSession, folder: str, version: int) -> Changed:
    """What a version did: the state after it, signature changes of its files, dependents of what is gone, from before."""
    of = [v for v in versions(spark, folder) if v == Version(version, False)]
    changes = _read(spark, folder, "changes", of, None).select("symbol_id", "change")
    return Changed(current(spark, folder, version + 1), changes, _read(spark, folder, "before", of, None).select("removed_id", "src"))


# Events of a micro-batch become a table of files.

def _steps(events: DataFrame) -> DataFrame:
    """file_path, at, dead, content, origin: a rename is a deletion and then a creation out of the old path."""
    old = F.col("old_path") if "old_path" in events.columns else F.lit(None).cast("string")
    events = events.withColumn("_old", scripts.normal_path(old)).withColumn("file_path", scripts.normal_path(F.col("file_path")))
    moves = F.col("action") == "rename"
    one = F.struct(F.lit(1).alias("part"), F.col("file_path").alias("p"), (F.col("action") == "delete").alias("dead"), F.when(F.col("action") != "delete", F.col("content")).alias("text"), F.when(moves, F.col("_old")).alias("origin"))
    two = F.struct(F.lit(0).alias("part"), F.col("_old").alias("p"), F.lit(True).alias("dead"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("origin"))
    rows = events.select("ts", "event_id", F.explode(F.when(moves & F.col("_old").isNotNull(), F.array(two, one)).otherwise(F.array(one))).alias("s")).select("ts", "event_id", "s.*")
    return rows.select(F.col("p").alias("file_path"), F.struct("ts", "event_id", "part").alias("at"), "dead", F.col("text").alias("content"), "origin").filter("file_path is not null")


def _alive(steps: DataFrame, upto: Column | None = None, *by: str) -> DataFrame:
    """For each path (and by): whether its last step is a deletion, whether there was one, and its steps since, newest first."""
    rows = steps if upto is None else steps.filter(upto)
    all_steps = F.reverse(F.array_sort(F.collect_list(F.struct("at", "dead", "content", "origin"))))  # a file's steps in one micro-batch
    each = rows.groupBy("file_path", *by).agg(all_steps.alias("s"))
    dead_at = F.array_position(F.transform("s", lambda x: x["dead"]), True).cast("int")
    since = F.when(dead_at == 0, F.col("s")).otherwise(F.slice("s", F.lit(1), F.greatest(dead_at - 1, F.lit(0))))
    return each.withColumn("since", since).withColumn("dead", F.col("s")[0]["dead"]).withColumn("fresh", dead_at > 0)


def _text_of(since: Column) -> Column:
    return F.get(F.filter(F.transform(since, lambda x: x["content"]), lambda c: c.isNotNull()), F.lit(0))


def _latest(events: DataFrame, kept: DataFrame | None, before: Callable[[list[int]], DataFrame]) -> DataFrame:
    """file_path, content of each file that events touch (null content: it is gone).

    kept: file_path, kept (texts on disk) or None; before: texts known from before, of the files in some buckets.
    """
    steps = cut(_steps(events))
    texts = before(_buckets(steps.select("file_path").union(steps.filter("origin is not null").select("origin")))).select("file_path", F.col("content").alias("former"))
    while True:  # a rename takes the text that its old path had then; a chain of renames takes a round for each link
        open_ = steps.filter("origin is not null and content is null")
        if open_.isEmpty():
            break
        asked = open_.select(F.col("origin").alias("file_path"), F.col("at").alias("upto"), F.col("file_path").alias("new_path"))
        # the old path's own deletion is a part of the rename: steps before it count
        earlier = F.struct("at.ts", "at.event_id") < F.struct("upto.ts", "upto.event_id")
        past = _alive(asked.join(steps, "file_path").filter(earlier), None, "new_path", "upto")
        waits = F.exists("since", lambda x: x["content"].isNull() & x["origin"].isNotNull()) & _text_of(F.col("since")).isNull()
        seen = asked.join(past, ["file_path", "new_path", "upto"], "left").join(texts, "file_path", "left")
        if kept is not None:
            seen = seen.join(kept, "file_path", "left")
        else:
            seen = seen.withColumn("kept", F.lit(None).cast("string"))
        old_text = F.coalesce(_text_of(F.col("since")), F.when(~F.coalesce("fresh", F.lit(False)), F.coalesce("former", "kept")))
        found = cut(seen.select(F.col("new_path").alias("file_path"), F.col("upto").alias("at"), old_text.alias("found"), F.coalesce(waits, F.lit(False)).alias("waits")).filter("not waits or found is not null"))
        if found.isEmpty():
            break
        joined = steps.join(found, ["file_path", "at"], "left")
        done = F.col("waits").isNotNull()
        steps = cut(joined.select("file_path", "at", "dead", F.coalesce("content", "found").alias("content"), F.when(~done, F.col("origin")).alias("origin")))
    now = _alive(steps).join(texts, "file_path", "left")
    now = now.join(kept, "file_path", "left") if kept is not None else now.withColumn("kept", F.lit(None).cast("string"))
    text = F.coalesce(_text_of(F.col("since")), "kept", F.when(~F.col("fresh"), F.col("former")))
    return now.select("file_path", F.when(~F.col("dead"), text).alias("content"))


def follow(
    events: DataFrame, folder: str, root: str, checkpoint: str, disk: Disk | None = None, on_staging: Callable[[State], None] | None = None,
    on_ripple: Callable[[Changed], None] | None = None, strict: bool = False, compact_every: int = COMPACT, **trigger,
):
    """Keep the log in folder up with a stream of events (event_id, ts, kind, file_path, content, and old_path if there are
    renames); returns the query.

    on_staging is called with the state after a micro-batch in which the staging area changed; on_ripple with what a
    micro-batch did (see ``changed``), if signatures changed or symbols went.
    """
    spark = events.sparkSession
    kind = F.when(is_ref(F.col("file_path")), "refs").when(is_staging(F.col("file_path")), "staging").otherwise(F.col("kind"))
    edits = ("change", "create", "delete", "note-save", "rename")

    def batch(df: DataFrame, number: int) -> None:
        version = number + 1  # 0 is what was there before the stream
        routed = cut(route(df.withColumn("kind", kind)))
        actions = {r.action for r in routed.select("action").distinct().collect()}  # as many as there are routes
        whole = "rebuild" in actions and disk is not None
        own = routed.filter(F.col("action").isin(*edits))
        if whole:
            last = routed.filter("action = 'rebuild'").agg(F.max(F.struct("ts", "event_id")).alias("last"))  # one row
            own = own.join(F.broadcast(last), F.struct("ts", "event_id") > F.col("last")).drop("last")
        kept = disk().select(scripts.normal_path(F.col("file_path")).alias("file_path"), F.col("content").alias("kept")) if disk is not None else None
        if whole or actions & set(edits):
            none = spark.createDataFrame([], "file_path string, content string")
            files = _latest(own, kept, lambda buckets: none if whole else known(spark, folder, version, buckets).files)
            if whole:
                files = kept.select("file_path", F.col("kept").alias("content")).join(files, "file_path", "left_anti").unionByName(files)
            put(spark, folder, version, files, root, whole=whole, strict=strict)
            if on_ripple is not None and not whole:
                did = changed(spark, folder, version)
                if diff.ripples(did.changes):
                    on_ripple(did)
            if len(_needed(spark, folder, version + 1)) > compact_every:
                compact(spark, folder, version)
        if "staged-analysis" in actions and on_staging is not None:
            on_staging(current(spark, folder, before=version + 1))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
