"""Change events: debounce, routing, suppression of own writes, latest wins; in batch and as streams.

Events have ts, kind, file_path, handler and event_id.  A handler has one timer for all files, as an editor's listener
has, so a session's last event is what it processes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tremor.operators.numbering import parted

#: Silence before a handler fires, and how long a save hides the external change that follows it.
GAPS = {"edit": "300 milliseconds", "external": "400 milliseconds", "staging": "400 milliseconds", "refs": "600 milliseconds"}
OWN_SAVE = "5000 milliseconds"

#: What handles an event of each kind; external creations and deletions have no handler.
ROUTES = {"edit": "change", "save": "note-save", "create": "create", "delete": "delete", "rename": "rename", "external": "create", "staging": "staged-analysis", "refs": "rebuild"}


def gap_of(kind: Column, gaps: dict[str, str] = GAPS, default: str = "0 milliseconds") -> Column:
    out = F.lit(default)
    for k, g in gaps.items():
        out = F.when(kind == k, g).otherwise(out)
    return out


def debounce(events: DataFrame, gap: str | Column) -> DataFrame:
    """One row for each burst: handler, started, fires, event_id, file_path, kind of the burst's last event, n_events.

    A handler's events are dealt by ranges of time, so that one handler is no single task.  Works on a stream as well (with
    a watermark on ts for append mode); then a burst is out once the watermark passes it, and a handler is one task.
    """
    if events.isStreaming:
        last = F.max_by(F.struct("event_id", "file_path", "kind"), F.struct("ts", "event_id")).alias("e")
        bursts = events.groupBy("handler", F.session_window("ts", gap).alias("w")).agg(last, F.count("*").alias("n_events"))
        return bursts.select("handler", F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "e.event_id", "e.file_path", "e.kind", "n_events")
    return _opened(_joined(_single(events, gap)))


def _single(events: DataFrame, gap: str | Column) -> DataFrame:
    """Each event as a burst of its own."""
    fires = F.col("ts") + (F.lit(gap) if isinstance(gap, str) else gap).cast("interval")
    own = events.select("handler", F.col("ts").alias("started"), fires.alias("fires"), F.struct("ts", "event_id", "file_path", "kind").alias("e"), F.lit(1).cast("long").alias("n_events"))
    return own.filter("fires > started")


def _joined(bursts: DataFrame) -> DataFrame:
    """Bursts (handler, started, fires, e, n_events) with those that overlap made one.

    Ranges carry on what the ranges before them leave: the time up to which a handler waits, and when its last burst began.
    """
    dealt = parted(bursts, "handler", "started", "e.event_id")
    own, upto = Window.partitionBy("_part", "handler").orderBy("started", "_at"), (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("handler").orderBy("_part").rowsBetween(*upto)

    def with_before(df: DataFrame, value: str, name: str) -> DataFrame:
        """df with the largest value of the handler's ranges before; a row for each range and handler is looked up."""
        each = df.groupBy("_part", "handler").agg(F.max(value).alias("_v")).select("_part", F.col("handler").alias("_h"), F.max("_v").over(earlier).alias(name))
        return df.join(each.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col("handler").eqNullSafe(F.col("_h")), "left").drop("_p", "_h")

    waits = with_before(dealt, "fires", "_before").withColumn("_waits", F.greatest("_before", F.max("fires").over(own.rowsBetween(*upto))))
    began = waits.withColumn("_began", F.when(F.col("_waits").isNull() | (F.col("started") >= F.col("_waits")), F.col("started"))).drop("_before", "_waits")
    found = with_before(began, "_began", "_open").withColumn("_began", F.coalesce(F.max("_began").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_open"))
    return found.groupBy("handler", F.col("_began").alias("started")).agg(F.max("fires").alias("fires"), F.max("e").alias("e"), F.sum("n_events").alias("n_events"))


def _opened(bursts: DataFrame) -> DataFrame:
    return bursts.select("handler", "started", "fires", "e.event_id", "e.file_path", "e.kind", "n_events")


def debounce_stream(events: DataFrame, gap: str | Column, folder: str, checkpoint: str, **trigger):
    """Bursts of a stream, kept in ``folder``; ``stored_bursts`` gives them.

    A micro-batch writes its own bursts and holds no state, so that late events count and a handler is many tasks.  A batch
    that runs again takes the place of its first run.
    """

    def batch(df: DataFrame, number: int) -> None:
        _joined(_single(df, gap)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """The bursts of all micro-batches so far, as ``debounce`` gives them."""
    return _opened(_joined(spark.read.parquet(folder).drop("batch")))


def route(events: DataFrame) -> DataFrame:
    """Events with their action; kinds without one are dropped."""
    out = F.lit(None).cast("string")
    for kind, action in ROUTES.items():
        out = F.when(F.col("kind") == kind, action).otherwise(out)
    return events.withColumn("action", out).filter("action is not null")


#: Files whose change means another commit is checked out.
REFS = r"(^|/)\.git/(HEAD|ORIG_HEAD|MERGE_HEAD|FETCH_HEAD|refs/heads/.+)$"


def is_ref(path: Column) -> Column:
    return path.rlike(REFS)


def is_staging(path: Column) -> Column:
    return path.rlike(r"(^|/)\.git/index$")


def suppress_own_saves(events: DataFrame, within: str = OWN_SAVE) -> DataFrame:
    """Events without the external changes of files that were saved up to ``within`` before (both ends count)."""
    order = Window.partitionBy("file_path").orderBy(F.col("ts").cast("timestamp")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    saved = F.max(F.when(F.col("kind") == "save", F.col("ts"))).over(order)
    own = (F.col("kind") == "external") & (F.col("ts") <= saved + F.expr(f"interval {within}"))
    return events.withColumn("own", F.coalesce(own, F.lit(False))).filter("not own").drop("own")


def suppress_own_saves_stream(external: DataFrame, saves: DataFrame, within: str = OWN_SAVE, late: str = "10 seconds") -> DataFrame:
    """The same for two streams: an outer join in time whose matched rows are dropped."""
    e = external.withWatermark("ts", late).alias("e")
    s = saves.select(F.col("file_path").alias("saved_path"), F.col("ts").alias("saved_at")).withWatermark("saved_at", late)
    near = (F.col("file_path") == F.col("saved_path")) & (F.col("saved_at") <= F.col("ts")) & (F.col("saved_at") >= F.col("ts") - F.expr(f"interval {within}"))
    return e.join(s, near, "left_outer").filter("saved_path is null").drop("saved_path", "saved_at")


def latest_wins(runs: DataFrame) -> DataFrame:
    """Runs (key, started, ended) whose result may show: no newer run of the key started before they ended."""
    newer = F.lead("started").over(Window.partitionBy("key").orderBy("started", "run_id"))
    return runs.withColumn("newer", newer).filter("newer is null or newer > ended").drop("newer")


def apply_stream(events: DataFrame, handle: Callable[[str, DataFrame], None], checkpoint: str, **trigger):
    """Run ``handle(action, events of that action)`` for each micro-batch, in the order of ROUTES.

    The query is at-least-once: a handler must be able to see a batch again, as upserts by file are.
    """

    def batch(df: DataFrame, _: int) -> None:
        routed = route(df).persist()
        try:
            for action in dict.fromkeys(ROUTES.values()):
                own = routed.filter(F.col("action") == action)
                if not own.isEmpty():
                    handle(action, own)
        finally:
            routed.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
