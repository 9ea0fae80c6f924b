"""Latest wins on a stream: results of runs that a newer run of their key overtook are dropped, with bounded state.

A run (key, run_id, started, ended) may show if no newer run of its key started up to its end; runs are ordered by
(started, run_id).  The stream is watermarked on ``started``.  A run is decided once the watermark has passed its end, as
all runs that could overtake it are in by then; a timer in event time brings the key up then.  A key's state holds its
undecided runs, and the starts of decided ones until the watermark has passed them: after that nothing older can come.

The result does not depend on the order in which runs arrive, and equals ``events.latest_wins`` over the runs that were
not later than the watermark allows.  Rows with a null in key, run_id, started or ended are dropped; a run that is read
twice (same run_id and start) counts once; a key's last runs wait for the watermark.

There are two forms.  ``latest_wins_stream`` has a state and a timer for each key: a micro-batch costs some 10 ms or more
for each key it brings up, in a Python worker, so it suits few keys.  ``latest_wins_batches`` holds the state as a table
that each micro-batch reads and writes whole, in Spark's functions alone; it suits large micro-batches of many keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "key string, run_id long, started timestamp, ended timestamp"
#: Starts, ids and ends in microseconds, and whether a run is decided.
_STATE = "started array<long>, run array<long>, ended array<long>, done array<boolean>"


def _micros(x: pd.Series) -> list[int]:
    return (x.astype("datetime64[us]").astype("int64")).tolist()


def _decide(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All runs of a key that the watermark lets decide, in order."""
    held = {(s, r): (e, d) for s, r, e, d in zip(*state.get, strict=True)} if state.exists else {}
    for part in parts:
        for s, r, e in zip(part["started_us"].tolist(), part["run_id"].tolist(), part["ended_us"].tolist(), strict=True):
            held.setdefault((s, r), (e, False))
    mark = state.getCurrentWatermarkMs() * 1000
    runs = sorted(held)
    shown, kept = [], []
    for i, (s, r) in enumerate(runs):
        e, done = held[s, r]
        overtaken = i + 1 < len(runs) and runs[i + 1][0] <= e
        if not done and not overtaken and e < mark:
            shown.append((key[0], r, s, e))
            done = True
        done = done or overtaken  # what came later can only overtake it again
        if not done or s >= mark:
            kept.append((s, r, e, done))
    open_ = [e for _, _, e, done in kept if not done] + [s for s, _, _, done in kept if done]
    if kept:
        state.update(tuple(list(x) for x in zip(*kept, strict=True)))
        state.setTimeoutTimestamp(max(min(open_) // 1000, state.getCurrentWatermarkMs()) + 1)
    elif state.exists:
        state.remove()
    if shown:
        out = pd.DataFrame(shown, columns=["key", "run_id", "started", "ended"])
        for c in ("started", "ended"):
            out[c] = pd.to_datetime(out[c], unit="us")
        yield out


def _runs(runs: DataFrame) -> DataFrame:
    """The runs with RESULT's columns, without those that lack one."""
    rows = runs.select(F.col("key").cast("string").alias("key"), F.col("run_id").cast("long").alias("run_id"), F.col("started").cast("timestamp").alias("started"), F.col("ended").cast("timestamp").alias("ended"))
    return rows.filter("key is not null and run_id is not null and started is not null and ended is not null")


def latest_wins_stream(runs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of the runs (RESULT) that may show; for append mode."""
    rows = _runs(runs).withWatermark("started", late)
    rows = rows.withColumn("started_us", F.unix_micros("started")).withColumn("ended_us", F.unix_micros("ended"))
    return rows.groupBy("key").applyInPandasWithState(_decide, RESULT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: Runs as a micro-batch leaves them: done are those that were overtaken or decided before; of them the end is left out.
_SEEN = f"{RESULT}, done boolean"
_NEVER = -(2**63)


def _seen(spark: SparkSession, path: str, late: str) -> tuple[DataFrame, int]:
    """What a micro-batch has left, and the watermark after it in microseconds; the run that sets it is always held."""
    rows = spark.read.schema(_SEEN).parquet(path)
    mark = rows.agg(F.unix_micros(F.max("started") - F.expr(f"interval {late}"))).first()[0]
    return rows, _NEVER if mark is None else mark


def latest_wins_batches(runs: DataFrame, folder: str, checkpoint: str, late: str = "10 minutes", **trigger):
    """Runs of a stream that may show, kept in ``folder``; ``shown_runs`` gives them.

    A micro-batch's own runs move the watermark before it decides.  It reads what the one before it has left and writes
    beside it: one that runs again takes the place of its first run, and there are never more than two copies of the state.
    """
    order = Window.partitionBy("key").orderBy("started", "run_id")
    copies = Window.partitionBy("key").orderBy("started", "run_id", "_new", "ended")  # sorted once for both
    passed = lambda mark: F.unix_micros("ended") < mark

    def batch(df: DataFrame, number: int) -> None:
        own, rows = f"{folder}/seen-{number % 2}", df.withColumn("done", F.lit(False)).withColumn("_new", F.lit(True))
        if number:
            before, mark = _seen(df.sparkSession, f"{folder}/seen-{(number - 1) % 2}", late)
            held = before.withColumn("done", F.col("done") | passed(mark)).filter(~F.col("done") | (F.unix_micros("started") >= mark))
            rows = rows.filter(F.unix_micros("started") > mark).unionByName(held.withColumn("_new", F.lit(False)))
        again = (F.lag("started").over(copies) == F.col("started")) & (F.lag("run_id").over(copies) == F.col("run_id"))
        once = rows.withColumn("_again", F.coalesce(again, F.lit(False))).filter("not _again").drop("_again", "_new")
        done = once.withColumn("done", F.col("done") | F.coalesce(F.lead("started").over(order) <= F.col("ended"), F.lit(False)))
        done.withColumn("ended", F.when(~F.col("done"), F.col("ended"))).write.mode("overwrite").parquet(own)
        seen, mark = _seen(df.sparkSession, own, late)
        seen.filter(~F.col("done") & passed(mark)).drop("done").write.mode("overwrite").parquet(f"{folder}/shown/batch={number}")

    return _runs(runs).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def shown_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs (RESULT) that all micro-batches so far have decided to show."""
    return spark.read.schema(RESULT).parquet(f"{folder}/shown").select("key", "run_id", "started", "ended")
