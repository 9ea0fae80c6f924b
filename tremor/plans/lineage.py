"""Cutting lineage inside iterative plans, in a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _top(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder under the warehouse, on one machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return top or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tremor-checkpoints"


def folder(spark: SparkSession) -> str:
    """A new folder for a stream's state."""
    return f"{_top(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder; a lost executor costs no earlier step."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_top(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df computed once, dealt by the keys and sorted by them, and kept so that joins by them neither shuffle nor sort it.

    A plan that adapts itself does not say how its rows are dealt, so this step, a shuffle that is counted out, does not adapt.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(parts, *keys).sortWithinPartitions(*keys))
    finally:
        conf.set(name, was)
