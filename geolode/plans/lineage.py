"""Cutting lineage in loops, through the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame


def materialized(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place on one machine
    (``local`` masters) only: a cluster's machines would not see each other's.
    """
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="geolode-")
        spark.conf.set("spark.checkpoint.dir", named)
    spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)


@contextmanager
def shuffled_joins(spark):
    """Joins that run inside take shuffles only: what is broadcast goes through the driver, which a chain of many plans fills."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, was)
