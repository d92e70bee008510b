"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place on one machine
    (``local`` masters); a cluster's machines would not see each other's, so
    there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="geolode-")
        spark.conf.set("spark.checkpoint.dir", named)
    spark.sparkContext.setCheckpointDir(named)
    return named


#: Paths written so far and not yet removed, oldest first.
_FILES: list[str] = []


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the cluster's own cleaning takes over
        pass


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage, so that a lost executor costs only the tasks that read
    the files. The files go when the driver's Python ends, or with ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geolode-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    _FILES.append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files() -> list[str]:
    """What ``written`` holds now."""
    return list(_FILES)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Removes files of ``written`` that nothing will read again."""
    for path in paths:
        if path in _FILES:
            _FILES.remove(path)
            _forget(spark, path)


def n_words(text) -> F.Column:
    """Words of a text, 0 for null: the gaps that a word follows, plus a leading word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text) -> F.Column:
    """Lower-cases A-Z only, as no other letters are to change."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
