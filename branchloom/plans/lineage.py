"""Cutting lineage through tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = named or tempfile.mkdtemp(prefix="branchloom-")
        _OWN[app] = f"{base.rstrip('/')}/branchloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; leftovers then belong to the cluster's own clean-up
        pass


def materialize(df: DataFrame, label: str, condition: Column | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan that follows starts at files every executor can read, so a lost
    executor costs re-reading and not recomputing. Rows are counted as they
    are written; ``rows_of`` tells their number, ``rows_with`` that of those
    that meet ``condition``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(condition if condition is not None else F.lit(True)).alias("met")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._branchloom_path, out._branchloom_rows, out._branchloom_met = path, seen.get["n"], seen.get["met"]
    return out


def rows_of(df: DataFrame) -> int:
    """Number of rows of a materialized table, without a job; of any other by counting."""
    known = getattr(df, "_branchloom_rows", None)
    return df.count() if known is None else known


def rows_with(df: DataFrame) -> int:
    """Rows of a materialized table that meet the condition it was written with."""
    return df._branchloom_met


def collect_bounded(df: DataFrame, most: int, what: str) -> list:
    """All rows of a table that is small by its meaning; an error, not a part of it, where it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def release(df: DataFrame | None) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    path = getattr(df, "_branchloom_path", None)
    if path:
        _remove(df.sparkSession, path)
