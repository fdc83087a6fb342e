"""Interim tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where the setting is absent, a local session's warehouse.

    A cluster session without it is refused, for a machine's own disk would not outlive it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Paths given out and not deleted yet.
_GIVEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing has been written to."""
    path = f"{checkpoint_folder(spark)}/files/{uuid.uuid4().hex}-{name}"
    _GIVEN.append(path)
    return path


def settled(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows written there and read again, with their lineage cut, and their path."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _GIVEN:
        _GIVEN.remove(path)


def released(spark: SparkSession) -> None:
    """Delete all that was written to paths given out; call it when no result made of them is needed any more."""
    for path in list(_GIVEN):
        dropped(spark, path)
