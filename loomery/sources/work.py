"""Intermediate tables in the folder that driver and executors share.

They are plain Parquet below the folder named by ``spark.checkpoint.dir``, in one folder per application. They cut lineage, so a
lost executor costs at most the stage that was running, and what is read back twice is the same both times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session in local mode that names no shared folder, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints/loomery"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster's session that names none is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or LOCAL_SHARED).rstrip("/")


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomery-{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder; :func:`drop_work` deletes them all."""
    return f"{work_dir(spark)}/{uuid.uuid4().hex}-{name}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomery_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_loomery_path", None)
        if path:
            _delete(table.sparkSession, path)


def drop_work(spark: SparkSession) -> None:
    """Delete every intermediate table of this application: results are lazy, so call it when they are written."""
    _delete(spark, work_dir(spark))
