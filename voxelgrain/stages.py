"""Written stages: frames that are read more than once, or by a loop, go to a folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The session's ``spark.checkpoint.dir``; where that is unset, a local master gets a temporary folder of its own (the only
    machine is this one) and a cluster a folder in the SQL warehouse, if that is on a file system that its machines share: a
    ``file:`` path, Spark's default, is a folder of one machine, and RuntimeError says so.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/voxelgrain/{spark.sparkContext.applicationId}"
    if spark.sparkContext.master.split("[")[0] == "local":
        path = os.path.join(tempfile.gettempdir(), f"voxelgrain-{spark.sparkContext.applicationId}")
        if not os.path.isdir(path):
            os.makedirs(path)
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        return f"file://{path}"
    return f"{_shared_warehouse(spark.conf.get('spark.sql.warehouse.dir'))}/_voxelgrain_stages/{spark.sparkContext.applicationId}"


def _shared_warehouse(path: str) -> str:
    if path.startswith(("file:", "/")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: the warehouse is a folder of one machine")
    return path.rstrip("/")


def cut(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no rework.

    ``slim`` frames hold a few numbers per row: they are written in a sixteenth of the shuffle partitions, so that loops
    don't leave swarms of tiny files.
    """
    spark = df.sparkSession
    if slim:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned and that nothing reads any more."""
    delete(df.sparkSession, df._stage_path)


def clean_stages(spark: SparkSession) -> None:
    """Delete all stages of this application; results that are still to be computed from them are lost."""
    delete(spark, shared_dir(spark))


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
