"""Session helpers: table access and shared-storage staging.

Long lineages are cut by writing a Parquet table into the folder that the
cluster names in ``spark.checkpoint.dir``; executors can then be lost without
recomputing what came before.  Nothing here uses executor-local checkpoints.
"""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame (column pruning and pushdown are Catalyst's)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, from ``spark.checkpoint.dir``.

    Only a local master without that setting falls back to a temporary folder,
    because driver and executors are then one process on one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_dir, "_made", None)
    if made is None:
        made = shared_dir._made = tempfile.mkdtemp(prefix="corposcope-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage is cut, values are fixed."""
    spark = df.sparkSession
    path = f"{_stage_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete the staged tables of this application; results that are still lazy must have been written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _kept.clear()


def _stage_dir(spark: SparkSession) -> str:
    """Folder of the application's staged tables; the file system client deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}"
    if path not in _kept:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _kept.add(path)
    return path


_kept: set[str] = set()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an input of fewer scan tasks than cores, for work that costs more than moving the rows.

    Only inputs of a few blocks have so few tasks; a large input is left where it is, and
    so is one that comes from an exchange, whose tasks are Spark's to choose.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:  # counting its tasks could run its stages
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
