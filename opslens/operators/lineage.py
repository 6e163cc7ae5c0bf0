"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast; they are counted first.
MOST_BROADCAST = 100_000
#: Tasks a core that rows are dealt out to before long work.
TASKS_A_CORE = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="opslens-steps-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/opslens-steps/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written into the session's shared folder, so that later steps neither recompute nor plan what made them.

    They are computed once, outlive executors, and Spark plans with their size. sweep() removes what a session has written."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows, written, to be broadcast where there are few of them; a larger table is shuffled as usual."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """The rows in TASKS_A_CORE partitions a core at least, for steps that work long on few bytes: a file of a few MB is one task otherwise."""
    least = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def sweep(spark: SparkSession) -> None:
    """Removes all tables that cut() has written for this session. Frames that read them can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
