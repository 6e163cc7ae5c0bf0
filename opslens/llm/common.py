"""What the operators of this subpackage share: scratch tables, null handling, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: space and the characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="opslens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written into the shared folder for one call of an operator.

    A written table cuts lineage and outlives executors. drop() removes tables that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/opslens/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(column: str = "text"):
    """The column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def strings(batch, name: str = "text") -> list[str]:
    """A string column of an Arrow batch, null as the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def keyed(docs: DataFrame, store: Scratch, *more) -> tuple[DataFrame, DataFrame | None]:
    """(key, text, and the columns `more`) with distinct keys in the order of doc_id, and (key, doc_id) where the key isn't the doc_id.

    The key is the doc_id, unless ids are null or repeat: then rows are numbered, null ids last."""
    rows = docs.select("doc_id", clean().alias("text"), *more)
    odd = rows.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return rows.withColumnRenamed("doc_id", "key"), None
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    saved = store.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "keyed")
    return saved.drop("doc_id"), saved.select("key", "doc_id")


def unkeyed(out: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The result by doc_id."""
    if ids is None:
        return out.withColumnRenamed("key", "doc_id")
    return ids.join(out, "key").drop("key")
