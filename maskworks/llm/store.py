"""Shared working storage: where intermediate tables go so that lost executors can be survived."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only when the session has none (tests on one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared storage."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it cuts lineage and outlives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, deal: bool = True) -> DataFrame:
    """As :func:`written`, in buckets by ``key``: later joins on it move the other side alone.

    With ``deal`` rows are shuffled by the key first; without, each task writes to the buckets of its own
    rows, which suits keys whose rows are together already. The catalogue forgets the table at once.
    """
    spark = df.sparkSession
    path, buckets = fresh_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key) if deal else df
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(made)
    out = spark.table(made)
    spark.sql(f"drop table {made}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
