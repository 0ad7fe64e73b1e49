"""Intermediate tables in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of this machine's own, which only a local master allows."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str = "job") -> str:
    """A folder there that nothing else uses."""
    return f"{shared_dir(spark)}/molmill-{name}-{uuid.uuid4().hex}"


def plain_unions(spark: SparkSession) -> None:
    """From now on the session's unions do not count as dealt by their tables' keys.

    Spark 4.1 takes a union of tables dealt alike for dealt itself, and leaves out exchanges. In
    plans that have it twice that does not hold when they run: a join stops over unequal numbers of
    partitions, and a group could be split.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and read it back: later steps start from files that outlive executors."""
    at = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
