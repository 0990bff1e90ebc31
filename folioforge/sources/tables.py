"""Tables in the session's shared folder: what several operators read is written once and read by columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a session on one machine gets a temporary one; a cluster has none
    that all machines share, so there it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    found = tempfile.mkdtemp(prefix="folioforge-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table: cuts the lineage, survives lost executors, and is read column-wise."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a folder of its own, for what a single operator reads several times."""
    return written(df, work_folder(df.sparkSession, name), "rows")
