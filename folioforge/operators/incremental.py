"""Incremental output as a table diff, and its preflight checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def hashes(rows: DataFrame) -> DataFrame:
    """(path, hash) from (path, body)."""
    return rows.select("path", F.sha2(F.col("body").cast("binary"), 256).alias("hash"))


def diff(desired: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, action): insert, update, noop or delete, from two (path, hash) tables."""
    rows = desired.select("path", F.col("hash").alias("new")).join(previous.select("path", F.col("hash").alias("old")), "path", "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "noop").otherwise("update")
    return rows.select("path", action.alias("action"))


def stale(desired: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.select("path").join(desired.select("path"), "path", "left_anti")


def last_writer(layers: list[DataFrame]) -> DataFrame:
    """Union of (path, body) tables; of equal paths the later table's body stays."""
    rows = None
    for i, x in enumerate(layers):
        x = x.select("path", "body", F.lit(i).alias("layer"))
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy("path").agg(F.max_by("body", "layer").alias("body"))


def invalid_paths(rows: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return rows.where((F.col("path") == "") | F.exists(parts, lambda c: c.isin("", ".", ".."))).select("path")


def collisions(desired: DataFrame, existing: DataFrame, managed: DataFrame) -> DataFrame:
    """(path, reason): existing files that the output would overwrite or that stand where it needs a directory, and that it
    doesn't manage itself."""
    foreign = existing.select("path").join(managed.select("path"), "path", "left_anti")
    same = desired.select("path").join(foreign, "path", "left_semi").select("path", F.lit("unmanaged file").alias("reason"))
    above = desired.select(F.explode(F.array_except(T.ancestors(F.col("path")), F.array(F.lit("")))).alias("path")).distinct()
    return same.union(above.join(foreign, "path", "left_semi").select("path", F.lit("file in place of a directory").alias("reason")))


def identical(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows the same number of times."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
