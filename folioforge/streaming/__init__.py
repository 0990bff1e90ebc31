"""Continuous compilation: each micro-batch of changed documents becomes a table diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental
from ..sources import tables


def diffs(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str) -> StreamingQuery:
    """Reads (path, body) files of a Parquet folder as a stream; after each batch `state`/actions-N holds what the batch changed,
    and `state`/hashes one more part: the hashes that are new. The latest hash of a path is that of its last part, so a batch
    writes no more than itself, and one that is run again writes the same. Runs through what there is and stops."""

    def step(batch: DataFrame, n: int) -> None:
        new = tables.kept(incremental.hashes(batch.groupBy("path").agg(F.max("body").alias("body"))), "batch")
        if n:
            had = batch.sparkSession.read.schema("path string, hash string, n int").parquet(f"{state}/hashes").where(F.col("n") < n)
            old = had.join(new.select("path"), "path", "left_semi").groupBy("path").agg(F.max_by("hash", "n").alias("hash"))
        else:
            old = new.where("false")
        met = incremental.diff(new, old)
        met.write.mode("overwrite").parquet(f"{state}/actions-{n}")
        new.join(met.where("action != 'noop'"), "path", "left_semi").write.mode("overwrite").parquet(f"{state}/hashes/n={n}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
