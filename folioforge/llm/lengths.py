"""Token counts by an exact histogram of lengths.

Documents are aggregated by encoded length. Every question about a context limit is answered by suffix sums over the
histogram: documents beyond it, tokens kept when each document is cut at it, and tokens lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Lengths are summed within blocks of so many, and blocks among themselves, so no task gets all lengths.
BLOCK = 64
QUANTILES = (0.5, 0.9, 0.99)


def document_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row; a null text is empty."""
    common.tune(docs.sparkSession)
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder.of(path)
        for ids, texts in common.text_rows(batches):
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(np.diff(encoder.ids(texts)[1], prepend=0), pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs)."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(hist: DataFrame, folder: str) -> DataFrame:
    """A row for each length that occurs, taken as a context limit:

    (context_limit, n_docs, n_longer, n_total, tokens_total, tokens_kept, tokens_lost, share_at_most, quantiles). n_docs
    have that length, n_longer a greater one; tokens_kept is the total if every document is cut at the limit; quantiles
    lists those of QUANTILES whose (lower) quantile this length is. Limits between two lengths follow from the lower
    one: n_longer stays, tokens_kept grows by n_longer with each token.
    """
    rows = common.written(hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), folder, "histogram")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 64 lengths
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(above), none).alias("over_docs"),
        F.coalesce(F.sum("b_tokens").over(above), none).alias("over_tokens"),
        F.sum("b_docs").over(total).alias("n_total"),
        F.sum("b_tokens").over(total).alias("tokens_total"),
    )
    blocks = common.written(blocks, folder, "blocks")
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(blocks, "block")
    longer = F.coalesce(F.sum("n_docs").over(inside), none) + F.col("over_docs")
    longer_tokens = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), none) + F.col("over_tokens")
    out = joined.select("n_tokens", "n_docs", "n_total", "tokens_total", longer.alias("n_longer"), longer_tokens.alias("longer_tokens"))
    lost = F.col("longer_tokens") - F.col("n_longer") * F.col("n_tokens")
    at_most = F.col("n_total") - F.col("n_longer")
    marks = [F.when((at_most >= F.ceil(F.lit(q) * F.col("n_total"))) & (at_most - F.col("n_docs") < F.ceil(F.lit(q) * F.col("n_total"))), F.lit(f"p{round(100 * q)}")) for q in QUANTILES]
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "n_longer",
        "n_total",
        "tokens_total",
        (F.col("tokens_total") - lost).alias("tokens_kept"),
        lost.alias("tokens_lost"),
        (at_most / F.col("n_total")).alias("share_at_most"),
        F.array_join(F.array_compact(F.array(*marks)), ",").alias("quantiles"),
    )


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`context_limits` of all rows of docs. Null and empty texts have length 0; ids don't matter, so null and repeated ones
    count like any other; further columns are ignored; an empty table gives an empty table."""
    return context_limits(histogram(document_lengths(docs, path)), common.work_dir(docs.sparkSession, "lengths"))
