"""Token-ID files: flat unsigned integers and 64-bit document offsets, written in parallel and memory-mapped for reading.

A data set is a folder of shards in the order of doc_id. Shard k has ``shard-k.bin`` (ids of all its documents, end id
included, as little-endian unsigned integers of 16 bits, or 32 where the vocabulary needs them), ``shard-k.off``
(documents + 1 offsets in ids, as little-endian unsigned 64-bit integers) and ``shard-k.doc`` (their doc_id as signed
64-bit integers). ``manifest.json`` has the width and, for each shard, its documents, its ids and its base: the ids of
all shards before it, which is a prefix sum over shards.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

END_ID = 1
#: Documents that a shard aims at, and the least number of shards.
SHARD_DOCS, LEAST_SHARDS = 1 << 17, 96
#: Stands for a null doc_id, which comes before all others.
NULL_ID = -(1 << 63)


def _place(folder: str, name: str, data: bytes | memoryview) -> None:
    """Writes a file under another name and renames it, so a task that is run twice leaves one whole file."""
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, f"{folder}/{name}")


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> dict:
    """Encodes every row of docs into the data set at folder (a mounted path that all executors share); the manifest.

    A null text is empty and has its end id alone. Rows come by doc_id, null first; rows that repeat a doc_id come by
    text. Further columns are ignored; an empty table gives no shards.
    """
    spark, path = docs.sparkSession, path or tokens.default_path()
    common.tune(spark)
    os.makedirs(folder, exist_ok=True)
    width = 2 if tokens.load(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(LEAST_SHARDS, -(-docs.count() // SHARD_DOCS))
    cuts = docs.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 100 * shards).alias("x")).first()["x"] or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder.of(path)
        for ids, texts in common.text_rows(batches):
            flat, ends = encoder.ids(texts)
            flat, ends = np.insert(flat, ends, end_id).astype(f"<u{width}"), ends + np.arange(1, len(ends) + 1)
            rows = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.concatenate([[0], width * ends])), pa.py_buffer(flat)])
            shard = np.searchsorted(cuts, np.array(ids, dtype=np.int64), "left")
            yield pa.record_batch({"shard": pa.array(shard, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "ids": rows.cast(pa.binary())})

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, rows in _runs(batches):
            offsets = np.concatenate([[0], np.cumsum([len(x) // width for x in rows])]).astype("<u8")
            _place(folder, f"shard-{shard}.bin", b"".join(rows))
            _place(folder, f"shard-{shard}.off", offsets.tobytes())
            _place(folder, f"shard-{shard}.doc", np.array(ids, dtype="<i8").tobytes())
            yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "docs": pa.array([len(ids)], pa.int64()), "ids": pa.array([int(offsets[-1])], pa.int64())})

    rows = docs.mapInArrow(encode, "shard long, doc_id long, ids binary").repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    done = sorted(rows.mapInArrow(store, "shard long, docs long, ids long").collect())  # a row for each shard
    base, listed = 0, []
    for shard, n, ids in done:
        listed.append({"shard": shard, "docs": n, "ids": ids, "base": base})
        base += ids
    out = {"width": width, "shards": listed}
    _place(folder, "manifest.json", json.dumps(out).encode())
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """The documents of each shard, whose rows come one after another."""
    now, ids, rows = None, [], []
    for batch in batches:
        for shard, doc_id, row in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if shard != now:
                if ids:
                    yield now, ids, rows
                now, ids, rows = shard, [], []
            ids.append(doc_id)
            rows.append(row)
    if ids:
        yield now, ids, rows


def shard_documents(folder: str, width: int, shard: int, base: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start in the whole data set, ids) of each document of a shard, from its mapped files."""
    offsets = np.memmap(f"{folder}/shard-{shard}.off", dtype="<u8", mode="r")
    ids = np.memmap(f"{folder}/shard-{shard}.doc", dtype="<i8", mode="r")
    flat = np.memmap(f"{folder}/shard-{shard}.bin", dtype=f"<u{width}", mode="r")
    for i in range(len(ids)):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        yield int(ids[i]), base + lo, flat[lo:hi]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the data set at folder, a shard to a task."""
    with open(f"{folder}/manifest.json") as f:
        manifest = json.load(f)
    width = manifest["width"]
    rows = spark.createDataFrame([(x["shard"], x["base"]) for x in manifest["shards"]], "shard long, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                found = [(None if d == NULL_ID else d, start, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, start, x in shard_documents(folder, width, shard, base)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.repartition(max(1, len(manifest["shards"])), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs to a new data set in the shared folder and reads it back."""
    spark = docs.sparkSession
    folder = common.local_path(common.work_dir(spark, "token-ids"))
    write(docs, folder)
    return read(spark, folder)
