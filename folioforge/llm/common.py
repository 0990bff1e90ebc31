"""Helpers shared by the training-data operators.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; ``bytes.split()`` cuts at exactly these characters,
and ``bytes.lower()`` touches A-Z only, so word work is done on UTF-8 bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import written  # noqa: F401

#: Bytes and rows of an Arrow batch, so that a batch is small even where texts are long.
BATCH_BYTES, BATCH_ROWS = "4m", 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches that are bounded in bytes, as whole texts go through them. Plans take this from the session when they
    run, so it stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return tables.work_folder(spark, name)


def local_path(uri: str) -> str:
    """The mounted path of a folder given as a path or a file URI."""
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {uri}")
    return found.path


class Log:
    """Names of the tables that make up a store in a shared folder, by version. A commit is one appended row, so a reader
    sees all of a version or nothing, and what was written without a commit is as if it were not there."""

    SCHEMA = "version long, names array<string>, options map<string,string>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/commits"
        self.version, self.names, self.options = 0, [], {}
        try:
            last = spark.read.schema(self.SCHEMA).parquet(self.folder).orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        if last is not None:
            self.version, self.names, self.options = last.version, list(last.names), dict(last.options)

    def commit(self, names: list[str]) -> None:
        self.version, self.names = self.version + 1, list(names)
        row = self.spark.createDataFrame([(self.version, self.names, self.options)], self.SCHEMA)
        row.coalesce(1).write.mode("append").parquet(self.folder)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_rows(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list, list[bytes]]]:
    """doc_id and text of the rows of each batch; of at most so many bytes of text, or one text, where most is given."""
    for batch in batches:
        if batch.num_rows:
            ids, texts = batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))
            first, size = 0, 0
            for k, text in enumerate(texts):
                if most is not None and k > first and size + len(text) > most:
                    yield ids[first:k], texts[first:k]
                    first, size = k, 0
                size += len(text)
            yield ids[first:], texts[first:]


_SPACE = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))


def spaced_words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of texts, each with a space behind it, one after another by place in a dictionary; and where the words of
    each text end. White space beside white space gives empty words."""
    raw = b" ".join([*texts, b""]).translate(_SPACE)
    stops = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32) + 1
    wide = len(raw) >= 1 << 31
    offsets = np.concatenate([[0], stops]).astype(np.int64 if wide else np.int32)
    words = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    ends = np.searchsorted(stops, np.cumsum([len(x) + 1 for x in texts], dtype=np.int64), "right")
    return words.dictionary_encode(), ends


def word_codes(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts, the place there of each word, one text after another, and where each text's words end."""
    found, ends = spaced_words(texts)
    listed, codes = [w[:-1] for w in found.dictionary.to_pylist()], found.indices.to_numpy()
    if b"" in listed:
        solid = codes != listed.index(b"")
        codes, ends = codes[solid], np.concatenate([[0], np.cumsum(solid)])[ends]
    return listed, codes, ends


def mod_of_id(column, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


class Bloom:
    """A Bloom filter of fixed size over 64-bit hashes.

    Its size is a parameter and doesn't grow with what is put in, so it can be broadcast; a fuller filter passes more
    keys that are not in it, which costs work and never changes a result.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def slots(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64, copy=False)
        return (keys ^ (keys >> np.uint64(29))) & mask, ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for slot in self.slots(keys, self.mask):
            out &= (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return out

    @staticmethod
    def of(df: DataFrame, column: str, log2_bits: int = 25) -> Bloom:
        """Of a long column. What reaches the driver is one long for each 64 bits at most, whatever df holds."""
        n_words, mask = 1 << (log2_bits - 6), np.uint64((1 << log2_bits) - 1)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(n_words, dtype=np.uint64)
            for batch in batches:
                for slot in Bloom.slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), mask):
                    np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
            at = np.flatnonzero(words)
            for lo in range(0, len(at), 65536):
                part = at[lo : lo + 65536]
                yield pa.record_batch({"at": pa.array(part, pa.int64()), "bits": pa.array(words[part].view(np.int64))})

        found = df.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(n_words, dtype=np.uint64)
        if found.num_rows:
            words[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return Bloom(words)


def summed(df: DataFrame, at: str = "at", n: str = "n") -> DataFrame:
    """Adds up sparse counters that tasks have emitted as (at, n)."""
    return df.groupBy(at).agg(F.sum(n).alias(n))


def sparse(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells of a counter array that aren't zero, as (at, n)."""
    at = np.flatnonzero(counts)
    for lo in range(0, len(at), 65536):
        part = at[lo : lo + 65536]
        yield pa.record_batch({"at": pa.array(part, pa.int64()), "n": pa.array(counts[part])})


def dense(df: DataFrame, size: int) -> np.ndarray:
    """The sum of sparse counters over a fixed number of cells, on the driver."""
    found, out = summed(df).toArrow(), np.zeros(size, dtype=np.float64)
    if found.num_rows:
        out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out
