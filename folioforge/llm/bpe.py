"""BPE encoding and decoding by a table of distinct words.

Texts are cut into words and taken in chunks of some megabytes. A chunk is a dictionary of its distinct words and, for each
word of its texts, the place in that dictionary. Dictionaries are dealt out by hash of the word; where equal words of all
chunks meet, each distinct word is encoded once (the table is never in one place, a task holds one bucket of it). The ids go
back to the chunks, where they take the words' places: ids are joined by position. Decoding joins the ids with the table of
pieces, whose key is dense, so the join is a take.

Both reads of the texts must cut the same chunks, as reads of files do. A chunk is named by its place and by a 128-bit hash of
its dictionary, and one that does not find its words again ends the job with an error, so a source that changes between the
two reads gives no wrong ids. A lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Buckets of words to a shuffle partition; a task holds the words of one at a time.
BUCKETS = 8
#: Words that are put back at a time.
_BLOCK = 1 << 20


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte planes, compressed: high planes are nearly all alike."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(planes.tobytes())


def unpack(row: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Chunk:
    """The texts of a batch as places in a dictionary, in which the most frequent word comes first."""

    def __init__(self, texts: list[bytes], part: int, nth: int):
        found, self.ends = tokens.words_of(texts)
        at = found.indices.to_numpy()
        order = np.argsort(-np.bincount(at, minlength=len(found.dictionary)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.words = found.dictionary.take(pa.array(order)).to_pylist()  # each with a space behind it
        self.codes = rank[at]
        self.key = struct.pack(">II", part, nth) + xxhash.xxh3_128_digest(b"".join(self.words))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Chunk]]:
    """Ids and texts of each batch (doc_id, text, part)."""
    for nth, batch in enumerate(b for b in batches if b.num_rows):
        yield batch.column("doc_id").to_pylist(), Chunk(common.raw_texts(batch.column("text")), batch.column("part")[0].as_py(), nth)


ROW = "chunk binary, kind int, numbers binary, sizes binary, ids binary, docs array<long>"


def _row(key: bytes, kind: int, numbers: bytes, sizes: bytes, ids: bytes = b"", docs: list | None = None) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "chunk": pa.array([key], pa.binary()),
            "kind": pa.array([kind], pa.int32()),
            "numbers": pa.array([numbers], pa.binary()),
            "sizes": pa.array([sizes], pa.binary()),
            "ids": pa.array([ids], pa.binary()),
            "docs": pa.array([docs or []], pa.list_(pa.int64())),
        }
    )


def encoded_words(docs: DataFrame, path: str) -> DataFrame:
    """Rows of ROW, kind 0: for a chunk and a bucket, the places (numbers) of the chunk's words there, and their ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches):
            words = np.array(chunk.words, dtype=object)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in chunk.words), dtype=np.int64, count=len(words))
            order = np.argsort(bucket, kind="stable")
            press = zstandard.ZstdCompressor(level=3, write_checksum=False)
            rows = []
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                rows.append((int(bucket[at[0]]), chunk.key, press.compress(b"".join(words[at])), pack(np.diff(at, prepend=0))))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "chunk", "words", "numbers"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, unpress, now = tokens.Encoder(path), zstandard.ZstdDecompressor(), None
        for batch in batches:
            for bucket, key, words, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    encoder.forget()
                    now = bucket
                which = encoder.numbers([w + b" " for w in unpress.decompress(words).split(b" ")[:-1]])
                at, sizes = tokens.runs(encoder.stops, which)
                yield _row(key, 0, numbers, pack(sizes), pack(encoder.flat[at]))

    rows = docs.mapInArrow(deal, "bucket int, chunk binary, words binary, numbers binary")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, ROW)


def coded_texts(docs: DataFrame) -> DataFrame:
    """Rows of ROW, kind 1: for a chunk, its texts' places in its dictionary (numbers), and how many words each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks(batches):
            yield _row(chunk.key, 1, pack(chunk.codes), pack(np.diff(chunk.ends, prepend=0)), struct.pack(">I", len(chunk.words)), ids)

    return docs.mapInArrow(run, ROW)


class Pieces:
    """The piece of each id, with a space behind it; the vocabulary is of fixed size."""

    def __init__(self, tokenizer):
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            pieces[i] = piece.encode() + b" "
        self.pieces = pa.array(pieces, pa.large_binary())

    def of(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Pieces of ids as the library's decode gives them where the tokenizer names no decoder, one behind another, and
        where each begins; the last space is beyond a text."""
        out = self.pieces.take(pa.array(ids.astype(np.int64)))
        offsets = np.frombuffer(out.buffers()[1], dtype=np.int64)[: len(out) + 1]
        return memoryview(out.buffers()[2] or b""), offsets


class Dictionary:
    """A chunk's words' ids, gathered from the buckets."""

    def __init__(self):
        self.places, self.sizes, self.ids = [], [], []

    def add(self, numbers: bytes, sizes: bytes, ids: bytes) -> None:
        self.places.append(np.cumsum(unpack(numbers), dtype=np.int64))
        self.sizes.append(unpack(sizes).astype(np.int64))
        self.ids.append(unpack(ids))

    def close(self, n_words: int) -> None:
        places, sizes = np.concatenate([*self.places, np.empty(0, dtype=np.int64)]), np.concatenate([*self.sizes, np.empty(0, dtype=np.int64)])
        if len(places) != n_words:
            raise RuntimeError("the texts were not the same when they were read again: give a table of files or a checkpoint")
        self.flat = np.concatenate([*self.ids, np.empty(0, dtype="<u4")])
        self.size, self.start = np.zeros(n_words, dtype=np.int64), np.zeros(n_words, dtype=np.int64)
        self.size[places], self.start[places] = sizes, np.cumsum(sizes) - sizes

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one behind another, and where each word's end."""
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.start[codes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def _texts(chunk: Dictionary, codes: np.ndarray, ends: np.ndarray, pieces: Pieces) -> Iterator[list[tuple[np.ndarray, memoryview]]]:
    """Ids and decoded bytes of each text, in parts of at most _BLOCK words, with a space behind each piece."""
    begins, k = np.concatenate([[0], ends[:-1]]), 0
    while k < len(ends):
        last = max(int(np.searchsorted(ends, begins[k] + _BLOCK, "right")), k + 1)  # these texts together, or one long text
        parts: list[list] = [[] for _ in range(last - k)]
        for lo in range(int(begins[k]), max(int(ends[last - 1]), int(begins[k]) + 1), _BLOCK):
            hi = min(lo + _BLOCK, int(ends[last - 1]))
            ids, stops = chunk.of(codes[lo:hi])
            raw, offsets = pieces.of(ids)
            stops = np.concatenate([[0], stops])
            a, b = (stops[np.clip(x[k:last] - lo, 0, hi - lo)] for x in (begins, ends))
            for part, x, y, p, q in zip(parts, a.tolist(), b.tolist(), offsets[a].tolist(), offsets[b].tolist(), strict=True):
                part.append((ids[x:y], raw[p:q]))
        yield from parts
        k = last


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian 32-bit integers and decoded as UTF-8, both binary, of every
    row of docs; a null text is empty.

    Rows that repeat a doc_id each give a row; a null doc_id is carried along; further columns are ignored; an empty table
    gives an empty table.
    """

    def whole(parts: list) -> tuple[int, bytes, bytes]:
        return sum(len(x) for x, _ in parts), b"".join(x.tobytes() for x, _ in parts), b"".join(y for _, y in parts)[:-1]

    return _encoded(docs, path, whole, "n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, as `encode` gives them."""

    def short(parts: list) -> tuple[int, str, str]:
        n, ids, text, held = 0, hashlib.sha256(), hashlib.sha256(), b""
        for x, y in parts:
            n += len(x)
            ids.update(x.tobytes())
            if len(y):
                text.update(held)
                text.update(y[:-1])
                held = b" "
        return n, ids.hexdigest(), text.hexdigest()

    return _encoded(docs, path, short, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(docs: DataFrame, path: str | None, finish, schema: str) -> DataFrame:
    spark, path = docs.sparkSession, path or tokens.default_path()
    common.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def rows_of(ids: list, out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.record_batch([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    if not tokens.by_words(path):  # texts go to the library whole

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = tokens.Encoder.of(path)
            for ids, texts in common.text_rows(batches):
                found = [np.frombuffer(x, dtype="<u4") for x in encoder.one_by_one(texts)]
                yield rows_of(ids, [finish([(x, encoder.tokenizer.decode(x.tolist(), skip_special_tokens=False).encode() + b" ")]) for x in found])

        return docs.mapInArrow(direct, f"doc_id long, {schema}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, now, chunk, open_ = Pieces(tokens.load(path)), None, Dictionary(), False
        for batch in batches:
            for key, kind, numbers, sizes, ids, doc_ids in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "numbers", "sizes", "ids", "docs")), strict=True):
                if key != now:
                    now, chunk, open_ = key, Dictionary(), True
                if kind == 0:
                    chunk.add(numbers, sizes, ids)
                    continue
                if open_:
                    chunk.close(struct.unpack(">I", ids)[0])
                    open_ = False
                yield rows_of(doc_ids, list(map(finish, _texts(chunk, unpack(numbers).astype(np.int64), np.cumsum(unpack(sizes), dtype=np.int64), pieces))))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("part", F.spark_partition_id())
    rows = encoded_words(docs, path).union(coded_texts(docs)).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    return rows.mapInArrow(put, f"doc_id long, {schema}")
