"""Substring deduplication over a log-structured fingerprint index.

A window is `width` consecutive words of a document. Its fingerprint is the least hash among its `gram`-word runs, so
neighbouring windows share fingerprints and about one word in twenty starts a new one. The index is a log of immutable
runs in a folder, each a table of distinct fingerprints, dealt to buckets and sorted in each, with the least doc_id that has
them. A batch of documents is fingerprinted, becomes a run, and is merge-joined with every other run, bucket by bucket; runs
are compacted once there are too many. What runs there are is committed to the folder, so an index that is opened again goes
on where it was. Fingerprints that more than one document has are put in a Bloom filter of fixed size; windows that pass it
are verified by hashes of all their words:

1. A stretch is a row of neighbouring windows of one document with one fingerprint. Equal stretches hold equal windows,
   so of these all but the one in the least document go, unless a fingerprint has a single stretch anyway.
2. The stretches that stay as the first of their kind are taken apart, and windows are compared one by one.

Both comparisons are on 128 bits: 64 of the fingerprint, 64 of a polynomial over the hashes of all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

WIDTH, GRAM = 50, 10
#: Documents are taken in so many batches, by ranges of doc_id; runs are compacted when there are more than MAX_RUNS.
BATCHES, MAX_RUNS = 3, 1
#: Bytes of text whose windows a task holds at a time (or one text): about 60 times as many bytes of arrays.
HELD_BYTES = 1 << 20
_STEP, _STEP_GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers
_MASK = (1 << 64) - 1


_POWERS: dict[int, np.ndarray] = {}


def _powers(step: np.uint64, n: int) -> np.ndarray:
    """step**0 to step**(n - 1), modulo 2**64; the longest so far is kept."""
    held = _POWERS.get(int(step))
    if held is None or len(held) < n:
        held = np.full(max(2 * n, 4096), step, dtype=np.uint64)
        held[0] = 1
        held = _POWERS[int(step)] = np.cumprod(held)
    return held[:n]


def _rolling(words: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """Hash of each run of `width` words: a polynomial in step, modulo 2**64."""
    n = len(words)
    inverse = np.uint64(pow(int(step), -1, 1 << 64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(step, n))])
    return (sums[width:] - sums[: n - width + 1]) * _powers(inverse, n - width + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, by doubling."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


class Windows:
    """The windows of all texts of a batch, and their stretches: texts that hold them, fingerprints, first windows."""

    def __init__(self, texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
        words, codes, ends = common.word_codes(texts)
        self.n_words = np.diff(ends, prepend=0)
        self.hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)[codes]
        owner = np.repeat(np.arange(len(texts)), self.n_words)
        n = max(len(codes) - width + 1, 0)
        self.at = np.flatnonzero(owner[:n] == owner[len(owner) - n :])  # windows within one text
        prints = _least(_mixed(_rolling(self.hashes, gram, _STEP_GRAM)), width - gram + 1)[self.at] if n else np.empty(0, dtype=np.uint64)
        owner, self.width = owner[self.at], width
        new = np.ones(len(prints), dtype=bool)
        new[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
        self.lo = np.flatnonzero(new)
        self.hi = np.append(self.lo[1:], len(prints)).astype(np.int64)
        self.print, self.owner = prints[self.lo], owner[self.lo]
        self.start = self.at[self.lo] - (ends - self.n_words)[self.owner]

    def whole(self) -> np.ndarray:
        """The full hash of each window."""
        return _mixed(_rolling(_mixed(self.hashes), self.width, _STEP))[self.at]

    def stretches(self, whole: np.ndarray) -> np.ndarray:
        """A hash of all windows of each stretch."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(whole * _powers(_STEP_GRAM, len(whole)))])
        inverse = _powers(np.uint64(pow(int(_STEP_GRAM), -1, 1 << 64)), len(whole))
        return _mixed((sums[self.hi] - sums[self.lo]) * inverse[self.lo] + (self.hi - self.lo).astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _normal(text: bytes) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(text.split())


def _sig(text: bytes) -> int:
    """Tells rows of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(_normal(text)) - (1 << 63)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, sha, n_words, prints): the digests of all words, and the fingerprints of each row's stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_rows(batches, HELD_BYTES):
            found, solid = Windows(texts), list(map(_normal, texts))
            stops = np.searchsorted(found.owner, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "sig": pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in solid], pa.int64()),
                    "sha": pa.array([hashlib.sha256(x).hexdigest() for x in solid]),
                    "n_words": pa.array(found.n_words, pa.int64()),
                    "prints": pa.ListArray.from_arrays(pa.array(stops), _signed(found.print)),
                }
            )

    return docs.mapInArrow(run, "doc_id long, sig long, sha string, n_words long, prints array<long>")


class FingerprintIndex:
    """Sorted immutable runs (print, first_doc, last_doc) in one shared folder; the committed list of runs is all that
    changes. The first batch decides the number of buckets, so joins of runs move nothing."""

    SCHEMA = "print long, first_doc long, last_doc long"

    def __init__(self, spark: SparkSession, folder: str, max_runs: int = MAX_RUNS):
        self.spark, self.folder, self.max_runs = spark, folder, max_runs
        self.log = common.Log(spark, folder)
        self.buckets = int(self.log.options.setdefault("buckets", spark.conf.get("spark.sql.shuffle.partitions")))
        self.made = self.log.version

    @property
    def runs(self) -> list[str]:
        return self.log.names

    def _table(self, name: str) -> str:
        return f"runs_{xxhash.xxh3_64_hexdigest(self.folder)}_{name}"

    def run(self, name: str) -> DataFrame:
        table = self._table(name)
        if not self.spark.catalog.tableExists(table):  # the folder has been opened again
            where = f"{self.folder}/{name}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} ({self.SCHEMA}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"run_{self.made}"
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:  # else rows are dealt by bucket already
            rows = rows.repartition(self.buckets, "print")
        rows.write.mode("overwrite").bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(self._table(name))
        return name

    def ingest(self, printed: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, prints) and returns its fingerprints (print) that another document has, too."""
        if len(self.runs) > self.max_runs:
            self.compact()
        rows = printed.select("doc_id", F.explode("prints").alias("print")).groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        name = self._write(rows)
        batch = self.run(name)
        shared = batch.where("first_doc != last_doc").select("print")
        for other in self.runs:  # merge joins: a fingerprint stands once in a run
            old = self.run(other).select("print", F.col("first_doc").alias("a"), F.col("last_doc").alias("b"))
            shared = shared.union(batch.hint("merge").join(old, "print").where("first_doc != a or last_doc != b").select("print"))
        shared = common.written(shared.distinct(), self.folder, f"shared-{self.made}")
        self.log.commit([*self.runs, name])
        return shared

    def compact(self) -> None:
        """Merges all runs into one; the old ones stay as they are until the folder goes."""
        rows = self.run(self.runs[0])
        for name in self.runs[1:]:
            more = self.run(name).select("print", F.col("first_doc").alias("a"), F.col("last_doc").alias("b"))
            rows = rows.hint("merge").join(more, "print", "full").select("print", F.least("first_doc", "a").alias("first_doc"), F.greatest("last_doc", "b").alias("last_doc"))
        self.log.commit([self._write(rows)])

    def close(self) -> None:
        """Takes the runs out of the session's catalog; their files stay."""
        for k in range(1, self.made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(f'run_{k}')}")


def _stretches(docs: DataFrame, shared: common.Bloom) -> DataFrame:
    """Stretches whose fingerprint passes the filter: (print, stretch, doc_id, sig, start, n)."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_rows(batches, HELD_BYTES):
            found = Windows(texts)
            at = np.flatnonzero(sent.value.has(found.print))
            if len(at):
                sigs = np.array(list(map(_sig, texts)), dtype=np.int64)
                yield pa.record_batch(
                    {
                        "print": _signed(found.print[at]),
                        "stretch": _signed(found.stretches(found.whole())[at]),
                        "doc_id": pa.array(ids, pa.int64()).take(pa.array(found.owner[at])),
                        "sig": pa.array(sigs[found.owner[at]]),
                        "start": pa.array(found.start[at], pa.int32()),
                        "n": pa.array((found.hi - found.lo)[at], pa.int32()),
                    }
                )

    return docs.mapInArrow(run, "print long, stretch long, doc_id long, sig long, start int, n int")


def _kind_key(prints: np.ndarray, stretches: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(prints.view(np.uint64) + stretches.view(np.uint64) * _STEP) + ids.astype(np.int64).view(np.uint64) * _STEP_GRAM)


def _taken_apart(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(print, hash, doc_id, sig, start) of each window of the stretches kinds (print, stretch, first_doc), and of some others
    that pass a filter of them."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": _signed(_kind_key(*(batch.column(c).to_numpy() for c in ("print", "stretch", "first_doc"))))})

    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(common.Bloom.of(kinds.select("print", "stretch", "first_doc").mapInArrow(keys, "key long"), "key", 26))
    holders = spark.sparkContext.broadcast(common.Bloom.of(kinds, "first_doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (b.filter(pa.array(holders.value.has(b.column("doc_id").to_numpy().view(np.uint64)))) for b in batches if b.num_rows)
        for ids, texts in common.text_rows(held, HELD_BYTES):
            ids, found = np.array(ids, dtype=np.int64), Windows(texts)
            whole = found.whole()
            at = np.flatnonzero(wanted.value.has(_kind_key(found.print, found.stretches(whole), ids[found.owner])))
            if len(at):
                sigs = np.array(list(map(_sig, texts)), dtype=np.int64)
                window, sizes = tokens.spans(found.lo[at], found.hi[at])
                owner = np.repeat(found.owner[at], sizes)
                columns = {"print": _signed(np.repeat(found.print[at], sizes)), "hash": _signed(whole[window]), "doc_id": pa.array(ids[owner]), "sig": pa.array(sigs[owner])}
                start = np.repeat(found.start[at] - found.lo[at], sizes) + window
                yield pa.record_batch(columns | {"start": pa.array(start, pa.int32())})

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "print long, hash long, doc_id long, sig long, start int")


def _passing(kinds: DataFrame, prints: common.Bloom) -> DataFrame:
    """Kinds whose fingerprint passes the filter; a fingerprint can have any number of kinds, so they are not joined."""
    sent = kinds.sparkSession.sparkContext.broadcast(prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.has(batch.column("print").to_numpy().view(np.uint64))))

    return kinds.mapInArrow(run, kinds.schema)


def covered(docs: DataFrame, shared: DataFrame, folder: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, sig, ranges): word ranges (start, end) of each document that an earlier document's windows cover."""
    rows = common.written(_stretches(docs.where(F.col("doc_id").isNotNull()), common.Bloom.of(shared, "print", 26)), folder, "stretches")
    kinds = rows.groupBy("print", "stretch").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    kinds = common.written(kinds, folder, "kinds")
    again = kinds.where("first_doc != last_doc").drop("last_doc")
    later = rows.join(again, ["print", "stretch"]).where("doc_id > first_doc").select("doc_id", "sig", "start", (F.col("start") + F.col("n") + width - 1).alias("end"))
    # a fingerprint with one kind of stretch, or in one document, needs no second look
    many = kinds.groupBy("print").agg((F.min("stretch") != F.max("stretch")).alias("many"), (F.min("first_doc") != F.max("first_doc")).alias("several")).where("many and several").select("print")
    first = common.written(_passing(kinds.drop("last_doc"), common.Bloom.of(many, "print", 26)), folder, "first")
    windows = common.written(_taken_apart(docs, first), folder, "windows")
    least = windows.groupBy("print", "hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc != last_doc").drop("last_doc")
    least = common.written(least, folder, "least")
    also = windows.join(least, ["print", "hash"]).where("doc_id > first_doc").select("doc_id", "sig", "start", (F.col("start") + width).alias("end"))
    # neighbouring ranges are joined before they are gathered
    by_row = Window.partitionBy("doc_id", "sig").orderBy("start", "end")
    ranges = later.union(also).distinct()
    ranges = ranges.withColumn("reach", F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by_row))
    ranges = ranges.groupBy("doc_id", "sig", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return common.written(ranges.groupBy("doc_id", "sig").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges")), folder, "ranges")


def _cut(docs: DataFrame, ranges: DataFrame, folder: str) -> DataFrame:
    """(doc_id, sig, n_removed, kept_sha256) of the rows that have ranges; only their texts are moved, thanks to a filter."""
    spark = docs.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": _signed(_row_key(batch.column("doc_id").to_numpy(), batch.column("sig").to_numpy()))})

    sent = spark.sparkContext.broadcast(common.Bloom.of(ranges.select("doc_id", "sig").mapInArrow(keys, "key long"), "key"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_rows(batches):
            sigs = np.array(list(map(_sig, texts)), dtype=np.int64)
            at = np.flatnonzero(sent.value.has(_row_key(np.array(ids, dtype=np.int64), sigs)))
            if len(at):
                yield pa.record_batch({"doc_id": pa.array([ids[i] for i in at], pa.int64()), "sig": pa.array(sigs[at]), "text": pa.array([texts[i] for i in at], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, gone = [], []
            for text, ranges_ in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words, kept, at = text.split(), [], 0
                for r in ranges_:
                    kept += words[at : r["start"]]
                    at = r["end"]
                kept += words[at:]
                gone.append(len(words) - len(kept))
                out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "sig": batch.column("sig"), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(out, pa.string())})

    texts = docs.where(F.col("doc_id").isNotNull()).mapInArrow(pick, "doc_id long, sig long, text binary")
    return texts.join(ranges, ["doc_id", "sig"]).select("doc_id", "sig", "text", "ranges").mapInArrow(cut, "doc_id long, sig long, n_removed long, kept_sha256 string")


def _row_key(ids: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    return _mixed(ids.view(np.uint64) * _STEP + sigs.view(np.uint64))


def deduplicate(docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame, str]:
    """Prints of all rows of docs (doc_id, sig, sha, n_words, prints) and their covered ranges, by way of the index."""
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = common.work_dir(spark, "substrings")
    printed = common.written(fingerprint_documents(docs), folder, "printed")
    cuts = printed.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("x")).first()["x"] if batches > 1 else []
    index, shared, low = FingerprintIndex(spark, f"{folder}/index"), None, None
    for high in [*(cuts or []), None]:
        batch = printed
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        found = index.ingest(batch.where(F.col("doc_id").isNotNull()).select("doc_id", "prints"))
        shared, low = found if shared is None else shared.union(found), high
    index.close()
    return printed, covered(docs, shared.distinct(), folder), folder


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs: words covered by a window that starts in a document
    with a smaller doc_id are removed.

    Null and empty texts have no words. Rows with a null doc_id come neither before nor after any other: they are left
    whole and cover nothing. Rows that repeat a doc_id each give a row and don't cover each other. Further columns are
    ignored; an empty table gives an empty table.
    """
    printed, ranges, folder = deduplicate(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    changed = common.written(_cut(docs, ranges, folder).distinct(), folder, "changed")
    out = printed.select("doc_id", "sig", "sha", "n_words").join(changed, ["doc_id", "sig"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
