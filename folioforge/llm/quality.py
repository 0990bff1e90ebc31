"""Quality rules and an isolation forest on their statistics.

Each text gives a row of rule statistics. Two base rules fail a text outright: too few words, or too many words in
repeated three-word windows. The rest is judged by an isolation forest: random splits isolate rows that are unlike good ones
in few steps, so a short mean path marks an anomaly. The splits of a tree are drawn from the range that all rows of the table
take, labelled or not, and its paths end where good rows no longer need telling apart: a path into a part of the range that
no good row takes is short. The good rows are a bounded sample of half of the labelled rows, and the path length below which
a text is rejected is calibrated on all rows of the other half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Bounds of the fit: good rows from which trees draw, trees, rows that a tree draws, and steps of a path.
MAX_FIT_ROWS, TREES, DRAWN, MOST_STEPS = 8192, 128, 256, 40
#: At most this share of labelled good rows may be rejected by the forest.
MOST_GOOD_LOST = 0.01
#: Cells of the calibration histogram.
CELLS = 2000
_SEED = 61
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "longest")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _code_points(raw: bytes) -> int:
    return int((np.frombuffer(raw, dtype=np.int8) >= -64).sum())  # all but continuation bytes


_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_MARK = bytes(b for b in range(256) if b not in b".,;:!?")


def statistics(raw: bytes) -> tuple[int, ...]:
    """The COUNTS of a text."""
    words = raw.split()
    n = len(words)
    solid = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()] if n else []  # strip() and split() know the same white space
    repeated = 0
    numbers: dict[bytes, int] = {}
    row = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if n >= 3:
        _, pair = np.unique(row[:-1] * len(numbers) + row[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(numbers) + row[2:], return_inverse=True, return_counts=True)
        again = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(times[window] > 1)
        np.add.at(again, at, 1)
        np.add.at(again, np.minimum(at + 3, n), -1)
        repeated = int((np.cumsum(again[:n]) > 0).sum())
    return (
        n,
        _code_points(solid),
        len(raw.translate(None, _NOT_SYMBOL)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(numbers),
        len(raw.translate(None, _NOT_UPPER)),
        len(raw.translate(None, _NOT_DIGIT)),
        len(raw.translate(None, _NOT_MARK)),
        max(map(len, words), default=0),
    )


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS) of every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_rows(batches):
            columns = list(zip(*map(statistics, texts), strict=True))
            yield pa.record_batch([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *COUNTS])

    common.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates of the rules, a row for each row of COUNTS; none of them grows with length by itself."""
    c = {name: counts[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            np.log1p(c["word_chars"] / words),
            c["n_symbols"] / chars,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            c["n_upper"] / chars,
            c["n_digits"] / chars,
            np.log1p(c["n_marks"] / words),
            np.log1p(c["longest"]),
            np.log1p(words / np.maximum(c["n_distinct"], 1)),
        ],
        axis=1,
    )


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split, left child, and path length of a leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    norm: float

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / that of an unsuccessful search): towards 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, depth in zip(self.feature, self.split, self.left, self.depth, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(feature[at], 0)] >= split[at]
                at = np.where(inner, left[at] + right, at)
            total += depth[at]
        return 2 ** (-total / len(self.feature) / self.norm)


def _search_path(n: float) -> float:
    """Mean path of an unsuccessful search in a binary tree of n."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Forest:
    """A forest over rows x, whose splits are uniform over what is left of the range from low to high."""
    rng = np.random.default_rng(_SEED)
    drawn, nodes = min(DRAWN, len(x)), []
    for _ in range(TREES):
        feature, split, left, depth = [], [], [], []

        def add() -> int:
            feature.append(-1)
            split.append(0.0)
            left.append(0)
            depth.append(0.0)
            return len(feature) - 1

        queue = [(add(), x[rng.choice(len(x), drawn, replace=False)], low, high, 0)]
        while queue:
            node, rows, lo, hi, level = queue.pop(0)
            open_ = np.flatnonzero(hi > lo)
            if level >= MOST_STEPS or len(rows) <= 1 or not len(open_):
                depth[node] = level + _search_path(len(rows))
                continue
            f = int(rng.choice(open_))
            at = float(rng.uniform(lo[f], hi[f]))
            side = rows[:, f] >= at
            feature[node], split[node] = f, at
            a, b = add(), add()
            left[node] = a
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = at
            queue += [(a, rows[~side], lo, below, level + 1), (b, rows[side], above, hi, level + 1)]
        nodes.append((feature, split, left, depth))
    size = max(len(t[0]) for t in nodes)

    def table(i: int, fill: float, kind) -> np.ndarray:
        return np.array([t[i] + [fill] * (size - len(t[i])) for t in nodes], dtype=kind)

    return Forest(table(0, -1, np.int64), table(1, 0, np.float64), table(2, 0, np.int64), table(3, 0, np.float64), max(_search_path(drawn), 1e-9))


@dataclass
class Model:
    forest: Forest | None
    threshold: float

    def anomaly(self, counts: np.ndarray) -> np.ndarray:
        return self.forest.anomaly(features(counts)) if self.forest is not None else np.zeros(len(counts))


def ranges(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of each feature over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features(_matrix(batch))
                yield pa.record_batch({"at": pa.array(range(x.shape[1]), pa.int32()), "low": pa.array(x.min(0)), "high": pa.array(x.max(0))})

    found = measured.mapInArrow(run, "at int, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").toArrow()
    return found["low"].to_numpy(), found["high"].to_numpy()


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """From measured rows and labels (doc_id, quality). A doc_id with labels of both kinds counts as bad. The halves of the
    labelled rows go by a hash of doc_id. Without a good row in the first and a bad row in the second, nothing is rejected."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    judged = measured.where(~base_failed())
    joined = judged.join(known, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    good = joined.where("quality > 0 and half = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT_ROWS).select(*COUNTS).toArrow()
    if not good.num_rows:
        return Model(None, math.inf)
    model = Model(grow(features(np.stack([good[c].to_numpy() for c in COUNTS], axis=1)), *ranges(judged)), math.inf)
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * CELLS)
        for batch in batches:
            if batch.num_rows:
                cell = np.minimum((shared.value.anomaly(_matrix(batch)) * CELLS).astype(np.int64), CELLS - 1)
                out += np.bincount(2 * cell + (batch.column("quality").to_numpy() > 0), minlength=2 * CELLS)
        yield from common.sparse(out)

    cells = common.dense(joined.where("half = 1").mapInArrow(count, "at long, n double"), 2 * CELLS).reshape(-1, 2)
    bad, kept = (np.cumsum(cells[::-1, i])[::-1] for i in (0, 1))  # rows of a cell or above
    if not cells[:, 0].sum():
        return model
    loss = kept / max(cells[:, 1].sum(), 1)
    gain = np.where(loss <= MOST_GOOD_LOST, bad / cells[:, 0].sum() - loss, -1)
    # of the best cells the highest: between the classes, good rows get the room
    model.threshold = float(np.flatnonzero(gain >= gain.max() - 1e-12).max()) / CELLS if gain.max() > 0 else math.inf
    return model


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS], axis=1)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly) of every row of docs.

    A null text is empty and fails the base rules. Rows that repeat a doc_id each give a row; a null doc_id has no label
    and is judged like any other. Further columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = common.work_dir(spark, "quality")
    measured = common.written(measure(docs), folder, "measured")
    shared = spark.sparkContext.broadcast(fit(measured, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.anomaly(_matrix(batch)) if batch.num_rows else np.zeros(0)
            fine = pa.array(score < shared.value.threshold)
            yield pa.record_batch([batch.column("doc_id"), *[batch.column(c) for c in names], fine, pa.array(score)], names=["doc_id", *names, "fine", "anomaly"])

    out = measured.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", fine boolean, anomaly double")
    return out.select("doc_id", *names, base_failed().alias("base_failed"), (~base_failed() & F.col("fine")).alias("kept"), "anomaly")


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
