"""Benchmark decontamination by CGK embedding and bit sampling.

Documents and benchmark items are sequences of words (lower case, cut to letters and digits at both ends). The CGK walk
copies the word it stands on and, by a random bit of word and time, steps on or stays; sequences at a small edit distance
walk mostly in step, so edit distance becomes Hamming distance between walks. Bit sampling hashes a few places of a walk,
repeatedly; a window that falls into a bucket of an item is a candidate for it, and every candidate is verified by the exact
edit distance of the item to the nearest run of words around the window.

All samples of a walk fail together where the walk goes astray, so items of a length get several walks: as many as it takes
until copies of the items, edited as much as is allowed, are found with the recall that is asked for. Where that takes more
than MAX_WALKS, every window that is walked is a candidate, which finds all.

Not all windows are walked. Edits cut an item into one run of words more than there are edits, so a near copy has one of
the item's short runs unchanged, and at about the item's place in it; windows without one are passed over, which loses none.
The benchmark is taken in blocks of bounded size, each of which goes to all documents as a broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: An item is found where the edit distance in words is at most this share of its length.
SHARE = 0.2
#: Places of a walk in a sample, samples of a walk, walks at most, the recall to reach, and the edited copies it is tried on.
PLACES, SAMPLES, MAX_WALKS, RECALL, TRIED = 2, 16, 32, 0.995, 400
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 2 << 20
_SEED = 20_11
_CACHE = 400_000
_EDGES = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def normal(word: bytes) -> bytes:
    return word.lower().strip(_EDGES)


def allowed(n: int) -> int:
    """Edits of an item of n words."""
    return int(SHARE * n)


def gram(n: int) -> int:
    """Words of the run that a near copy of an item of n words has unchanged: some part of an item cut by edits has so many."""
    return min(4, -(-(n - allowed(n)) // (allowed(n) + 1)))


def walks(ids: np.ndarray, starts: np.ndarray, n: int, length: int, coins: np.ndarray) -> np.ndarray:
    """CGK walks over the n words from each start; past its end a window reads 0. The coin of a word at a time is the top bit
    of a linear hash with that time's factor and offset (coins: [time, 2]); a word of no item steps on."""
    at, out = np.zeros(len(starts), dtype=np.int64), np.zeros((len(starts), length), dtype=np.int32)
    for j in range(length):
        here = np.where(at < n, ids[np.minimum(starts + at, len(ids) - 1)], 0)
        out[:, j] = here
        at += (((here.astype(np.uint64) * coins[j, 0] + coins[j, 1]) >> np.uint64(63)).astype(np.int64)) | (here == 0)
    return out


def edit_ends(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to any run of text, and that run's start and end (the first of the best)."""
    rows = np.zeros(len(text) + 1, dtype=np.int64)
    begin = np.arange(len(text) + 1)
    at = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        differ = (text != w).astype(np.int64)
        swap, drop = rows[:-1] + differ, rows[1:] + 1
        best = np.minimum(swap, drop)
        new = np.concatenate([[i], best])
        came = np.concatenate([[begin[0]], np.where(swap <= drop, begin[:-1], begin[1:])])
        # insertions run along the row: the least of new[k] - k up to here, plus k
        shifted = new - at
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, at, 0))
        rows, begin = low + at, came[source]
    end = int(rows.argmin())
    return int(rows[end]), int(begin[end]), end


class Plan:
    """The walks and samples for items of one length, and the items' buckets."""

    def __init__(self, n: int, items: list[int], words: list[np.ndarray]):
        self.n, self.edits, self.length = n, allowed(n), 2 * n  # a walk stands at the end after about 2n steps
        self.items, self.walks, self.exact = items, [], False
        rng = np.random.default_rng([_SEED, n])
        own, begins = np.concatenate([words[k] for k in items]), np.arange(len(items)) * n
        tried = [self._edited(words[items[i % len(items)]], rng) for i in range(TRIED if self.edits else 1)]
        copies, source = np.concatenate(tried), np.arange(len(tried)) % len(items)
        missed, keys = np.ones(len(tried), dtype=bool), []
        while missed.mean() > 1 - RECALL:
            if len(self.walks) == MAX_WALKS:
                self.exact, self.walks = True, []
                return
            coins = rng.integers(0, 1 << 64, size=(self.length, 2), dtype=np.uint64) | np.array([1, 0], dtype=np.uint64)
            places = np.stack([np.sort(rng.choice(self.length, size=min(PLACES, self.length), replace=False)) for _ in range(SAMPLES)])
            self.walks.append((coins, places))
            mine = _keys(walks(own, begins, n, self.length, coins), places, len(keys))
            theirs = _keys(walks(copies, np.arange(len(tried)) * n, n, self.length, coins), places, len(keys))
            missed &= ~(mine[source] == theirs).any(1)
            keys.append(mine.ravel())
        found, which = np.concatenate(keys), np.tile(np.repeat(np.array(items), SAMPLES), len(keys))
        order = np.argsort(found, kind="stable")
        self.keys, self.which = found[order], which[order]

    def _edited(self, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The first n words of a copy with as many edits as are allowed; new words are in no item."""
        out = words.tolist()
        for _ in range(self.edits):
            at, kind = int(rng.integers(len(out))), rng.integers(3)
            out[at : at + 1] = [] if kind == 0 else [0] if kind == 1 else [0, out[at]]
        return np.array((out + [0] * self.n)[: self.n], dtype=np.int32)

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, items) that share a bucket."""
        if self.exact:
            yield np.tile(starts, len(self.items)), np.repeat(np.array(self.items), len(starts))
            return
        step = max(1, (1 << 22) // self.length)
        for lo in range(0, len(starts), step):
            part = starts[lo : lo + step]
            for w, (coins, places) in enumerate(self.walks):
                own = _keys(walks(ids, part, self.n, self.length, coins), places, w).ravel()
                left, right = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
                at, sizes = tokens.spans(left, right)
                if len(at):
                    yield np.repeat(np.repeat(part, SAMPLES), sizes), self.which[at]


class Items:
    """One block of items, ready to search."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.number: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.item_ids: list[int] = []
        by_length: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = [w for w in map(normal, text.split()) if w]
            if words:
                by_length[len(words)].append(len(self.words))
                self.words.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], dtype=np.int32))
                self.item_ids.append(item_id)
        self.plans = {n: Plan(n, ks, self.words) for n, ks in by_length.items()}
        #: By size: sorted hashes of the items' runs of so many words, the item of each, and its place there.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({gram(n) for n in by_length}):
            rows = [(h, k, i) for n, ks in by_length.items() if gram(n) == size for k in ks for i, h in enumerate(_grams(self.words[k], size).tolist())]
            table = np.array(rows, dtype=np.uint64)
            table = table[np.argsort(table[:, 0], kind="stable")]
            self.grams[size] = table[:, 0].copy(), table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)

    def _starts(self, ids: np.ndarray, owner: np.ndarray) -> dict[int, np.ndarray]:
        """By length of items: the starts of windows that have a run of an item at about its place there."""
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for size, (hashes, items, places) in self.grams.items():
            own = _grams(ids, size)
            known = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(ids > 0, size).all(1)) if len(own) else own[:0].astype(np.int64)
            own = own[known]
            near = np.searchsorted(hashes, own)
            hit = hashes[np.minimum(near, len(hashes) - 1)] == own
            known, own = known[hit], own[hit]
            at, sizes = tokens.spans(np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right"))
            where, n = np.repeat(known, sizes) - places[at], np.array([len(w) for w in self.words])[items[at]]
            doc = np.repeat(owner[known], sizes)
            for length in np.unique(n).tolist():
                mine, edits = n == length, allowed(length)
                starts = np.unique((where[mine] + (doc[mine] << 40))[:, None] + np.arange(-edits, edits + 1))
                doc_of, starts = (starts + (1 << 39)) >> 40, ((starts + (1 << 39)) & ((1 << 40) - 1)) - (1 << 39)
                fit = (starts >= 0) & (starts < len(ids))
                doc_of, starts = doc_of[fit], starts[fit]
                found[length].append(starts[owner[starts] == doc_of])
        return {n: np.unique(np.concatenate(x)) for n, x in found.items()}

    def search(self, ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, end) of verified finds in documents laid end to end, with a 0 between them (owner:
        document of each word); of finds of an item in a document the nearest, then the first."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, starts in self._starts(ids, owner).items():
            plan = self.plans[n]
            pairs = [np.stack([owner[at], which, at], axis=1) for at, which in plan.candidates(ids, starts)]
            if not pairs:
                continue
            found = np.unique(np.concatenate(pairs), axis=0)
            # starts that are near each other are verified together
            cut = np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(1) | (found[1:, 2] - found[:-1, 2] > n)) + 1
            for group in np.split(found, cut):
                doc, k = int(group[0, 0]), int(group[0, 1])
                first, end = int(np.searchsorted(owner, doc, "left")), int(np.searchsorted(owner, doc, "right")) - 1
                lo = max(int(group[0, 2]) - plan.edits, first)
                text = ids[lo : min(int(group[-1, 2]) + n + plan.edits, end)]
                if np.isin(self.words[k], text).sum() < n - plan.edits:
                    continue
                distance, a, b = edit_ends(self.words[k], text)
                if distance <= plan.edits:
                    best[doc, k] = min(best.get((doc, k), (1 << 30, 0, 0)), (distance, lo + a - first, lo + b - first))
        return [(doc, self.item_ids[k], d, a, b) for (doc, k), (d, a, b) in sorted(best.items())]


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    if len(ids) < size:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out ^ ids[k : len(ids) - size + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _keys(walk: np.ndarray, places: np.ndarray, nth: int) -> np.ndarray:
    """[walk, sample]: a hash of the words at the sampled places, of the sample and of which walk it is."""
    out = np.tile(np.arange(len(places), dtype=np.uint64) + np.uint64(nth << 32), (len(walk), 1))
    for column in range(places.shape[1]):
        out = (out ^ walk[:, places[:, column]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most BLOCK_BYTES of text (or one item), read one block at a time."""
    held, size = [], 0
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    for row in rows.toLocalIterator():
        raw = row.text.encode()
        if held and size + len(raw) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((int(row.item_id), raw))
        size += len(raw)
    if held:
        yield held


SCHEMA = "doc_id long, item_id long, distance long, start_word long, end_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word): every item that a document holds, at its nearest place.

    Places count the document's words (runs outside \\x20\\x09-\\x0D), end exclusive; words without letters or digits are
    passed over inside a find. Null and empty texts hold nothing, empty items are nowhere. Rows that repeat a doc_id each
    give their own rows; a null doc_id is carried along. Items that repeat give a row each. Further columns are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, known = shared.value, {}
            for ids, texts in common.text_rows(batches):
                rows = list(_search(items, ids, texts, known))
                if len(known) > _CACHE:
                    known.clear()
                if rows:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance", "start_word", "end_word"])

        rows = docs.mapInArrow(run, SCHEMA)
        found = rows if found is None else found.union(rows)
    if found is None:
        found = docs.select(*[F.lit(None).cast("long").alias(x.split()[0]) for x in SCHEMA.split(", ")]).where("false")
    return found


def _search(items: Items, doc_ids: list, texts: list[bytes], known: dict[bytes, int]) -> Iterator[tuple]:
    words, ends = tokens.words_of(texts)
    listed = words.dictionary.to_pylist()  # each with a space behind it; a space alone is no word
    for w in listed:
        if w not in known:
            core = normal(w[:-1])
            known[w] = items.number.get(core, 0) if core else -1 if len(w) > 1 else -2
    row = np.array([known[w] for w in listed], dtype=np.int32)[words.indices.to_numpy()]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    solid = row > -2
    place = np.cumsum(solid) - 1  # a word's number, over all texts
    row, owner, place = row[solid], owner[solid], place[solid]
    first = np.searchsorted(owner, np.arange(len(texts)))
    at = np.flatnonzero(row >= 0)
    behind = np.searchsorted(owner[at], np.arange(len(texts)), "right")
    ids, owners = np.insert(row[at], behind, 0), np.insert(owner[at], behind, np.arange(len(texts)))
    begin = np.searchsorted(owner[at], np.arange(len(texts)))
    for doc, item, distance, a, b in items.search(ids, owners):
        if b > a:
            own = place[at[begin[doc] + a]] - first[doc], place[at[begin[doc] + b - 1]] - first[doc] + 1
            yield doc_ids[doc], item, distance, int(own[0]), int(own[1])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    spark = docs.sparkSession
    common.tune(spark)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(block))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, int] = {}
            for batch in batches:
                hit = {x[0] for x in _search(shared.value, list(range(batch.num_rows)), common.raw_texts(batch.column("text")), known)} if batch.num_rows else set()
                if len(known) > _CACHE:
                    known.clear()
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def benchmark_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
