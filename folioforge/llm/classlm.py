"""Language-model scores from Brown class-based bigrams.

p(word | before) = p(class(word) | class(before)) * p(word | class(word)). Exchange clustering assigns every word of the
training texts to a class: a word goes to the class that raises the bigram likelihood most. Transitions are interpolated
with class frequencies, emissions have half a count added and half for one unknown word type in each class.

Seeds are exchanged one by one on the driver, with the end and all other words as classes of their own; the letters that
tell the seeds' classes give the other words a first class. Then rounds go over the texts: each word's counts of the classes
before and after it meet in a bucket of words, and the bucket exchanges its words against the class-by-class table. A round
that does not raise the likelihood is undone. Words beyond the head, which stand in those rounds as a class of rare words,
are exchanged last, in a table of their own. Only words that no training text has go by their letters to the end.

Word counts grow with the corpus. A bounded table of the most frequent words, the head, goes to the texts, which are kept as
chunks of its numbers (`coded`). The words beyond it are dealt out once for each chunk, with what stands beside them; where
equal words of all chunks meet, they are counted and get their class, and both go back to the chunks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common, tokens

#: Words that are exchanged one by one, classes, words of the table that goes to the texts, and its words' length.
CLUSTERED, CLASSES, HEAD, HEAD_BYTES = 1500, 32, 400_000, 64
#: Weight of the class frequencies in transitions, as a number of tokens.
BACKOFF = 20.0
#: The end of a text, which no word can be, as a word has no white space.
END = b"\n"
#: Rounds over all words of the head, and the buckets that its words are dealt to.
ROUNDS, BUCKETS = 3, 256
#: Words that have these letters, for the letters to tell the class of an unknown word.
LEAST_ALIKE = 8
#: Cells of a word on a side: the classes, rare words, and the word itself.
_RARE, _SELF, _CELLS = CLASSES, CLASSES + 1, CLASSES + 2
_CACHE = 500_000


def in_training(doc_id):
    return common.mod_of_id(doc_id, 5) != 1


def _parts(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of words by bucket of their hash."""
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), dtype=np.int64, count=len(words))
    order = np.argsort(bucket, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(at):
            yield int(bucket[at[0]]), at


def _pressed(words: list[bytes], at) -> bytes:
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(b" ".join([words[k] for k in at]))


def _unpressed(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split()


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all texts of train, with their ends; tasks add up before words are dealt out, by buckets."""
    parts = _parts(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            n = np.fromiter(held.values(), dtype=np.int64, count=len(words))
            rows = [(b, _pressed(words, at.tolist()), n[at].astype("<u8").tobytes()) for b, at in _by_bucket(words, 8 * parts)]
            held.clear()
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "words", "n"])

        ends = 0
        for _, texts in common.text_rows(batches):
            words, codes, _ = common.word_codes([x.lower() for x in texts])
            ends += len(texts)
            for w, c in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                if w:
                    held[w] = held.get(w, 0) + c
            if len(held) > _CACHE:
                yield from out()
        yield from out()
        if ends:
            yield pa.record_batch({"bucket": pa.array([-1], pa.int32()), "words": pa.array([None], pa.binary()), "n": pa.array([np.array([ends], dtype="<u8").tobytes()], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for lo in range(0, len(words), 1 << 16):
                part = words[lo : lo + (1 << 16)]
                yield pa.record_batch({"word": pa.array(part, pa.binary()), "c": pa.array([held[w] for w in part], pa.int64())})
            held.clear()

        for batch in batches:
            for bucket, words, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from out()
                    now = bucket
                for w, c in zip([END] if words is None else _unpressed(words), np.frombuffer(n, dtype="<u8").tolist(), strict=True):
                    held[w] = held.get(w, 0) + c
        yield from out()

    rows = train.mapInArrow(run, "bucket int, words binary, n binary")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "word binary, c long")


@dataclass
class Classes:
    """Class of each clustered word (the end of a text has its own), and class scores of first and last letters."""

    known: dict[bytes, int]
    parts: dict[bytes, np.ndarray]
    rest: np.ndarray
    n: int

    def __post_init__(self) -> None:
        self.held: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        held = self.held
        if len(held) > _CACHE:
            held.clear()
        try:
            return np.array(list(map(held.__getitem__, words)), dtype=np.int64)
        except KeyError:
            for w in set(words):
                if w not in held:
                    held[w] = self.one(w)
            return np.array(list(map(held.__getitem__, words)), dtype=np.int64)

    def one(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is not None:
            return found
        score = self.rest
        for part in parts_of(word):
            own = self.parts.get(part)
            if own is not None:
                score = score + own
        return int(score.argmax())


def parts_of(word: bytes) -> list[bytes]:
    core = word.strip(b".,;:!?\"'()") or word
    return [b"^" + core[:2], b"^" + core[:4], b"$" + core[-2:], b"$" + core[-4:]]


CODED = "docs array<long>, train array<boolean>, sizes binary, codes binary, tail binary"


def encode(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """Rows of CODED from docs (doc_id, text, train), one for each batch of texts: their tokens' numbers, -1 - k for the k-th of
    the batch's words (tail) that aren't in index, and how many tokens each text has. Ends have number 0."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            if not batch.num_rows:
                continue
            words, codes, ends = common.word_codes([x.lower() for x in common.raw_texts(batch.column("text"))])
            listed = list(map(get, words))
            tail = [k for k, (w, x) in enumerate(zip(words, listed, strict=True)) if x is None and w]
            number = np.array([0 if x is None else x for x in listed], dtype=np.int32)
            number[tail] = -1 - np.arange(len(tail))
            yield pa.record_batch(
                {
                    "docs": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "train": pa.array([batch.column("train").to_pylist()], pa.list_(pa.bool_())),
                    "sizes": pa.array([(np.diff(ends, prepend=0) + 1).astype("<i8").tobytes()], pa.binary()),
                    "codes": pa.array([bpe.pack(np.insert(number[codes], ends, 0).view(np.uint32))], pa.binary()),
                    "tail": pa.array([_pressed(words, tail)], pa.binary()),
                }
            )

    return docs.select("doc_id", "text", "train").mapInArrow(run, CODED)


class Coded:
    """A row of CODED: numbers of its tokens, which of them are in training, and where each text ends."""

    def __init__(self, codes: bytes, sizes: bytes, train: list[bool]):
        self.codes = bpe.unpack(codes).view(np.int32)
        self.sizes = np.frombuffer(sizes, dtype="<i8")
        self.train = np.array(train, dtype=bool)

    def learning(self) -> np.ndarray:
        """The numbers of training texts, end to end: a text starts after an end, as the one before it ends with one."""
        return self.codes if self.train.all() else self.codes[np.repeat(self.train, self.sizes)]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[Coded]:
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("codes", "sizes", "train")), strict=True):
            yield Coded(*row)


def _learning(coded: DataFrame) -> DataFrame:
    return coded.select("codes", "sizes", "train")


def bigrams(coded: DataFrame, at: dict[int, int], end: int) -> np.ndarray:
    """[before, after]: counts of neighbours by their places in `at`, where row and column 0 stand for all other words."""
    size = len(at) + 1
    place = np.zeros(max(at, default=0) + 2, dtype=np.int64)
    for code, k in at.items():
        place[code] = k
    top = len(place) - 1  # stands for all others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size * size, dtype=np.int64)
        for row in _coded(batches):
            codes = row.learning()
            ids = place[np.where((codes < 0) | (codes > top), top, codes)]
            out += np.bincount(np.concatenate([[at[end]], ids[:-1]]) * size + ids, minlength=size * size)
        yield from common.sparse(out)

    return common.dense(_learning(coded).mapInArrow(run, "at long, n long"), size * size).reshape(size, size)


def exchange(pairs: np.ndarray, classes: int, rounds: int = 12, fixed: int = 0) -> np.ndarray:
    """Exchange clustering: the class of each word, given counts of neighbouring words. The last `fixed` words keep classes
    of their own, beyond `classes`, which no other word enters.

    The likelihood of the class bigram is sum N(c, d) log N(c, d) - sum N(c) log N(c) over left and right counts, up to
    what no move changes. Words start spread over the classes in the order of their frequency; ties keep a word where it
    is.
    """
    n = len(pairs) - fixed
    own = np.concatenate([np.arange(n) % classes, classes + np.arange(fixed)])
    if n == 0:
        return own
    xlogx = _xlogx
    member = np.zeros((n + fixed, classes + fixed))
    member[np.arange(n + fixed), own] = 1
    left, right = pairs.T @ member, pairs @ member  # [word, class before it], [word, class after it]
    table = member.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a, self_ = own[w], pairs[w, w]
            out, into = right[w].copy(), left[w].copy()
            out[a] -= self_
            into[a] -= self_
            # take the word out of its class
            table[a, :] -= out
            table[:, a] -= into
            table[a, a] -= self_
            row, column = table.sum(1), table.sum(0)
            total_out, total_in = out.sum() + self_, into.sum() + self_
            # put it into each class in turn: row c gains out, column c gains into, the corner gains all three
            gain_row = (xlogx(table + out[None, :]) - xlogx(table)).sum(1)
            gain_column = (xlogx(table + into[:, None]) - xlogx(table)).sum(0)
            corner = np.diag(table)
            gain_corner = xlogx(corner + out + into + self_) - xlogx(corner + out) - xlogx(corner + into) + xlogx(corner)
            sizes = xlogx(row + total_out) - xlogx(row) + xlogx(column + total_in) - xlogx(column)
            gain = gain_row + gain_column + gain_corner - sizes
            b = int(gain[:classes].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b, :] += out
            table[:, b] += into
            table[b, b] += self_
            if b != a:
                moved += 1
                own[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w, :]
                left[:, b] += pairs[w, :]
        if moved <= n // 500:
            break
    return own


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0)


def likelihood(table: np.ndarray) -> float:
    """Of the class bigram, up to what no move changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def gains(before: np.ndarray, after: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """[word, class]: what each word adds to the likelihood in each class, when it is taken out of its own.

    before, after: [word, cell], counts of the classes beside the word, of rare words and of the word itself.
    """
    classes, self_ = len(table), after[:, _SELF]
    every = np.arange(classes)
    at_own = every[None, :] == own[:, None]
    out = np.zeros((len(own), classes))
    for mine, other, side in ((after, before, table), (before, after, table.T)):  # side[b, d]: b is the word's, d its neighbour's
        who, d = np.nonzero(mine[:, :classes])
        n = mine[who, d][:, None]
        base = side.T[d] - np.where((d == own[who])[:, None], other[who, :classes], 0)
        base = base - np.where(at_own[who], n + np.where(d == own[who], self_[who], 0)[:, None], 0)
        np.add.at(out, who, _xlogx(np.maximum(base, 0) + n) - _xlogx(np.maximum(base, 0)))
        total = mine.sum(1, keepdims=True)
        size = np.maximum(side.sum(1)[None, :] - np.where(at_own, total, 0), 0)
        out -= _xlogx(size + total) - _xlogx(size)
    a, b, s = after[:, :classes], before[:, :classes], self_[:, None]
    corner = np.maximum(np.diag(table)[None, :] - np.where(at_own, a + b + s, 0), 0)
    return out + _xlogx(corner + a + b + s) - _xlogx(corner + a) - _xlogx(corner + b) + _xlogx(corner)


def moved(before: np.ndarray, after: np.ndarray, own: np.ndarray, table: np.ndarray, step: int = 512) -> np.ndarray:
    """The words' classes after an exchange against the table, which follows the moves of each step of words."""
    own, table = own.copy(), table.copy()
    empty = table.sum(0)[:CLASSES] == 0  # all buckets at once would enter it
    for lo in range(0, len(own), step):
        part = slice(lo, lo + step)
        gain = gains(before[part], after[part], own[part], table)
        old = own[part].copy()
        best = np.where(empty, -np.inf, gain[:, :CLASSES])[:, 1:].argmax(1) + 1  # 0 is the end's alone
        at = np.arange(len(old))
        new = np.where((gain[at, best] > gain[at, old] + 1e-9) | (old == _RARE), best, old)
        own[part] = new
        for k in np.flatnonzero((new != old) & (old != _RARE)):
            a, b, (x, y) = old[k], new[k], (before[lo + k], after[lo + k])
            table[a] -= y[: len(table)]
            table[:, a] -= x[: len(table)]
            table[a, a] -= y[_SELF]
            table[b] += y[: len(table)]
            table[:, b] += x[: len(table)]
            table[b, b] += y[_SELF]
        np.maximum(table, 0, out=table)
    return own


def learn_classes(top: list[tuple[bytes, int]], pairs: np.ndarray, index: dict[bytes, int]) -> Classes:
    """Classes of the seeds by exchange, and the letters that tell them. All other words and the end take part as classes of
    their own."""
    words = [w for w in index if w != END]
    at = np.array([*(index[w] for w in words), 0, index[END]], dtype=np.int64)
    own = exchange(pairs[np.ix_(at, at)], CLASSES - 1, fixed=2)[: len(words)] + 1
    return by_letters(words, own, 1)


def by_letters(words: list[bytes], own: np.ndarray, least: int) -> Classes:
    """The words' classes, and how letters that at least so many of the words have tell the class."""
    known = {END: 0} | {w: int(c) for w, c in zip(words, own, strict=True)}
    total = np.bincount(own, minlength=CLASSES).astype(np.float64)  # words count, not tokens: rare words look like many words of a class
    tally = Counter((part, int(c)) for w, c in zip(words, own, strict=True) for part in parts_of(w))
    number: Counter = Counter()
    for (part, _), n in tally.items():
        number[part] += n
    cells = {part: np.zeros(CLASSES) for part, n in number.items() if n >= least}
    for (part, c), n in tally.items():
        if part in cells:
            cells[part][c] += n
    prior = (total + 0.1) / (total.sum() + 0.1 * CLASSES)
    parts = {p: np.log((x + 2 * prior) / (x.sum() + 2)) - np.log(prior) for p, x in cells.items()}
    rest = np.log(prior)
    rest[0] = -1e9  # ends only
    for x in parts.values():
        x[0] = 0
    return Classes(known, parts, rest, CLASSES)


def _with_rare(own: np.ndarray) -> np.ndarray:
    """Classes by code, where -1 (the last) stands for rare words."""
    return np.append(own, _RARE).astype(np.int64)


def table_of(coded: DataFrame, own: np.ndarray) -> np.ndarray:
    """[class before, class]: counts over all tokens, with rare words as a class."""
    size, shared = CLASSES + 1, coded.sparkSession.sparkContext.broadcast(_with_rare(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size * size, dtype=np.int64)
        for row in _coded(batches):
            c = shared.value[np.maximum(row.learning(), -1)]
            out += np.bincount(np.concatenate([[0], c[:-1]]) * size + c, minlength=size * size)
        yield from common.sparse(out)

    return common.dense(_learning(coded).mapInArrow(run, "at long, n long"), size * size).reshape(size, size)


def exchange_round(coded: DataFrame, own: np.ndarray, end: int, table: np.ndarray) -> np.ndarray:
    """The classes of the head's words after each bucket of them has been exchanged against the table."""
    spark, n = coded.sparkSession, len(own)
    shared, per = spark.sparkContext.broadcast(_with_rare(own)), -(-n // BUCKETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(BUCKETS * per * 2 * _CELLS, dtype=np.uint32)  # as many as the head has words, whatever the input
        for row in _coded(batches):
            codes = np.maximum(row.learning(), -1).astype(np.int64)
            if not len(codes):
                continue
            c = shared.value[codes]
            word = (codes % BUCKETS * per + codes // BUCKETS) * (2 * _CELLS)
            same = codes[1:] == codes[:-1]
            mine = (codes >= 0) & (codes != end)
            np.add.at(cells, (word[1:] + np.where(same, _SELF, c[:-1]))[mine[1:]], np.uint32(1))
            np.add.at(cells, (word[:-1] + _CELLS + np.where(same, _SELF, c[1:]))[mine[:-1]], np.uint32(1))
            if mine[0]:
                cells[word[0]] += 1  # after an end
        for b, found in enumerate(cells.reshape(BUCKETS, -1)):
            at = np.flatnonzero(found)
            if len(at):
                yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "keys": pa.array([bpe.pack(np.diff(at, prepend=0))], pa.binary()), "n": pa.array([bpe.pack(found[at])], pa.binary())})

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, keys, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "n")), strict=True):
                cells = found.setdefault(b, np.zeros(per * 2 * _CELLS))
                cells[np.cumsum(bpe.unpack(keys), dtype=np.int64)] += bpe.unpack(c)
        for b, cells in found.items():
            ids = np.arange(per) * BUCKETS + b
            cells = cells.reshape(per, 2, _CELLS)[ids < n]
            ids = ids[ids < n]
            some = np.flatnonzero(cells.sum((1, 2)))
            new = moved(cells[some, 0], cells[some, 1], shared.value[ids[some]], table)
            yield pa.record_batch({"id": pa.array(ids[some], pa.int32()), "class": pa.array(new, pa.int32())})

    dealt = _learning(coded).mapInArrow(count, "bucket int, keys binary, n binary").repartition(_parts(spark), "bucket")
    got, out = dealt.mapInArrow(swap, "id int, class int").toArrow(), own.copy()
    out[got["id"].to_numpy()] = got["class"].to_numpy()
    return out


def exchange_head(coded: DataFrame, own: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of exchange over the head's words while the likelihood rises; the classes and their table."""
    table = table_of(coded, own)
    for _ in range(ROUNDS):
        new = exchange_round(coded, own, end, table)
        if (new == own).all():
            break
        after = table_of(coded, new)
        if likelihood(after) <= likelihood(table):
            break
        own, table = new, after
    return own, table


#: Kinds of rows of FOUND: a chunk's tail words with their counts and classes, and for a bucket the words of each class.
REPLY, CHUNK, TYPES = 0, 1, 2
FOUND = "chunk long, kind int, places binary, times binary, classes binary"


def exchange_tail(coded: DataFrame, own: np.ndarray, table: np.ndarray) -> DataFrame:
    """Rows of FOUND for all words beyond the head: each goes where it raises the likelihood most. Words that no training text
    has count 0 and have no class (255).

    coded has a number for each row (chunk). A chunk sends a word once, with how often it stands between which classes; a task
    holds the words of one bucket.
    """
    spark, side = coded.sparkSession, _RARE + 1
    parts, shared = _parts(spark), spark.sparkContext.broadcast(_with_rare(own))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, tail, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "tail", "codes", "sizes", "train")), strict=True):
                words, codes = _unpressed(tail), Coded(*row).learning()
                if not words:
                    continue
                c = np.concatenate([[0], shared.value[np.maximum(codes, -1)]])
                at = np.flatnonzero(codes < 0)  # never the last, an end
                keys, times = np.unique((-1 - codes[at].astype(np.int64)) * side * side + c[at] * side + c[at + 2], return_counts=True)
                stops = np.searchsorted(keys, np.arange(len(words) + 1) * side * side)
                rows = []
                for bucket, mine in _by_bucket(words, 8 * parts):
                    pick, n = tokens.spans(stops[mine], stops[mine + 1])
                    rows.append((bucket, chunk, _pressed(words, mine.tolist()), bpe.pack(mine), bpe.pack(n), bpe.pack(keys[pick] % (side * side)), bpe.pack(times[pick])))
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "chunk", "words", "places", "n", "cells", "times"])

    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        which = [np.array([numbers.setdefault(w, len(numbers)) for w in _unpressed(row[2])], dtype=np.int64) for row in held]
        word = np.concatenate([np.repeat(w, bpe.unpack(row[4])) for w, row in zip(which, held, strict=True)])
        cell, times = (np.concatenate([bpe.unpack(row[k]) for row in held]).astype(np.int64) for k in (5, 6))
        order = np.argsort(word, kind="stable")
        word, cell, times = word[order], cell[order], times[order]
        count, classes = np.bincount(word, weights=times, minlength=len(numbers)).astype(np.int64), np.full(len(numbers), 255, dtype=np.uint8)
        seen = np.flatnonzero(count)
        for lo in range(0, len(seen), 4096):
            some = seen[lo : lo + 4096]
            part = slice(*np.searchsorted(word, [some[0], some[-1] + 1]))
            row = np.searchsorted(some, word[part])
            before, after = np.zeros((len(some), _CELLS)), np.zeros((len(some), _CELLS))
            np.add.at(before, (row, cell[part] // side), times[part])
            np.add.at(after, (row, cell[part] % side), times[part])
            classes[some] = moved(before, after, np.full(len(some), _RARE), table)
        for w, row in zip(which, held, strict=True):
            yield _found(row[1], REPLY, row[3], bpe.pack(count[w]), classes[w].tobytes())
        yield _found(-1, TYPES, b"", np.bincount(classes[seen], minlength=CLASSES).astype("<i8").tobytes(), b"")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield from settled(held)
                    held = []
                held.append(row)
        if held:
            yield from settled(held)

    rows = coded.select("chunk", "tail", "codes", "sizes", "train").mapInArrow(around, "bucket int, chunk long, words binary, places binary, n binary, cells binary, times binary")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, FOUND)


def tail_types(found: DataFrame) -> np.ndarray:
    """How many words beyond the head each class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("times").to_pylist():
                out += np.frombuffer(raw, dtype="<i8")
        yield from common.sparse(out)

    return common.dense(found.where(F.col("kind") == TYPES).select("times").mapInArrow(run, "at long, n long"), CLASSES)


def _found(chunk: int, kind: int, places: bytes, times: bytes, classes: bytes) -> pa.RecordBatch:
    return pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "kind": pa.array([kind], pa.int32()), "places": pa.array([places], pa.binary()), "times": pa.array([times], pa.binary()), "classes": pa.array([classes], pa.binary())})


def fill(coded: DataFrame, found: DataFrame, own: np.ndarray, weights: np.ndarray, letters: Classes) -> DataFrame:
    """(docs, train, n_tokens, n_known, weight, classes) for each chunk: texts' tokens, known tokens and sums of log10(c + 0.5),
    and all tokens' classes. Words beyond the head have class and count from found; what has none goes by its letters."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((own.astype(np.uint8), weights, letters))
    schema = "docs array<long>, train array<boolean>, n_tokens array<long>, n_known array<long>, weight array<double>, classes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights, letters = shared.value
        now, replies = None, []
        for batch in batches:
            for chunk, kind, places, times, classes, ids, train, sizes, codes, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    now, replies = chunk, []
                if kind == REPLY:
                    replies.append((places, times, classes))
                    continue
                row, words = Coded(codes, sizes, train), _unpressed(tail)
                count, cls = np.zeros(len(words), dtype=np.int64), np.full(len(words), 255, dtype=np.uint8)
                for p, t, c in replies:
                    at = bpe.unpack(p)
                    count[at], cls[at] = bpe.unpack(t), np.frombuffer(c, dtype=np.uint8)
                new = np.flatnonzero(cls == 255)
                cls[new] = letters.of([words[k] for k in new.tolist()])
                # tail words stand behind the head's, the last one first
                kinds = np.concatenate([own, cls[::-1]])
                logs = np.concatenate([weights, np.log10(count[::-1] + 0.5)])
                seen = np.concatenate([np.ones(len(own), dtype=bool), count[::-1] > 0])
                seen[0] = weights[0] > np.log10(0.5)  # no training text, no end
                first = np.cumsum(row.sizes) - row.sizes
                yield pa.record_batch(
                    {
                        "docs": pa.array([ids], pa.list_(pa.int64())),
                        "train": pa.array([train], pa.list_(pa.bool_())),
                        "n_tokens": pa.array([row.sizes], pa.list_(pa.int64())),
                        "n_known": pa.array([np.add.reduceat(seen[row.codes].astype(np.int64), first)], pa.list_(pa.int64())),
                        "weight": pa.array([np.add.reduceat(logs[row.codes], first)], pa.list_(pa.float64())),
                        "classes": pa.array([zstandard.ZstdCompressor(level=1).compress(kinds[row.codes].tobytes())], pa.binary()),
                    }
                )

    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CODED.split(", "))]
    payload = coded.select("chunk", F.lit(CHUNK).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in ("places", "times", "classes")], "docs", "train", "sizes", "codes", "tail")
    rows = found.where(F.col("kind") == REPLY).select("*", *none).union(payload)
    return rows.repartition(_parts(spark), "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)


def _classes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes, sizes and training flags of each row of a batch of `fill`."""
    unpress = zstandard.ZstdDecompressor()
    for raw, sizes, train in zip(*(batch.column(c).to_pylist() for c in ("classes", "n_tokens", "train")), strict=True):
        yield np.frombuffer(unpress.decompress(raw), dtype=np.uint8), np.array(sizes, dtype=np.int64), np.array(train, dtype=bool)


def transitions(filled: DataFrame) -> np.ndarray:
    """[class before, class]: counts over all tokens of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            for c, sizes, train in _classes(batch):
                c = c[np.repeat(train, sizes)]
                out += np.bincount(np.concatenate([[0], c[:-1]]).astype(np.int64)[: len(c)] * CLASSES + c, minlength=CLASSES * CLASSES)
        yield from common.sparse(out)

    return common.dense(filled.select("classes", "n_tokens", "train").mapInArrow(run, "at long, n long"), CLASSES * CLASSES).reshape(CLASSES, CLASSES)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    A null text is empty and has one token, its end. Rows that repeat a doc_id each give a row and each count in training;
    a null doc_id is in training or not by the empty text. Further columns are ignored; an empty table gives an empty
    table; without training rows every count is zero.
    """
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.work_dir(spark, "classlm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = in_training(F.col("doc_id"))
    counts = common.written(count_words(docs.where(train)), folder, "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v = int(total.n or 0), int(total.v)
    head = counts.where((F.length("word") <= HEAD_BYTES) & (F.col("word") != F.lit(END))).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    words, c = [END, *map(bytes, head["word"].to_pylist())], head["c"].to_numpy()
    ends = counts.where(F.col("word") == F.lit(END)).first()
    c = np.concatenate([[ends.c if ends else 0], c])
    index = {w: i for i, w in enumerate(words)}
    coded = common.written(encode(docs.withColumn("train", train), index).withColumn("chunk", F.monotonically_increasing_id()), folder, "coded")

    seeds = {w: i for i, w in enumerate(words[1 : CLUSTERED + 1], 1)} | {END: min(CLUSTERED, len(words) - 1) + 1}
    pairs = bigrams(coded, {index[w]: k for w, k in seeds.items()}, index[END])
    first = learn_classes([], pairs, seeds)
    own, table = exchange_head(coded, np.array([first.one(w) for w in words], dtype=np.int64), index[END])
    letters = by_letters(words[1:], own[1:], LEAST_ALIKE)
    letters.known = {END: 0}  # the rest of the known words have numbers or are in the tail

    found = common.written(exchange_tail(coded, own, table), folder, "tail")
    filled = common.written(fill(coded, found, own, np.log10(c + 0.5), letters), folder, "filled")
    steps = transitions(filled)
    size, types = steps.sum(0), np.bincount(own[c > 0], minlength=CLASSES) + tail_types(found)
    share = (steps.sum(0) + 0.5) / (steps.sum() + 0.5 * CLASSES)
    steps = np.log10((steps + BACKOFF * share[None, :]) / (steps.sum(1, keepdims=True) + BACKOFF))
    gain = steps - np.log10(size + 0.5 * (types + 1))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(x).to_pylist() for x in ("docs", "n_known", "weight")), strict=True)
            for (ids, known, weight), (k, sizes, _) in zip(rows, _classes(batch), strict=True):
                out = np.add.reduceat(gain[np.concatenate([[0], k[:-1]]), k], np.cumsum(sizes) - sizes)
                yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(sizes), "n_known": pa.array(known, pa.int64()), "weight": pa.array(weight, pa.float64()), "steps": pa.array(out)})

    level = math.log10(n_train + 0.5 * (v + 1))
    return filled.mapInArrow(run, "doc_id long, n_tokens long, n_known long, weight double, steps double").select(
        "doc_id",
        (~train).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("weight") - F.col("n_tokens") * F.lit(level)).alias("base_score"),
        (F.col("weight") + F.col("steps")).alias("score"),
    )
