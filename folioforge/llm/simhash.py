"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts become 64-bit fingerprints over three-word shingles. The 64 bits are grouped by correlation into eight groups of
eight; a partition is a run of groups. Two fingerprints that differ in at most tau bits differ, in at least one of m
partitions, in at most t_i bits whenever the t_i + 1 sum to tau + 1 (t_i = -1: the partition is not probed). Each
fingerprint gets its own t by dynamic programming on candidate counts that are estimated from histograms of the groups,
so it is not probed where its value is common. Every fingerprint stands at its own value of each partition and asks at the
values within its threshold; one that asks and one that stands at the same value are candidates, are verified there, and
every bucket returns a spanning forest of its links instead of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Partition layouts to choose from, as numbers of eight-bit groups.
LAYOUTS = ((2, 2, 2, 2), (3, 3, 2), (4, 4))
#: Cost of a probe row (a shuffled row) and of a candidate (one XOR and bit count).
PROBE_COST, CANDIDATE_COST = 1.0, 0.01
_SHINGLES = 1 << 16
#: Fingerprints whose probes a task holds at a time; one has up to 5,489 at three bits.
PROBED = 512
#: What a row does in a bucket, as bits.
STANDS, ASKS = 1, 2
#: Of keep_one: words of a shingle, least Jaccard similarity of near duplicates, 64-bit fingerprints of a text, bits of each that
#: the partitions cover, and bits of the first CARRIED fingerprints in which candidates differ at most. At a similarity of 0.8 a
#: bit differs with a chance of 0.151; then 20 partitions of 16 bits within one bit miss 0.15 % and the carried bits 0.005 %.
WIDTH, SIMILAR, PRINTS, WITHIN, CARRIED, APART = 5, 0.8, 5, 7, 2, 36
#: Rows of a small bucket, which are compared together with those of other small ones.
SMALL = 64
#: Edges that a task gathers before it passes them on.
FOREST = 1 << 16

def fingerprint(raw: bytes) -> int:
    """Unsigned fingerprint of a text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < 3:
        words = [b" ".join(words)]
        n, hashes = 1, [xxhash.xxh64_intdigest(words[0], 42)]
        counts = _bits(hashes)
    else:
        n, counts, hashed = len(words) - 2, np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
        for lo in range(0, n, _SHINGLES):  # a very long text goes through in pieces
            part = words[lo : lo + _SHINGLES + 2]
            counts += _bits([hashed(x, 42) for x in map(b" ".join, zip(part, part[1:], part[2:], strict=False))])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_rows(batches):
            fps = np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(fps)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ordered_bits(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The eight group values of each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps.astype(">u8")).view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits[:, order], axis=1)


def bit_order(together: np.ndarray, n: float) -> np.ndarray:
    """Groups of eight correlated bits, from how often two bits are set together; groups that correlate stand side by side."""
    p = together / max(n, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    phi = np.abs(p - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0)
    free, order = list(range(64)), []
    while free:
        last = order[-8:]
        first = max(free, key=lambda b: (phi[b, last].mean() if last else phi[b].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < 8:
            best = max(free, key=lambda b: (phi[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        order += group
    return np.array(order)


def distance_tables(histogram: np.ndarray, tau: int) -> np.ndarray:
    """[group, value, d]: the share of fingerprints whose group value is at distance d from value."""
    values = np.arange(256)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    out = np.zeros((8, 256, tau + 1))
    for g in range(8):
        share = histogram[g] / max(histogram[g].sum(), 1)
        for d in range(tau + 1):
            out[g, :, d] = (share[None, :] * (apart == d)).sum(1)
    return out


def allocate(groups: np.ndarray, layout: tuple[int, ...], tables: np.ndarray, n: float, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the thresholds of the partitions (-1: not probed) and their estimated cost."""
    size, units = len(groups), tau + 1
    costs, at = [], 0
    for width in layout:
        near = np.zeros((size, tau + 1))
        near[:, 0] = 1
        for g in range(at, at + width):  # distances add up over groups taken as independent
            own, total = tables[g, groups[:, g]], np.zeros_like(near)
            for d in range(tau + 1):
                total[:, d:] += near[:, : tau + 1 - d] * own[:, d : d + 1]
            near = total
        probes = np.cumsum([_choose(8 * width, d) for d in range(tau + 1)])
        cost = np.zeros((size, units + 1))
        cost[:, 1:] = PROBE_COST * probes + CANDIDATE_COST * n * np.cumsum(near, axis=1)
        costs.append(cost)
        at += width
    best, picks = np.full((size, units + 1), np.inf), []
    best[:, 0] = 0
    for cost in costs:
        options = np.full((size, units + 1, units + 1), np.inf)  # [., units so far, units of this partition]
        for total in range(units + 1):
            for own in range(total + 1):
                options[:, total, own] = best[:, total - own] + cost[:, own]
        picks.append(options.argmin(2))
        best = options.min(2)
    left, out = np.full(size, units), np.zeros((size, len(layout)), dtype=np.int64)
    for i in reversed(range(len(layout))):
        out[:, i] = picks[i][np.arange(size), left]
        left -= out[:, i]
    return out - 1, best[:, units]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _flips(width: int, radius: int) -> np.ndarray:
    """Masks of 1 to radius bits below width."""
    return np.array([sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(width), r)], dtype=np.uint64)


def _plans(nodes: DataFrame, names: list[str], tau: int) -> tuple[list[tuple[np.ndarray, np.ndarray, tuple[int, ...]]], float]:
    """Order of bits, distance tables and layout for each column of fingerprints, and how many rows there are."""
    cells = 64 * 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(names) * cells + 1)
        for batch in (b.slice(lo, PROBED) for b in batches for lo in range(0, b.num_rows, PROBED)):
            for k, name in enumerate(names):
                bits = np.unpackbits(batch.column(name).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                out[k * cells : (k + 1) * cells] += (bits.T @ bits).ravel()
            out[-1] += batch.num_rows
        yield from common.sparse(out)

    rows = nodes.select(*names)
    stats = common.dense(rows.mapInArrow(count, "at long, n double"), len(names) * cells + 1)
    n, orders = stats[-1], [bit_order(stats[k * cells : (k + 1) * cells].reshape(64, 64), stats[-1]) for k in range(len(names))]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(names) * 8 * 256)
        for batch in batches:
            for k, name in enumerate(names):
                values = _ordered_bits(batch.column(name).to_numpy(), orders[k])
                for g in range(8):
                    out[(8 * k + g) * 256 : (8 * k + g + 1) * 256] += np.bincount(values[:, g], minlength=256)
        yield from common.sparse(out)

    histograms = common.dense(rows.mapInArrow(spread, "at long, n double"), len(names) * 8 * 256).reshape(len(names), 8, 256)
    tables = [distance_tables(x, tau) for x in histograms]

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(names), len(LAYOUTS)))
        for batch in (b.slice(lo, PROBED) for b in batches for lo in range(0, b.num_rows, PROBED)):
            for k, name in enumerate(names):
                values = _ordered_bits(batch.column(name).to_numpy(), orders[k])
                out[k] += [allocate(values, x, tables[k], n, tau)[1].sum() for x in LAYOUTS]
        yield from common.sparse(out.ravel())

    prices = common.dense(rows.mapInArrow(price, "at long, n double"), len(names) * len(LAYOUTS)).reshape(len(names), -1)
    return [(orders[k], tables[k], LAYOUTS[int(prices[k].argmin())]) for k in range(len(names))], n


def _partitions(values: np.ndarray, layout: tuple[int, ...]) -> Iterator[np.ndarray]:
    """The value of each partition, from the group values of fingerprints."""
    at = 0
    for width in layout:
        value = np.zeros(len(values), dtype=np.uint64)
        for g in range(at, at + width):
            value = value << np.uint64(8) | values[:, g]
        at += width
        yield value


def links(nodes: DataFrame, folder: str, tau: int = 3, block: int = 512) -> DataFrame:
    """Edges (a, b) that connect all nodes (node, fp) whose fingerprints differ in at most tau bits; fp must be distinct.

    Connectivity is kept, pairs are not listed: each bucket gives a spanning forest of its links. A bucket of over
    `block` rows is dealt out as pairs of blocks, so no task holds more than two blocks of it.
    """
    spark = nodes.sparkSession
    ((order, tables, layout),), n = _plans(nodes, ["fp"], tau)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, PROBED) for b in batches for lo in range(0, b.num_rows, PROBED)):
            fps, ids = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            values = _ordered_bits(fps, order).astype(np.uint64)
            t, _ = allocate(values.astype(np.int64), layout, tables, n, tau)
            at, keys, owners, roles = 0, [], [], []
            for i, width in enumerate(layout):
                value = np.zeros(len(fps), dtype=np.uint64)
                for g in range(at, at + width):
                    value = value << np.uint64(8) | values[:, g]
                at += width
                own = np.uint64(i) << np.uint64(33)
                keys.append(value | own)
                owners.append(np.arange(len(fps)))
                roles.append(np.where(t[:, i] >= 0, STANDS | ASKS, STANDS))
                for radius in range(1, tau + 1):
                    who = np.flatnonzero(t[:, i] == radius)
                    if len(who):
                        masks = _flips(8 * width, radius)
                        keys.append(((value[who][:, None] ^ masks[None, :]) | own).ravel())
                        owners.append(np.repeat(who, len(masks)))
                        roles.append(np.full(len(who) * len(masks), ASKS))
            owner, key, role = np.concatenate(owners), np.concatenate(keys).view(np.int64), np.concatenate(roles)
            for lo in range(0, len(owner), 1 << 16):
                part = owner[lo : lo + (1 << 16)]
                yield pa.record_batch({"key": pa.array(key[lo : lo + (1 << 16)]), "fp": pa.array(fps[part]), "node": pa.array(ids[part]), "role": pa.array(role[lo : lo + (1 << 16)], pa.int32())})

    probes = nodes.select("node", "fp").mapInArrow(probe, "key long, fp long, node long, role int")
    probes = common.written(probes, folder, "probes")
    large = probes.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("role") != STANDS).alias("asking")).where(F.col("count") > block)
    large = common.written(large.select("key", F.ceil(F.col("count") / block).alias("nb"), (F.col("asking") > 0).alias("asked")), folder, "large")
    dealt = (
        probes.join(large, "key", "left")
        .where(F.coalesce("asked", F.lit(True)))  # where none asks there are no candidates
        .withColumn("own", F.when(F.col("nb").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("nb"))).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("nb").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int")))))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "node", "role")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lambda batches: _forests(batches, tau), "a long, b long")


def _forests(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links within each (key, i, j), whose rows come one after another."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j", "own", "fp", "node", "role")], axis=1)
        last = (rows[:, :3] != rows[-1, :3]).any(1)
        cut = int(np.flatnonzero(last).max()) + 1 if last.any() else 0
        if cut == 0:
            if held and (held[-1][-1, :3] != rows[0, :3]).any():
                yield from _bucket_edges(np.concatenate(held), tau)
                held = []
            held.append(rows)
            continue
        yield from _bucket_edges(np.concatenate([*held, rows[:cut]]), tau)
        held = [rows[cut:]]
    if held:
        yield from _bucket_edges(np.concatenate(held), tau)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one of them asks where the other stands."""
    return ((a & ASKS > 0) & (b & STANDS > 0)) | ((b & ASKS > 0) & (a & STANDS > 0))


def _bucket_edges(rows: np.ndarray, tau: int) -> Iterator[pa.RecordBatch]:
    change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(rows)]])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    prints = np.ascontiguousarray(rows[:, 4]).view(np.uint64)  # bits of signed numbers are counted without their sign
    pairs = starts[ends - starts == 2]  # most buckets with a candidate have one
    if len(pairs):
        near = (np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= tau) & _meet(rows[pairs, 6], rows[pairs + 1, 6])
        out.append((rows[pairs[near], 5], rows[pairs[near] + 1, 5]))
    for lo, hi in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
        fps, ids = prints[lo:hi], rows[lo:hi, 5]
        near = (np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(np.uint8) <= tau) & _meet(rows[lo:hi, 6][:, None], rows[lo:hi, 6][None, :])
        near |= np.eye(len(fps), dtype=bool)
        if near.sum() == len(fps):
            continue
        label = np.arange(len(fps))
        while True:  # the least index that a node reaches
            new = np.where(near, label[None, :], len(fps)).min(1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        tied = np.flatnonzero(label != np.arange(len(fps)))
        out.append((ids[tied], ids[label[tied]]))
    if out:
        a, b = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
        keep = a != b
        if keep.any():
            yield pa.record_batch({"a": pa.array(np.maximum(a, b)[keep]), "b": pa.array(np.minimum(a, b)[keep])})


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the least node of each component, for every node that has an edge.

    Each round takes the least label among neighbours, then follows labels once (pointer jumping). Rounds are written
    tables; joins on a node with many neighbours are left to the skew join.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.written(both, folder, "edges")
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), folder, "labels-0")
    turn = 0
    while True:
        turn += 1
        least = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        drawn = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        drawn = common.written(drawn, folder, f"drawn-{turn}")
        jump = drawn.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = drawn.join(jump, "label", "left").select("node", "old", F.coalesce("far", "label").alias("label"))
        labels = common.written(moved, folder, f"labels-{turn}")
        if labels.where(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, tau: int = 3, block: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) of every row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the least doc_id that can be reached over links between
    fingerprints that differ in at most tau bits, itself included. n_same: rows with the same fingerprint. Null and
    empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id each give a row; rows with a
    null doc_id link like any other, but never name a component; where all its rows have a null doc_id, component_id is
    null. Columns besides doc_id and text are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.work_dir(spark, "simhash")
    fps = common.written(fingerprints(docs), folder, "fps")
    nodes = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same")), folder, "nodes")
    edges = links(nodes.select(F.col("fp").alias("node"), "fp"), folder, tau, block)
    labels = components(edges, folder).withColumnRenamed("node", "fp")
    tied = common.written(nodes.join(labels, "fp", "left").select("fp", "least", "n_same", "label"), folder, "tied")
    names = tied.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("least").alias("name"))
    # most fingerprints are linked to none; they have no label to meet at
    alone = tied.where(F.col("label").isNull()).select("fp", "n_same", F.col("least").alias("component_id"))
    found = tied.join(names, "label").select("fp", "n_same", F.col("name").alias("component_id")).union(alone)
    found = common.written(found, folder, "found")
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def shingles(raw: bytes) -> np.ndarray:
    """Sorted hashes of the different runs of WIDTH words; a shorter text is one run, one without words has none."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(WIDTH)), strict=False)) if len(words) >= WIDTH else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def prints(found: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints of a set of shingles: a bit is set if it is set in over half of the shingles' mixed hashes."""
    counts = np.zeros(64 * PRINTS, dtype=np.int64)
    for lo in range(0, len(found), _SHINGLES // 8):
        h = found[lo : lo + _SHINGLES // 8, None] + np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(found)).view(np.uint64)


def print_ids(carried: np.ndarray) -> np.ndarray:
    """A number for the carried fingerprints of each row. Where two have the same, their texts are candidates, no more."""
    out = carried[:, 0].copy()
    for k in range(1, carried.shape[1]):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + carried[:, k]
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sets = [shingles(text) for text in common.raw_texts(batch.column("text"))]
        whole = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
        found = np.array([prints(x) for x in sets], dtype=np.uint64)
        columns = {f"p{k}": pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(PRINTS)}
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "sig": batch.column("sig"), "whole": pa.array(whole), "id": pa.array(print_ids(found[:, :CARRIED])), **columns})


def candidates(nodes: DataFrame, folder: str, block: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all ids of nodes (id, p0, ...) that are candidates, by the generalised pigeonhole principle in
    each of their fingerprints: some fingerprint differs by at most WITHIN bits, or some partition within its threshold by luck,
    and the carried fingerprints by at most APART bits.

    Near copies first meet at their own values of the carried fingerprints alone. What that connects has a label, and texts of a
    label, already connected, meet no more and count as one where others are linked to them, so a group of copies isn't spanned
    again by each task that comes upon it. A text of even value asks at the values one bit away, which are odd, and one of odd
    value stands there and need not ask; texts with thresholds of their own ask everywhere. Where over `block` texts stand, they
    are dealt out as blocks, those of the most frequent label there apart from the rest, for which alone its own texts ask.
    """
    names = [f"p{k}" for k in range(PRINTS)]
    plans, n = _plans(nodes, names, WITHIN)
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (order, _, layout) in enumerate(plans):
                values = _ordered_bits(batch.column(names[k]).to_numpy(), order).astype(np.uint64)
                for i, value in enumerate(_partitions(values, layout)):
                    yield pa.record_batch({"bucket": pa.array((value | np.uint64(4 * k + i) << np.uint64(32)).view(np.int64)), "label": batch.column("label")})

    def probes(some: DataFrame, first: bool) -> DataFrame:
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(lo, PROBED) for b in batches for lo in range(0, b.num_rows, PROBED)):
                label, carried = batch.column("label").to_numpy(), [batch.column(c).to_numpy() for c in names[:CARRIED]]
                for k, (order, tables, layout) in enumerate(plans[:CARRIED] if first else plans):
                    values = _ordered_bits(batch.column(names[k]).to_numpy(), order).astype(np.uint64)
                    t, _ = allocate(values.astype(np.int64), layout, tables, n, WITHIN)
                    plain, owners, keys = (t == 1).all(1), [], []
                    for i, (width, value) in enumerate(zip(layout, _partitions(values, layout), strict=True)):
                        place = np.uint64(4 * k + i) << np.uint64(34)
                        owners.append(np.arange(len(value)))
                        keys.append(place | value << np.uint64(2) | np.where(t[:, i] >= 0, STANDS | ASKS, STANDS).astype(np.uint64))
                        asks = ~plain | (np.bitwise_count(value) % 2 == 0)
                        for radius in range(1, 1 if first else WITHIN + 1):
                            who = np.flatnonzero((t[:, i] == radius) & asks)
                            if len(who):
                                masks = _flips(8 * width, radius)
                                keys.append((place | (value[who][:, None] ^ masks[None, :]) << np.uint64(2) | np.uint64(ASKS)).ravel())
                                owners.append(np.repeat(who, len(masks)))
                    owner, key = np.concatenate(owners), np.concatenate(keys).view(np.int64)
                    for lo in range(0, len(owner), 1 << 16):
                        part = owner[lo : lo + (1 << 16)]
                        yield pa.record_batch({"key": pa.array(key[lo : lo + (1 << 16)]), "label": pa.array(label[part]), **{f"c{x}": pa.array(c[part]) for x, c in enumerate(carried)}})

        rows = some.select(*names, "label").mapInArrow(probe, "key long, label long, " + ", ".join(f"c{x} long" for x in range(CARRIED)))
        return rows.withColumn("j", F.lit(0))

    def spanned(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(parts, F.shiftright("key", 2), "j").sortWithinPartitions("j", "key")
        found = rows.mapInArrow(_near, "a long, b long")
        for lots in (max(parts // 16, 1), max(parts // 256, 1)):  # tasks that meet the same group each span it, so what several found is spanned once more
            found = found.repartition(lots).mapInArrow(_merged, "a long, b long")
        return found

    nodes = nodes.select("id", *names, F.lit(0).cast("long").alias("label"))
    standing = nodes.select(*names, "label").mapInArrow(stand, "bucket long, label long")
    large = common.written(standing.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), folder, "large")
    dealt, rows = not large.isEmpty(), probes(nodes, True)
    mixed = F.xxhash64("c0", "bucket")  # a text meets others in each bucket
    if dealt:
        rows = rows.withColumn("bucket", F.shiftright("key", 2)).join(large, "bucket", "left")
        rows = rows.withColumn("j", F.pmod(mixed, F.coalesce(F.ceil(F.col("n") / block), F.lit(1))).cast("int")).drop("bucket", "n")
    copies = components(common.written(spanned(rows), folder, "copied"), f"{folder}/copies")
    labels = copies.withColumnRenamed("node", "id")
    nodes = nodes.drop("label").join(labels, "id", "left").select(*names, F.coalesce("label", F.lit(0)).alias("label")).repartition(parts)
    rows = probes(nodes, False)
    if dealt:
        held = nodes.mapInArrow(stand, "bucket long, label long").where("label <> 0").join(large, "bucket").groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("held"))
        most = held.groupBy("bucket").agg(F.max(F.struct("held", "label")).alias("x")).select("bucket", "x.*").withColumnRenamed("label", "hot")
        n_hot = F.coalesce("held", F.lit(0))
        blocks = large.join(most, "bucket", "left").select("bucket", "hot", F.ceil(n_hot / block).cast("int").alias("ours"), F.ceil((F.col("n") - n_hot) / block).cast("int").alias("others"))
        rows = _dealt(rows, common.written(blocks, folder, "blocks"), mixed)
    return copies.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").union(spanned(rows))


def _dealt(rows: DataFrame, blocks: DataFrame, mixed) -> DataFrame:
    """Rows of candidates() with their blocks j. Of a bucket with blocks (bucket, hot, ours, others), texts of the label hot stand
    in the first `ours` and ask in the `others` alone; all others stand in those and ask in all."""
    rows = rows.drop("j").withColumn("bucket", F.shiftright("key", 2)).join(blocks, "bucket", "left").withColumn("ours", F.coalesce("ours", F.lit(0))).withColumn("others", F.coalesce("others", F.lit(1)))
    own = F.when(F.col("mine"), F.pmod(mixed, F.greatest("ours", F.lit(1)))).otherwise(F.col("ours") + F.pmod(mixed, F.greatest("others", F.lit(1)))).cast("int")
    rows = rows.withColumn("mine", F.coalesce(F.col("label") == F.col("hot"), F.lit(False))).withColumn("own", own)
    theirs = F.when(F.col("others") > 0, F.sequence(F.col("ours"), F.col("ours") + F.col("others") - 1)).otherwise(F.array().cast("array<int>"))
    asked = F.when(F.col("mine"), theirs).otherwise(F.sequence(F.lit(0), F.col("ours") + F.col("others") - 1))
    to = F.when(F.col("key").bitwiseAND(ASKS) == 0, F.array("own")).when(F.col("key").bitwiseAND(STANDS) == 0, asked).otherwise(F.array_union(F.array("own"), asked))
    rows = rows.withColumn("j", F.explode(to)).withColumn("key", F.when(F.col("j") == F.col("own"), F.col("key")).otherwise(F.col("key").bitwiseAND(~STANDS)))
    return rows.select("key", "label", *(f"c{x}" for x in range(CARRIED)), "j")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the candidates of (j, bucket), whose rows come one after another; in pieces where it is large."""
    empty = np.empty(0, dtype=np.int64)
    held: list[np.ndarray] = []
    a, b = empty, empty

    def more(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, y = _near_pairs(np.concatenate(rows))
        x, y = np.concatenate([a, x]), np.concatenate([b, y])
        return _tied(x, y) if len(x) >= FOREST // 2 else (x, y)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("j", "key", "label", *(f"c{x}" for x in range(CARRIED)))], axis=1)
        same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] >> 2 == rows[-1, 1] >> 2)
        cut = int(np.flatnonzero(~same).max()) + 1 if not same.all() else 0
        if cut == 0 and held and (held[-1][-1, 0] != rows[0, 0] or held[-1][-1, 1] >> 2 != rows[0, 1] >> 2):
            a, b = more(held)
            held = []
        if cut:
            a, b = more([*held, rows[:cut]])
            held = []
        held.append(rows[cut:])
        if len(a) > FOREST:
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})
            a, b = empty, empty
    if held:
        a, b = more(held)
    a, b = _tied(a, b)
    if len(a):
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of edges; in pieces where it is large."""
    a = b = np.empty(0, dtype=np.int64)
    for batch in batches:
        a, b = _tied(np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()]))
        if len(a) > FOREST:
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})
            a = b = np.empty(0, dtype=np.int64)
    if len(a):
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _near_pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the candidates among rows (j, key, label, carried fingerprints) of different labels; a row without one (0) has its
    id for it."""
    role, carried = rows[:, 1] & 3, np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
    ids, bucket = np.where(rows[:, 2] == 0, print_ids(carried), rows[:, 2]), rows[:, 1] >> 2
    starts = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (rows[1:, 0] != rows[:-1, 0])) + 1])
    ends = np.concatenate([starts[1:], [len(rows)]])
    rest = np.repeat(ends, ends - starts) - np.arange(len(rows))  # rows from here to the end of the bucket
    out = []

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        met = _meet(role[x], role[y]) & (ids[x] != ids[y])
        x, y = x[met], y[met]
        near = np.bitwise_count(carried[x] ^ carried[y]).sum(1, dtype=np.int64) <= APART
        out.append((ids[x[near]], ids[y[near]]))

    at, ahead = np.flatnonzero(np.repeat(ends - starts <= SMALL, ends - starts)), 1
    while len(at := at[rest[at] > ahead]):
        keep(at, at + ahead)
        ahead += 1
    for lo, hi in zip(starts[ends - starts > SMALL], ends[ends - starts > SMALL], strict=True):
        # all are held against one of the most frequent label; what that connects need not meet once more
        here = np.arange(lo, hi)
        listed, times = np.unique(ids[lo:hi], return_counts=True)
        most = here[ids[lo:hi] == listed[times.argmax()]]
        first = most[role[most].argmax()]
        keep(here, np.full(len(here), first))
        one = np.isin(ids[lo:hi], np.append(out[-1][0], ids[first]))
        stands, asks = role[lo:hi] & STANDS > 0, role[lo:hi] & ASKS > 0
        for ask, stand in ((here[asks & one], here[stands & ~one]), (here[asks & ~one], here[stands])):
            step = max((1 << 16) // max(len(stand), 1), 1)
            for lot in range(0, len(ask) if len(stand) else 0, step):
                some = ask[lot : lot + step]
                apart = sum(np.bitwise_count(carried[some, k][:, None] ^ carried[stand, k][None, :]).astype(np.int16) for k in range(CARRIED))
                x, y = np.nonzero(apart <= APART)
                out.append(_tied(ids[some[x]], ids[stand[y]]))  # a forest for each step, as all pairs of a bucket may be near
    return np.concatenate([x[0] for x in out] or [ids[:0]]), np.concatenate([x[1] for x in out] or [ids[:0]])


def _tied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges: each node with the least of its component, but for that itself."""
    a, b = a[a != b], b[a != b]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compared(pairs: DataFrame, sets: DataFrame, folder: str, name: str, least: float = SIMILAR) -> DataFrame:
    """(a, b, alike, both, n) of pairs (a, b) whose texts' sets of shingles have a Jaccard similarity of at least so much; both:
    shingles in both, n: in a."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(p, dtype=np.uint64) for p in batch.column(c).to_pylist()] for c in ("x", "y"))
            n, m = (np.array([len(p) for p in c], dtype=np.int64) for c in (x, y))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], dtype=np.int64)
            alike = both / np.maximum(n + m - both, 1)
            columns = {"a": batch.column("a"), "b": batch.column("b"), "alike": pa.array(alike), "both": pa.array(both), "n": pa.array(n)}
            yield pa.record_batch(columns).filter(pa.array(alike >= least))

    both = pairs.join(sets.select(F.col("whole").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("whole").alias("b"), F.col("found").alias("y")), "b")
    return common.written(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, alike double, both long, n long"), folder, name)


def _sets(texts: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """(whole, found): the shingles of the wanted texts (whole, doc_id, sig). A Bloom filter passes most others by where they are
    read, so no text is shuffled."""
    bloom = common.Bloom.of(wanted, "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(bloom.has(batch.column("sig").to_numpy().view(np.uint64))))
            if some.num_rows:
                found = [shingles(x).tobytes() for x in common.raw_texts(some.column("text"))]
                whole = np.array([xxhash.xxh64_intdigest(x) for x in found], dtype=np.uint64).view(np.int64)
                yield pa.record_batch({"doc_id": some.column("doc_id"), "sig": some.column("sig"), "whole": pa.array(whole), "found": pa.array(found, pa.binary())})

    some = texts.mapInArrow(run, "doc_id long, sig long, whole long, found binary")
    some = some.join(wanted.select("doc_id", "sig").distinct(), ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"])
    return common.written(some.select("whole", "found"), folder, "sets")


def _single(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, whole, single): how many shingles of a text no other text of its group has; where there are none, no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, whole, found in zip(*(batch.column(c).to_pylist() for c in ("key", "whole", "found")), strict=True):
                part = np.frombuffer(found, dtype=np.int64)
                for lo in range(0, len(part), _SHINGLES):
                    some = part[lo : lo + _SHINGLES]
                    yield pa.record_batch({"key": pa.array(np.full(len(some), key)), "whole": pa.array(np.full(len(some), whole)), "shingle": pa.array(some)})

    rows = shared.select("key", "whole").join(sets, "whole").select("key", "whole", "found").mapInArrow(run, "key long, whole long, shingle long")
    alone = rows.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("whole")).where("n = 1")
    return alone.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("single"))


def links_of_buckets(shared: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Edges (a, b) that connect all texts of a group whose sets are alike, from the groups (key, whole, weight).

    Each text of a group is first held against its heaviest one, of equal ones that with the most shingles in common with
    others. What that does not connect is held against each other, but for texts that can't be alike: Jaccard distances obey the
    triangle inequality, and two texts share at most what each shares with the heaviest one, and of what that lacks at most the
    shingles that not one text alone has.
    """
    size = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    single = common.written(_single(shared.join(size.where("size > 2"), "key"), sets), folder, "single")
    length = sets.select("whole", F.floor(F.octet_length("found") / 8).alias("n"))
    lonely = F.coalesce("single", F.lit(0))
    scored = shared.join(length, "whole").join(single, ["key", "whole"], "left").select("key", "whole", "weight", lonely.alias("single"), (F.col("n") - 2 * lonely).alias("score"))
    scored = common.written(scored, folder, "scored")
    centre = scored.groupBy("key").agg(F.max(F.struct("weight", "score", "whole"))["whole"].alias("b"))
    members = common.written(scored.select("key", F.col("whole").alias("a"), "single").join(centre, "key").where("a <> b"), folder, "members")
    stars = _compared(members.select("a", "b").distinct(), sets, folder, "stars", 0.0)
    edges = stars.where(F.col("alike") >= SIMILAR).select("a", "b")
    labels = components(edges, f"{folder}/stars-components").withColumnRenamed("node", "a")
    tied = members.join(stars, ["a", "b"]).join(labels, "a", "left").select("key", "a", "alike", "both", "n", (F.col("n") - F.col("single") - F.col("both")).alias("other"), F.coalesce("label", "a").alias("label"))
    open_ = tied.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    tied = common.written(tied.join(open_, "key"), folder, "tied")
    x = tied.select("key", "a", F.col("label").alias("la"), F.col("alike").alias("xa"), F.col("both").alias("xb"), F.col("other").alias("xo"), F.col("n").alias("xn"))
    y = tied.select("key", F.col("a").alias("b"), F.col("label").alias("lb"), F.col("alike").alias("ya"), F.col("both").alias("yb"), F.col("other").alias("yo"), F.col("n").alias("yn"))
    near = F.abs(F.col("xa") - F.col("ya")) <= 1 - SIMILAR + 1e-9
    most = F.least("xb", "yb") + F.least("xo", "yo")
    near = near & (most * (1 + SIMILAR) >= SIMILAR * (F.col("xn") + F.col("yn")) - 1e-6)
    pairs = common.written(x.join(y, (x["key"] == y["key"]) & (F.col("a") > F.col("b")) & (F.col("la") != F.col("lb")) & near).select("a", "b").distinct(), folder, "pairs")
    return common.written(edges.union(_compared(pairs, sets, folder, "rest").select("a", "b")), folder, "edges")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: of its rows with the least doc_id one.

    Texts are near duplicates where their sets of five-word shingles have a Jaccard similarity of at least 0.8; groups are
    what such links connect. Candidates are found by SimHash fingerprints of those sets and the generalised pigeonhole principle
    (`candidates`; 0.8 is about ten bits of 64, so a text has several fingerprints, and 0.998 of such pairs are found); what they
    connect is a group, in which all texts are verified exactly (`links_of_buckets`). All columns are kept, whatever their names.
    Rows that repeat a doc_id are rows like any other: unrelated ones all stay, and of equal ones any one does. Rows with a
    null doc_id can't be named as a copy of another and all stay.
    """
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.work_dir(spark, "keep-one")
    rows_ = docs.select(F.struct("*").alias("row"))  # no name of docs meets one of ours
    rows_ = rows_.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("sig"))
    named = rows_.where(F.col("doc_id").isNotNull())
    texts = named.select("doc_id", "sig", F.col("row.text").cast("string").alias("text"))
    words = [f"p{k}" for k in range(PRINTS)]
    rows = common.written(texts.mapInArrow(_sketch, "doc_id long, sig long, whole long, id long, " + ", ".join(f"{c} long" for c in words)), folder, "sketches")
    nodes = rows.groupBy("whole").agg(F.min(F.struct("doc_id", "sig")).alias("least"), F.min("id").alias("id"), *[F.min(c).alias(c) for c in words])
    nodes = common.written(nodes.select("whole", F.col("least.doc_id").alias("node"), F.col("least.sig").alias("sig"), "id", *words), folder, "nodes")
    found = common.written(candidates(nodes.dropDuplicates(["id"]), folder), folder, "candidates")
    groups = components(found, f"{folder}/candidate-groups").withColumnRenamed("node", "id")
    keyed = nodes.select("whole", "node", "sig", "id").join(groups, "id", "left").select("whole", "node", "sig", F.coalesce("label", "id").alias("key"))
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = common.written(keyed.join(size, "key").select("key", "whole", "node", "sig", F.lit(0).alias("weight")), folder, "shared")
    wanted = shared.select(F.col("node").alias("doc_id"), "sig")
    edges = links_of_buckets(shared.select("key", "whole", "weight"), _sets(texts, wanted, folder), folder)
    labels = components(edges, f"{folder}/components")
    groups = nodes.join(labels.withColumnRenamed("node", "whole"), "whole", "left").groupBy(F.coalesce("label", "whole").alias("label"))
    keep = groups.agg(F.min(F.struct("node", "sig")).alias("x")).select(F.col("x.node").alias("doc_id"), F.col("x.sig").alias("sig")).distinct()
    first = Window.partitionBy("doc_id", "sig").orderBy("doc_id")
    kept = named.join(keep, ["doc_id", "sig"], "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return kept.select("row").unionByName(rows_.where(F.col("doc_id").isNull()).select("row")).select("row.*")
