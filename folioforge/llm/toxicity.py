"""Toxicity by weak supervision.

Terms (words and word beginnings) that labelled rows tie to toxicity are mined from training rows and dealt out to
voters: lexicons of whole words and patterns of word beginnings, several of each. A voter votes if a text holds one of
its terms, or enough different ones. The label model is generative: each class has its own dependency tree over the
voters, so a voter's accuracy and its correlation with the voter above it are both estimated, by expectation
maximisation over the counts of all vote patterns in all documents, with known labels held fixed. A logistic regression
over the terms is then trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds of terms: whole words (0) and word beginnings of so many letters.
KINDS = (0, 3, 4, 5, 6, 7)
#: Voters of each kind; with the two counting voters there are 14, so at most 2**14 vote patterns.
FOLDS = 2
#: Bounds of the fit: terms that are kept, labelled training rows from which they are mined (the first by hash of
#: doc_id), and training rows on which the linear classifier is fitted (likewise).
MAX_TERMS, MAX_MINE_ROWS, MAX_FIT_ROWS = 600, 100_000, 20_000
#: A term needs so many toxic training rows; its gain (half of G2) must pass the log of the number of such terms plus MARGIN,
#: so that chance gives few.
LEAST_ROWS, MARGIN = 4, -2.0
#: predicted is 1 from this score on.
THRESHOLD = 0.3
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words, and terms with counts, that a task holds at a time.
_CACHE, _HELD = 150_000, 100_000


def word_terms(raw: bytes) -> list[str]:
    """The terms of one whitespace-delimited word: its runs of letters, lower-cased, whole and by their beginnings."""
    out = []
    for run in _LETTERS.findall(raw.decode("utf-8", "replace").lower()):
        out.append("0" + run)
        out.extend(f"{k}{run[:k]}" for k in KINDS[1:] if len(run) >= k)
    return out


def mine(docs: DataFrame, known: DataFrame) -> list[tuple[str, float, float]]:
    """(term, toxic rows, other rows) of the terms that best tell toxic rows, by G2.

    docs (doc_id, text), known (doc_id, toxic). At most MAX_MINE_ROWS labels are used; they go to the texts as a broadcast
    of that bounded size, so no text is moved.
    """
    spark = docs.sparkSession
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_MINE_ROWS).toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(sample["doc_id"].to_pylist(), sample["toxic"].to_pylist(), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[str]] = {}
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            terms = list(held)
            cells = np.array([held[t] for t in terms], dtype=np.int64).reshape(-1, 2)
            return pa.record_batch({"term": pa.array(terms, pa.string()), "pos": pa.array(cells[:, 1]), "neg": pa.array(cells[:, 0])})

        for ids, texts in common.text_rows(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                label = shared.value.get(doc_id)
                if label is None:
                    continue
                terms: set[str] = {""}  # counts rows
                for word in set(text.split()):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = word_terms(word)
                    terms.update(found)
                for term in terms:
                    held.setdefault(term, [0, 0])[label] += 1
            if len(known) > _HELD // 2:
                known.clear()
            if len(held) > _HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    counts = docs.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = common.written(counts, common.work_dir(spark, "terms"), "counts")
    total = counts.where("term = ''").first()
    least = math.log(max(1, counts.where(F.col("pos") >= LEAST_ROWS).count())) + MARGIN
    if total is None or not total.pos or not total.neg:
        return []
    pos, neg = float(total.pos), float(total.neg)
    rate = pos / (pos + neg)
    seen = F.col("pos") + F.col("neg")
    gain = F.when(F.col("pos") > 0, F.col("pos") * F.log(F.col("pos") / (seen * rate))).otherwise(0) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (seen * (1 - rate)))).otherwise(0)
    best = counts.where((F.col("term") != "") & (F.col("pos") >= LEAST_ROWS) & (F.col("pos") / seen > 2 * rate)).withColumn("gain", gain).where(F.col("gain") >= least)
    return [(r.term, float(r.pos), float(r.neg)) for r in best.orderBy(F.desc("gain"), "term").limit(MAX_TERMS).collect()]


@dataclass
class Model:
    """Terms, their voters, the label model and the linear classifier."""

    terms: dict[str, int]
    voter: np.ndarray  # of each term
    weights: np.ndarray | None = None  # of each term, then the bias
    base_rate: float = 0.5
    tree: list[int] = field(default_factory=list)
    tables: np.ndarray | None = None  # [class, voter, vote of the voter above, vote]

    def n_voters(self) -> int:
        return len(KINDS) * FOLDS + 2

    def votes(self, hits: list[int]) -> int:
        """The vote pattern of a text with these terms, as a bit mask."""
        out = 0
        if not hits:
            return out
        for v in self.voter[hits]:
            out |= 1 << int(v)
        words = sum(1 for v in self.voter[hits] if v < FOLDS)
        n = self.n_voters()
        return out | (1 << (n - 2)) * (words >= 2) | (1 << (n - 1)) * (len(hits) >= 3)


def _hits(model: Model, texts: list[bytes], known: dict[bytes, tuple[int, ...]]) -> Iterator[list[int]]:
    terms = model.terms
    for text in texts:
        found: set[int] = set()
        for word in set(text.split()):
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(i for t in word_terms(word) if (i := terms.get(t)) is not None)
            if own:
                found.update(own)
        if len(known) > _CACHE:
            known.clear()
        yield sorted(found)


def marks(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, hits, pattern) of every row: the indexes of the terms it holds, and its vote pattern."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for ids, texts in common.text_rows(batches):
            hits = list(_hits(shared.value, texts, known))
            votes = [shared.value.votes(h) for h in hits]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "pattern": pa.array(votes, pa.int64())})

    return docs.mapInArrow(run, "doc_id long, hits array<int>, pattern long")


def patterns(marked: DataFrame, known: DataFrame, model: Model) -> np.ndarray:
    """[vote pattern, label + 1] -> rows, over all rows; an unknown or held-out label is -1."""
    label = F.coalesce("toxic", F.lit(-1)).cast("long")
    named = F.col("doc_id").isNotNull()  # rows without an id have no label and would all meet in one task
    cells = marked.where(named).select("doc_id", "pattern").join(known, "doc_id", "left").select((3 * F.col("pattern") + label + 1).alias("at"))
    cells = cells.union(marked.where(~named).select(3 * F.col("pattern")))
    return common.dense(cells.groupBy("at").agg(F.count(F.lit(1)).cast("double").alias("n")), 3 << model.n_voters()).reshape(-1, 3)


def fit_label_model(model: Model, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Fits tree and tables of the model and returns the posterior of each vote pattern."""
    n = model.n_voters()
    bits = (np.arange(len(counts))[:, None] >> np.arange(n)) & 1
    weight = counts.sum(1)
    known = counts[:, 1:].sum(1)
    # start from the share of toxic rows among the labelled ones with as many votes
    votes = bits.sum(1)
    share = np.array([(counts[votes == k, 2].sum() + 0.1) / (known[votes == k].sum() + 1) for k in range(n + 1)])
    post = share[votes]
    for turn in range(rounds):
        soft = np.stack([counts[:, 0] * (1 - post) + counts[:, 1], counts[:, 0] * post + counts[:, 2]])
        if turn % 5 == 0:
            model.tree = _tree(bits, soft)
        prior = (soft.sum(1) + 1) / (soft.sum() + 2)
        tables = np.zeros((2, n, 2, 2))
        for c in range(2):
            for v, above in enumerate(model.tree):
                over = bits[:, above] if above >= 0 else np.zeros(len(bits), dtype=int)
                cell = np.bincount(2 * over + bits[:, v], weights=soft[c], minlength=4).reshape(2, 2) + 0.5
                tables[c, v] = cell / cell.sum(1, keepdims=True)
        model.tables = tables
        logs = np.log(prior)[:, None] + np.zeros((2, len(bits)))
        for c in range(2):
            for v, above in enumerate(model.tree):
                over = bits[:, above] if above >= 0 else 0
                logs[c] += np.log(tables[c, v, over, bits[:, v]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        moved, post = float((np.abs(new - post) * weight).sum() / max(weight.sum(), 1)), new
        if moved < 1e-6:
            break
    model.base_rate = float(prior[1])
    return post


def _tree(bits: np.ndarray, soft: np.ndarray) -> list[int]:
    """The voter above each voter (-1: none): a maximum spanning tree of class-conditional mutual information."""
    n = bits.shape[1]
    gain = np.zeros((n, n))
    for a in range(n):
        for b in range(a):
            for c in range(2):
                p = np.bincount(2 * bits[:, a] + bits[:, b], weights=soft[c], minlength=4).reshape(2, 2) + 1e-9
                p /= soft.sum() + 4e-9
                gain[a, b] += (p * np.log(p * p.sum() / np.outer(p.sum(1), p.sum(0)))).sum()
            gain[b, a] = gain[a, b]
    above, best, parent = [-1] * n, gain[0].copy(), np.zeros(n, dtype=int)
    inside = {0}
    while len(inside) < n:
        v = max((x for x in range(n) if x not in inside), key=lambda x: best[x])
        above[v] = int(parent[v])
        inside.add(v)
        closer = gain[v] > best
        best, parent = np.where(closer, gain[v], best), np.where(closer, v, parent)
    return above


def fit_classifier(marked: DataFrame, known: DataFrame, model: Model, post: np.ndarray) -> None:
    """Logistic regression over the terms, on the posterior labels of at most MAX_FIT_ROWS training rows."""
    sample = marked.join(known, "doc_id").select("doc_id", "hits", "pattern").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT_ROWS)
    # equal rows are counted: few are left
    table = sample.groupBy("hits", "pattern").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
    n = len(model.terms)
    x = np.zeros((len(table["n"]), n + 1))
    for i, hits in enumerate(table["hits"]):
        x[i, hits] = 1
    x[:, n] = 1
    w = np.array(table["n"], dtype=float)
    y = w * post[np.array(table["pattern"], dtype=np.int64)]
    beta, penalty = np.zeros(n + 1), np.full(n + 1, 0.05)
    penalty[n] = 1e-6
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - w * p) - penalty * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    model.weights = beta


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the marks of all docs (doc_id, text), from labels (doc_id, toxic) of training rows alone.

    A doc_id that has labels of both kinds counts as toxic. Without toxic and other training rows the model has no terms
    and gives every text the same score.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = common.work_dir(spark, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = common.written(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")), folder, "known")
    terms = {t: i for i, (t, _, _) in enumerate(mine(docs, known))}
    nth: dict[str, int] = {}
    voter = []
    for t in terms:  # the terms of a kind go round its voters in the order of their strength
        k = nth[t[0]] = nth.get(t[0], -1) + 1
        voter.append(KINDS.index(int(t[0])) * FOLDS + k % FOLDS)
    model = Model(terms, np.array(voter, dtype=np.int64))
    marked = common.written(marks(docs, model), folder, "marks")
    counts = patterns(marked, known, model)
    if terms:
        fit_classifier(marked, known, model, fit_label_model(model, counts))
    else:
        model.weights = np.array([np.log((counts[:, 2].sum() + 0.5) / (counts[:, 1].sum() + 0.5))])
    return model, marked


def held_out(doc_id):
    return common.mod_of_id(doc_id, 4) == 2


def score(marked: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of marks. Null and empty texts get the score of no terms."""
    shared = marked.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_logit(shared.value, h) for h in batch.column("hits").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, dtype=float), -30, 30))))})

    return marked.select("doc_id", "hits").mapInArrow(run, "doc_id long, score double")


def _logit(weights: np.ndarray, hits: list[int]) -> float:
    return float(weights[-1] + weights[hits].sum()) if hits else float(weights[-1])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Null texts are empty; rows that repeat a doc_id each give a row; a null doc_id counts as held out or not by the empty
    text. Further columns are ignored; an empty table gives an empty table.
    """
    model, marked = fit(docs, labels)
    out = score(marked, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below THRESHOLD, with all their columns."""
    spark = docs.sparkSession
    model, _ = fit(docs, labels)
    shared = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        limit = np.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            hits = _hits(shared.value, common.raw_texts(batch.column("text")), known)
            yield batch.filter(pa.array([_logit(shared.value.weights, h) < limit for h in hits], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
