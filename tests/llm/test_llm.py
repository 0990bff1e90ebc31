"""Every operator against brute force on a small table with nulls, empty and long texts, repeated rows, copies and clashes."""

from __future__ import annotations

import collections
import dataclasses
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import binary, bpe, classlm, common, decontaminate, lengths, quality, secrets, simhash, substrings, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, key long, node long, word string, c long"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def make_rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéfghiß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(70)
    texts = {i: say(rng.randint(1, 120)) for i in range(60)}
    texts |= {60: None, 61: "", 62: "  \n\t ", 63: "one", 64: "two words", 65: texts[3], 66: texts[3] + " x", 67: texts[4].upper()}
    texts |= {68: f"{say(20)} {passage} {say(20)}", 69: f"{passage} {say(5)}", 70: f"{say(30)}\n{passage}", 71: passage, 72: "w " * 400}
    long_ = say(200)
    texts |= {73: long_, 74: long_.replace(" ", "  ", 3) + " y", 75: long_ + " z", 76: say(40_000)}
    texts |= {77: f"{say(30)} {ITEM} {say(30)}", 78: f"{say(10)} {ITEM.replace('gamma', 'qq').replace(' mu', '')} {say(10)}", 79: f"{say(5)} alpha beta gamma {say(5)}"}
    texts |= {80: f'x password: "hunter22" token=ab secret = k9KEYvalue é {"0a" * 15} AKIA{"Z9" * 9} gh', 81: "token:token:abcdefgh api-key=zzzzzz APIKEY='longvalue' " + "f" * 23, 82: "é token = 'é' password=aaaaaa"}
    texts |= {83: "<|endoftext|> The <|ENDOFTEXT|> A.B, c's Don't!? ...x é ﬁ  z 12.5% Σ", 84: "\x1c\x85a b\xa0c", 85: "same line\nsame line\nsame line # $ %"}
    rows = [(i, t) for i, t in texts.items()]
    rows += [(3, texts[3]), (5, "another version of five"), (None, texts[9]), (None, None)]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 1, 2, "w", 3) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows):
    return collections.Counter(map(tuple, rows))


def print_of(text):
    w = words(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def nearest(prints, tau=3):
    v = np.array(prints, dtype=np.uint64)
    near, label = np.bitwise_count(v[:, None] ^ v[None, :]) <= tau, np.arange(len(v))
    while True:
        new = np.where(near, label[None, :], len(v)).min(1)
        if (new == label).all():
            return label
        label = new


def test_simhash(docs, none):
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [print_of(t) for _, t in order]
    label = nearest(prints)
    want = [(i, f"{p:016x}", order[k][0]) for (i, _), p, k in zip(order, prints, label, strict=True)]
    got = simhash.near_duplicates(docs, block=4).select("doc_id", "fingerprint", "component_id").collect()
    assert counted(got) == counted(want)
    assert simhash.near_duplicates(none).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Of three fingerprints only the middle one, which has no doc_id, is near both others."""
    prints = {"a": 0b11111, "b": 0b111, "c": 0, "d": 1 << 40 | 0b1010101}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.withColumn("fp", F.when(docs.text == "a", prints["a"]).when(docs.text == "b", prints["b"]).when(docs.text == "c", prints["c"]).otherwise(prints["d"])).select("doc_id", "fp"))
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, f"{31:016x}"): 1, (None, f"{7:016x}"): 1, (2, f"{0:016x}"): 1, (None, f"{prints['d']:016x}"): None}


def test_thresholds_differ_where_bits_are_skewed():
    """A partition that has the same value in nearly all rows is not probed by these, and others are probed the farther."""
    rng = np.random.default_rng(4)
    groups = rng.integers(0, 256, size=(4000, 8))
    groups[:, :2] = np.where(rng.random((4000, 1)) < 0.99, 7, groups[:, :2])
    tables = simhash.distance_tables(np.stack([np.bincount(groups[:, g], minlength=256) for g in range(8)]), 3)
    t, _ = simhash.allocate(groups, simhash.LAYOUTS[0], tables, 1e8, 3)
    common_ = (groups[:, :2] == 7).all(1)
    assert (t[common_, 0] == -1).all() and (t[common_].max(1) >= 1).all() and (t[~common_, 0] >= 0).mean() > 0.9
    nodes = [(i, int(v)) for i, v in enumerate(np.unique(np.packbits(np.unpackbits(groups.astype(np.uint8), axis=1), axis=1).view(">u8").ravel().astype(np.uint64)).view(np.int64))]
    assert nodes and ((t + 1).sum(1) == 4).all()


@pytest.mark.parametrize("layout", simhash.LAYOUTS)
def test_thresholds_cover(layout):
    rng = np.random.default_rng(3)
    groups = rng.integers(0, 256, size=(500, 8))
    t, _ = simhash.allocate(groups, layout, simhash.distance_tables(np.stack([np.bincount(groups[:, g], minlength=256) for g in range(8)]), 3), 500, 3)
    assert ((t + 1).sum(1) == 4).all() and t.min() >= -1  # any difference of 3 bits is within some threshold


def test_links_of_planted_prints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(1200)]
    prints = sorted({int(base[i % 40] ^ f) for i, f in enumerate(flips)})
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    folder = common.work_dir(spark, "test")
    got = {r.node: r.label for r in simhash.components(simhash.links(nodes, folder, block=16), folder).collect()}
    label = nearest(prints)
    assert [got.get(i, i) for i in range(len(prints))] == label.tolist()


def test_one_of_near_copies_stays(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, copies = [], set()
    for k in range(60):
        base = say(rng.randint(80, 600))
        rows.append((k, " ".join(base)))
        for j, share in enumerate((0.01, 0.02, 0.05)):
            w = [x if rng.random() > share else "new" + x for x in base]
            a, b = grams(base), grams(w)
            i, alike = 1000 * (j + 1) + k, len(a & b) / len(a | b)
            rows.append((i, " ".join(w)))
            if alike >= 0.8:
                copies.add(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert len(copies) > 60 and not copies & ids and set(range(60)) <= ids


def test_links_of_buckets(spark):
    """A chain of sets in one bucket, in which only neighbours are alike, is one group; what is like none stays alone."""
    folder = common.work_dir(spark, "buckets")
    found = [np.arange(10 * k, 10 * k + 200, dtype=np.uint64) for k in range(23)] + [np.arange(10_000 * k, 10_000 * k + 50, dtype=np.uint64) for k in range(1, 6)]
    sets = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(found)], "whole long, found binary")
    shared = spark.createDataFrame([(7, k, 1 + (k == 11)) for k in range(len(found))], "key long, whole long, weight long")
    labels = {r.node: r.label for r in simhash.components(simhash.links_of_buckets(shared, sets, folder), f"{folder}/c").collect()}
    assert labels == dict.fromkeys(range(23), 0)


def test_candidates_of_prints(spark, monkeypatch):
    """Fingerprints within the bits that the partitions cover are connected, those far apart are not; hot buckets are dealt out."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, size=(12, simhash.PRINTS), dtype=np.uint64)
    flip = lambda n: np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    found = np.array([[x ^ flip(simhash.WITHIN) for x in base[k % 12]] for k in range(240)], dtype=np.uint64)
    found = np.concatenate([base, found])
    ids = simhash.print_ids(found[:, : simhash.CARRIED]).tolist()
    rows = [(i, *x) for i, x in zip(ids, found.view(np.int64).tolist(), strict=True)]
    nodes = spark.createDataFrame(rows, "id long, " + ", ".join(f"p{k} long" for k in range(simhash.PRINTS))).repartition(3)
    for small, block in ((64, 4096), (2, 4)):
        monkeypatch.setattr(simhash, "SMALL", small)
        folder = common.work_dir(spark, "test")
        got = {r.node: r.label for r in simhash.components(simhash.candidates(nodes, folder, block), folder).collect()}
        assert [got[i] for i in ids] == [min(ids[k::12]) for k in range(12)] * 21


def test_a_group_of_near_copies_is_spanned_once(spark, monkeypatch):
    """Tasks that come upon a group of near copies don't each list it, and a large bucket of it isn't dealt out to itself."""
    rng, dealt = np.random.default_rng(12), []
    flip = lambda x: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 5, replace=False)))
    base = rng.integers(0, 1 << 63, size=simhash.PRINTS, dtype=np.uint64)
    found = np.array([[flip(x) for x in base] for _ in range(400)] + [list(x) for x in rng.integers(0, 1 << 63, size=(200, simhash.PRINTS), dtype=np.uint64)], dtype=np.uint64)
    ids = simhash.print_ids(found[:, : simhash.CARRIED]).tolist()
    nodes = spark.createDataFrame([(i, *x) for i, x in zip(ids, found.view(np.int64).tolist(), strict=True)], "id long, " + ", ".join(f"p{k} long" for k in range(simhash.PRINTS)))
    monkeypatch.setattr(simhash, "_dealt", lambda *args, f=simhash._dealt: dealt.append((args[0], f(*args))) or dealt[-1][1])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    try:
        for block in (4096, 20):
            folder = common.work_dir(spark, "test")
            edges = common.written(simhash.candidates(nodes, folder, block), folder, "found")
            assert {r.node: r.label for r in simhash.components(edges, folder).collect()} == dict.fromkeys(ids[:400], min(ids[:400]))
            assert edges.count() < 500
        rows, out = (x.count() for x in dealt[0])
        assert out < 1.2 * rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_prints_follow_similarity():
    """A bit differs as often as the angle of two sets says, 0.151 at a similarity of 0.8."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, size=900, dtype=np.uint64)) for _ in range(20)]
    apart = [np.bitwise_count(simhash.prints(x[:800]) ^ simhash.prints(x[100:])).sum() for x in sets]
    assert abs(np.mean(apart) / (64 * simhash.PRINTS) - np.arccos(700 / 800) / np.pi) < 0.02


def test_few_pairs_of_a_large_group(spark):
    """Copies that differ from the heaviest text in shingles of their own are ruled out by what they can share at most."""
    folder, rng = common.work_dir(spark, "ruled"), np.random.default_rng(6)
    text = rng.integers(0, 1 << 62, size=200, dtype=np.uint64)
    copies = [np.sort(np.concatenate([text[rng.permutation(200)[k:]], rng.integers(0, 1 << 62, size=k, dtype=np.uint64)])) for k in rng.integers(25, 120, size=60)]
    found = [np.sort(text), *copies, np.sort(np.concatenate([copies[5][:190], text[:3]]))]
    found = [np.unique(x) for x in found]
    sets = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(found)], "whole long, found binary")
    shared = spark.createDataFrame([(7, k, int(k == 0)) for k in range(len(found))], "key long, whole long, weight long")
    links = {frozenset(r) for r in simhash.links_of_buckets(shared, sets, folder).collect()}
    assert links == {frozenset((i, j)) for i in range(len(found)) for j in range(i) if simhash.jaccard(found[i], found[j]) >= 0.8}
    assert len(links) and spark.read.parquet(f"{folder}/pairs").count() < 100


def test_no_unrelated_row_goes(spark):
    """Rows that share a doc_id are not copies of each other; names that operators use inside are columns like any other."""
    say = lambda seed: " ".join(f"w{random.Random(seed * 1000 + k).randrange(9999)}" for k in range(60))
    clash = ("_nth", "_sha", "_spans", "sig", "row", "nth", "spans", "sha", "whole", "keys", "node", "label", "text_")
    rows = [(5, say(1)), (5, say(2)), (6, say(1)), (5, say(1)), (None, say(1)), (7, "token=abcdef " + say(3)), (8, None), (9, None)]
    docs = spark.createDataFrame([(i, t, *[k] * len(clash)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in clash))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert counted((r.doc_id, r.text) for r in got.collect()) == counted([(5, say(1)), (5, say(2)), (None, say(1)), rows[5], (8, None)])
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns
    assert {(r.text, r["_sha"], r.spans) for r in masked.where("doc_id = 7").collect()} == {("[SECRET] " + say(3), 5, 5)}


def spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 6)
    for rank, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secrets(docs, none):
    line = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
    want = []
    for i, t in ROWS:
        s = spans(t or "")
        want.append((i, *[sum(x[2] == k for x in s) for k in secrets.BASE_KINDS], hashlib.sha256(line(s).encode()).hexdigest(), line(s)))
    assert counted(secrets.find_secrets(docs).drop("blob").collect()) == counted(want)
    assert secrets.find_secrets(none).count() == 0


def test_ledger_scans_what_is_new(spark):
    ledger = secrets.Ledger(spark, common.work_dir(spark, "ledger"))
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "clean")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "token=abcdef"), (3, "token=abcdef"), (4, "secret=zzzzzzz")], "doc_id long, text string")
    secrets.find_secrets(first, ledger).collect()
    got = {r.doc_id: r.spans for r in secrets.find_secrets(second, ledger).collect()}
    assert got == {1: "assign:0:12", 3: "assign:0:12", 4: "assign:0:14"}
    seen = spark.read.parquet(f"{ledger.folder}/seen/run-1")
    assert seen.select("sha").distinct().count() == 1  # one blob was new
    again = secrets.Ledger(spark, ledger.folder)  # as another session would open it
    assert again.seen().count() == 3 * len(secrets.RULES)
    secrets.find_secrets(second, again).collect()
    assert spark.read.parquet(f"{ledger.folder}/seen/run-2").isEmpty() and again.seen().count() == 3 * len(secrets.RULES)
    newer = (*secrets.RULES[:-1], dataclasses.replace(secrets.RULES[-1], version=2))
    paths = second.select(F.struct("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
    again.scan(paths, newer)
    assert {(r.kind, r.version) for r in spark.read.parquet(f"{ledger.folder}/seen/run-3").collect()} == {("pem", 2)}


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é token=abcdef, then"), (2, None), (3, "password=" + "0a" * 13), (None, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert got == {1: "é [SECRET], then", 2: None, 3: "[SECRET]", None: "clean"}


def test_substrings(docs, none):
    first = {}
    for i, t in ROWS:
        if i is not None:
            w = words(t)
            for k in range(len(w) - 49):
                x = tuple(w[k : k + 50])
                first[x] = min(first.get(x, i), i)
    want = []
    for i, t in ROWS:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert sum(x[2] for x in want) > 200
    assert counted(substrings.remove_repeats(docs).collect()) == counted(want)
    assert substrings.remove_repeats(none).count() == 0


def test_index_runs_are_compacted(spark):
    index = substrings.FingerprintIndex(spark, common.work_dir(spark, "index"))
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, prints array<long>")
    assert index.ingest(batch((1, [1, 2]), (2, [2, 3]))).collect()[0].print == 2
    assert {r.print for r in index.ingest(batch((3, [1, 9]))).collect()} == {1}
    index.close()
    again = substrings.FingerprintIndex(spark, index.folder)  # as another session would open it
    assert len(again.runs) == 2
    assert {r.print for r in again.ingest(batch((4, [9, 3, 7]))).collect()} == {9, 3}
    assert len(again.runs) == 2  # the first two are one
    assert {(r.print, r.first_doc) for r in again.run(again.runs[0]).collect()} == {(1, 1), (2, 1), (3, 2), (9, 3)}
    plan = again.run(again.runs[0]).hint("merge").join(again.run(again.runs[1]), "print")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def items(spark):
    return spark.createDataFrame([(1, ITEM, 0), (2, "", 0), (3, None, 0), (4, "two words", 0)], "item_id long, text string, doc_id int")


def test_leaks(spark, docs, none):
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word, r.end_word) for r in decontaminate.find_leaks(docs, items(spark)).collect()}
    assert set(got) == {(77, 1), (78, 1), (64, 4)} and got[77, 1] == (0, 30, 50) and got[78, 1][0] == 2
    assert decontaminate.find_leaks(none, items(spark)).count() == 0
    assert decontaminate.find_leaks(docs, items(spark).where("false")).count() == 0
    left = {r.doc_id for r in decontaminate.drop_leaks(docs, items(spark)).collect()}
    assert left == {i for i, _ in ROWS} - {64, 77, 78}


def test_leak_recall():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [vocabulary[i] for i in rng.integers(400, size=n)]
    listed = [(k, " ".join(say(int(rng.integers(15, 50)))).encode()) for k in range(20)]
    searched = decontaminate.Items(listed)
    texts = []
    for _, raw in listed * 10:
        w = raw.decode().split()
        for _ in range(int(0.2 * len(w))):
            at, kind = int(rng.integers(len(w))), rng.integers(3)
            w[at : at + 1] = [] if kind == 0 else [vocabulary[rng.integers(400)]] if kind == 1 else [w[at], vocabulary[rng.integers(400)]]
        texts.append(" ".join(say(40) + w + say(40)).encode())
    found = {(x[0], x[1]) for x in decontaminate._search(searched, list(range(len(texts))), texts, {})}
    assert np.mean([(i, i % 20) in found for i in range(len(texts))]) >= 0.9


@pytest.mark.parametrize("n", [100, 200, 400, 800])
def test_leak_recall_of_long_items(n):
    rng = np.random.default_rng(n)
    vocabulary = [f"w{i}" for i in range(4000)]
    say = lambda n: [vocabulary[i] for i in rng.integers(4000, size=n)]
    listed = [(k, " ".join(say(n)).encode()) for k in range(5)]
    searched, texts = decontaminate.Items(listed), []
    for _, raw in listed * 6:
        w = raw.decode().split()
        for _ in range(int(0.2 * n)):
            at, kind = int(rng.integers(len(w))), rng.integers(3)
            w[at : at + 1] = [] if kind == 0 else [vocabulary[rng.integers(4000)]] if kind == 1 else [w[at], vocabulary[rng.integers(4000)]]
        texts.append(" ".join(say(40) + w + say(40)).encode())
    found = {(x[0], x[1]) for x in decontaminate._search(searched, list(range(len(texts))), texts, {})}
    assert np.mean([(i, i % 5) in found for i in range(len(texts))]) >= 0.99


def test_leaks_by_brute_force():
    """Every window of every document against every item: nothing is found but what is near, and near to nothing is missed."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(120)]
    say = lambda n: [vocabulary[i] for i in rng.integers(120, size=n)]
    listed = [say(int(n)) for n in [1, 2, 4, 5, 7, 8, 9, 10, 14, *rng.integers(11, 90, size=12)]]
    listed[13] = listed[12] + ["tail"]
    texts = []
    for i in range(150):
        w = list(listed[i % len(listed)])
        for _ in range(int(rng.integers(0, int(0.3 * len(w)) + 2))):
            at, kind = int(rng.integers(len(w))), rng.integers(3)
            w[at : at + 1] = [] if kind == 0 and len(w) > 1 else say(1) if kind == 1 else [w[at], *say(1)]
        texts.append(say(int(rng.integers(0, 12))) + w + ["--"] + say(int(rng.integers(0, 12))))
    searched = decontaminate.Items([(k, " ".join(w).encode()) for k, w in enumerate(listed)])
    got = {(x[0], x[1]): x[2] for x in decontaminate._search(searched, list(range(len(texts))), ["  ".join(w).encode() for w in texts], {})}
    number = {w: i for i, w in enumerate(sorted({x for w in [*texts, *listed] for x in w} - {"--"}))}
    want = {}
    for d, text in enumerate(texts):
        row = np.array([number[x] for x in text if x != "--"], dtype=np.int64)
        for k, item in enumerate(listed):
            distance = decontaminate.edit_ends(np.array([number[x] for x in item]), row)[0]
            if distance <= decontaminate.allowed(len(item)):
                want[d, k] = distance
    assert len(want) > 100 and set(got) <= set(want)
    assert np.mean([got.get(x) == n for x, n in want.items()]) >= 0.99


@pytest.mark.parametrize("seed", range(3))
def test_edit_ends(seed):
    rng = np.random.default_rng(seed)
    item, text = rng.integers(1, 4, 8), rng.integers(1, 4, 14)

    def _next(row, x, b, i):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return new

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, x, b, i)
        return row[-1]

    best = min(distance(item, text[a:b]) for a in range(15) for b in range(a, 15))
    d, a, b = decontaminate.edit_ends(item, text)
    assert d == best == distance(item, text[a:b])


@pytest.fixture(scope="module")
def encoded():
    t = tokens.load(tokens.default_path())
    return t, t.encode_batch([x or "" for _, x in ROWS], add_special_tokens=False)


def test_bpe(docs, none, encoded):
    t, rows = encoded
    want = []
    for (i, _), e in zip(ROWS, rows, strict=True):
        ids = np.array(e.ids, dtype="<u4").tobytes()
        want.append((i, len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    assert counted(bpe.digests(docs).collect()) == counted(want)
    assert bpe.digests(none).count() == 0


def test_token_files(docs, none, encoded):
    order = sorted(((i, np.array([*e.ids, 1], dtype="<u4")) for (i, _), e in zip(ROWS, encoded[1], strict=True)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes()))
    want, start = [], 0
    for i, ids in order:
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert counted(binary.round_trip(docs).collect()) == counted(want)
    assert binary.round_trip(none).count() == 0


def test_token_counts(docs, none, encoded):
    n = np.array([len(e.ids) for e in encoded[1]])
    for r in lengths.token_counts(docs).collect():
        k = r.context_limit
        assert (r.n_docs, r.n_longer, r.tokens_kept, r.tokens_total) == ((n == k).sum(), (n > k).sum(), np.minimum(n, k).sum(), n.sum())
    assert lengths.token_counts(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(60)], "doc_id long, quality int")
    want = []
    for i, t in ROWS:
        w, t = words(t), t or ""
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        times, marked = collections.Counter(grams), set()
        for k, g in enumerate(grams):
            if times[g] > 1:
                marked |= {k, k + 1, k + 2}
        want.append((i, len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)))
    got = quality.judge(docs, labels)
    assert counted(got.drop("kept", "anomaly").collect()) == counted(want)
    assert got.where("kept and base_failed").count() == 0
    assert quality.judge(none, labels).count() == 0 and quality.judge(docs, labels.where("false")).count() == len(ROWS)


def test_path_lengths():
    """Against a walk of each row down each tree, with the good rows of each leaf counted anew."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    x[:, 2] = 0  # good rows differ in two features, others in three
    low, high = np.full(3, -5.0), np.full(3, 5.0)
    forest = quality.grow(x, low, high)
    rows = np.concatenate([x[:5], rng.uniform(-5, 5, size=(20, 3))])
    want = []
    for row in rows:
        total = 0.0
        for feature, split, left in zip(forest.feature, forest.split, forest.left, strict=True):
            at, steps, inside = 0, 0, np.ones(len(x), dtype=bool)
            while feature[at] >= 0:
                right = row[feature[at]] >= split[at]
                inside &= (x[:, feature[at]] >= split[at]) == right
                at, steps = left[at] + right, steps + 1
            total += steps + quality._search_path(inside.sum())
        want.append(2 ** (-total / quality.TREES / quality._search_path(len(x))))
    assert np.allclose(forest.anomaly(rows), want)
    odd = np.array([[0, 0, 4.0], [4, 4, 0]])
    assert forest.anomaly(odd).min() > forest.anomaly(x).max()


def test_quality_of_held_out_rows(spark):
    """Symbols between words, which no good row has, are told by path length alone; labels of a third of rows are not given."""
    rng = random.Random(5)
    say = lambda n: [f"{rng.choice('abcdef')}{'x' * rng.randint(0, 8)}{rng.randrange(99)}" for _ in range(n)]
    rows = []
    for i in range(900):
        w = say(rng.randint(60, 200))
        rows.append((i, " ".join(w if i % 6 else [x + rng.choice(["###", "$$", " |"]) for x in w])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(900) if i % 3], "doc_id long, quality int")
    labels = labels.union(spark.createDataFrame([(i, 0) for i in range(0, 900, 6) if i % 4], "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect() if not r.base_failed}
    held = [i for i in kept if i % 3 == 0 and (i % 6 or not i % 4)]
    assert np.mean([kept[i] for i in held if i % 6]) >= 0.95 and np.mean([kept[i] for i in held if not i % 6]) <= 0.1


def test_toxicity(spark, none):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = [(i, say(30) + (" vilezza " + rng.choice(["grumpf", "snarkle"]) if i % 5 == 0 else "")) for i in range(600)]
    rows += [(600, None), (601, ""), (None, "vilezzo"), (5, "second row of five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("false")).collect()} <= {0, 1}


def test_class_model(docs, none):
    known = collections.Counter()
    for i, t in ROWS:
        w = [*words(low(t)), "\n"]
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            known.update(w)
    n, v = sum(known.values()), len(known)
    want = {}
    for i, t in ROWS:
        w = [*words(low(t)), "\n"]
        want[i, t] = (len(w), sum(known[x] > 0 for x in w), sum(math.log10((known[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    got = classlm.score(docs).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 and r.train_tokens == n for r in got)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == collections.Counter((i, a, b, round(c, 6)) for (i, t) in ROWS for a, b, c in [want[i, t]])
    assert classlm.score(none).count() == 0


def test_exchange_finds_classes():
    rng = np.random.default_rng(4)
    sides = np.arange(20) % 2
    pairs = np.where(sides[:, None] != sides[None, :], rng.integers(20, 40, (20, 20)), 0).astype(float)
    own = classlm.exchange(pairs, 2)
    assert len(set(own[sides == 0])) == 1 and len(set(own[sides == 1])) == 1 and own[0] != own[1]


def test_every_word_is_clustered(spark):
    """Words of two kinds take turns; half of the head starts in the class of its kind, and letters tell nothing."""
    rng = random.Random(6)
    kinds = [[bytes(rng.choices(b"abcdefgh", k=6)) for _ in range(60)] for _ in range(2)]
    texts = [b" ".join(rng.choice(kinds[k % 2]) for k in range(40)).decode() for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words_ = [classlm.END, *kinds[0][:40], *kinds[1][:40]]
    coded = classlm.encode(docs.withColumn("train", F.lit(True)), {w: i for i, w in enumerate(words_)})
    coded = common.written(coded.withColumn("chunk", F.monotonically_increasing_id()), common.work_dir(spark, "coded"), "coded")
    any_ = lambda kind: rng.randrange(15) * 2 + kind + 1
    own = np.array([0] + [any_(k // 40 if k % 2 else rng.randrange(2)) for k in range(80)])
    own, table = classlm.exchange_head(coded, own, 0)
    tails = {r.chunk: classlm._unpressed(r.tail) for r in coded.collect()}
    replies = [(tails[r.chunk], bpe.unpack(r.places), r.classes) for r in classlm.exchange_tail(coded, own, table).where("kind = 0").collect()]
    found = {words[k]: c for words, at, classes in replies for k, c in zip(at.tolist(), classes, strict=True)} | dict(zip(words_[1:], own[1:].tolist(), strict=True))
    assert set(found) == {*kinds[0], *kinds[1]}
    sides = np.stack([np.bincount([found[w] for w in kind], minlength=classlm.CLASSES) for kind in kinds])
    assert sides.max(0).sum() >= 0.95 * sides.sum()


def test_score_with_a_short_head(docs, monkeypatch):
    """Counts don't depend on which words are in the head."""
    exact = lambda rows: collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    want = exact(classlm.score(docs).collect())
    monkeypatch.setattr(classlm, "HEAD", 50)
    monkeypatch.setattr(classlm, "CLUSTERED", 20)
    got = classlm.score(docs).collect()
    assert exact(got) == want and all(r.score < 0 for r in got)


def test_gains_are_likelihoods():
    rng = np.random.default_rng(8)
    text = np.concatenate([[0], rng.integers(1, 30, 4000), [0]])
    own = np.append(0, rng.integers(1, classlm.CLASSES, 29))
    table = lambda own: np.bincount(own[text[:-1]] * (classlm.CLASSES + 1) + own[text[1:]], minlength=(classlm.CLASSES + 1) ** 2).reshape(classlm.CLASSES + 1, -1).astype(float)
    w = 7
    side = lambda at: np.bincount(np.where(text[at] == w, classlm._SELF, own[text[at]]), minlength=classlm._CELLS)[None, :].astype(float)
    at = np.flatnonzero(text == w)
    gain = classlm.gains(side(at - 1), side(at + 1), own[[w]], table(own))[0]
    want = []
    for c in range(1, classlm.CLASSES):
        own[w] = c
        want.append(classlm.likelihood(table(own)))
    assert np.allclose(np.diff(gain[1 : classlm.CLASSES]), np.diff(want))


def test_model_is_a_distribution():
    """Over all classes and words, seen or unknown, the model's probabilities add up to one."""
    words_ = [(b"aa", 5), (b"ab", 4), (b"ba", 3), (b"bb", 2)]
    index = {w: i + 1 for i, (w, _) in enumerate(words_)} | {classlm.END: 5}
    classes = classlm.learn_classes(words_, np.ones((6, 6)), index)
    c = np.array([n for _, n in words_] + [6])
    of = classes.of([w for w, _ in words_] + [classlm.END])
    size, types = np.bincount(of, weights=c, minlength=classes.n), np.bincount(of, minlength=classes.n)
    for k in set(of):
        inside = ((c + 0.5) / (size[k] + 0.5 * (types[k] + 1)))[of == k].sum() + 0.5 / (size[k] + 0.5 * (types[k] + 1))
        assert inside == pytest.approx(1)


def test_pipeline(spark, docs, tmp_path):
    sf = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 79)) for i in range(86)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    items(spark).where("item_id = 1").select("item_id", "text").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert sorted(ids) == sorted([*set(ids), 5])  # another text of 5 is no copy of it
    assert not {77, 78, 65} & set(ids) and {3, 80, 76} <= set(ids)
    assert sum(r.doc_id is None for r in got) == 2
    row = next(r for r in got if r.doc_id == 80)
    t = tokens.load(tokens.default_path())
    assert bytes(row.decoded).decode() == t.decode(np.frombuffer(row.ids, dtype="<u4").tolist(), skip_special_tokens=False)
    assert b"hunter22" not in row.decoded
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "bpe"]
