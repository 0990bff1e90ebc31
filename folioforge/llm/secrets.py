"""Secret scans over a content-addressed blob ledger, in DataFrame functions only.

Every version of a path is a blob, named by the SHA-256 of its text. The ledger is a set of Parquet tables in one
folder: which (blob, rule, rule version) pairs have been scanned, and the findings in each. A scan reads the texts of
unseen pairs alone, once a blob, and joins the findings of all its blobs back to every path that holds them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

# The kinds of the base contract and two more, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of AKIA[A-Z0-9]+ those with 20 or more: a run is matched from its first AKIA on
HEX = r"[0-9a-f]{24,}"  # of [0-9a-f]+ those with 24 or more: matches are whole runs
FORGE = r"gh[opsur]_[A-Za-z0-9]{36,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match of pattern counts if its `group` has `least` or more code points; others are consumed."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", 1, ASSIGN, 2, 6),
    Rule("access", 1, ACCESS, 0, 1),
    Rule("hex", 1, HEX, 0, 1),
    Rule("forge", 1, FORGE, 0, 1),
    Rule("pem", 1, PEM, 0, 1),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<SPAN> of one rule in a text: leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches come from split(), the matches from regexp_extract_all(); both walk the same matches
    from the left, so running lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), whole, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    rows = F.zip_with(rows, judged, lambda row, part: F.struct(row["gap"].alias("gap"), row["hit"].alias("hit"), part.alias("part")))
    empty = F.from_json(F.lit('{"at":0,"out":[]}'), f"struct<at:bigint,out:array<{SPAN}>>")

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        out = F.when(F.length(row["part"]) >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.cast("long").alias("at"), out.alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(rows, empty, step, lambda s: s["out"]))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(sha, kind, version, spans) of each row of blobs (sha, text, todo) for each rule whose kind is in todo and that has a
    span there; other rules are not tried."""
    listed = [r.kind for r in RULES]
    columns = [F.when(F.array_contains("todo", r.kind), spans_of(F.col("text"), r, listed.index(r.kind) if r.kind in listed else len(listed) + i)).alias(r.kind) for i, r in enumerate(rules)]
    found = blobs.select("sha", *columns)
    versions = {r.kind: r.version for r in rules}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version"), F.col(k).alias("spans")) for k, v in versions.items()]))
    return found.select("sha", each.alias("x")).select("sha", "x.kind", "x.version", "x.spans").where(F.size("spans") > 0)


class Ledger:
    """The blob ledger in one folder of Parquet tables. Runs are appended and never rewritten; a run counts from its commit on,
    so a ledger that is opened again knows what has been scanned, and a scan that was broken off is as if it had not been."""

    SEEN, FOUND = "sha string, kind string, version int", f"sha string, kind string, version int, spans array<{SPAN}>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder, common.Log(spark, folder)

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.log.names:
            return self.spark.range(0).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in StructType.fromDDL(schema)])
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/{run}" for run in self.log.names])

    def seen(self) -> DataFrame:
        return self._table("seen", self.SEEN)

    def findings(self) -> DataFrame:
        return self._table("found", self.FOUND)

    def scan(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """paths (path, sha) with texts in paths.text: scans unseen pairs and returns (path, sha).

        Of the paths that hold an unseen blob the least one lends its text, so that only ids and hashes are grouped and a
        text is moved at most once.
        """
        run = f"run-{self.log.version}"
        named = common.written(paths.select("path", "sha"), self.folder, f"paths-{run}")
        blobs = named.groupBy("sha").agg(F.min("path").alias("path"))
        wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        if self.log.names:
            pairs = blobs.select("sha", "path", F.explode(wanted).alias("x")).select("sha", "path", "x.kind", "x.version")
            pairs = pairs.join(self.seen(), ["sha", "kind", "version"], "left_anti")
            todo = pairs.groupBy("sha", "path").agg(F.collect_set(F.struct("kind", "version")).alias("todo"))
        else:
            todo = blobs.withColumn("todo", wanted)
        todo = common.written(todo, self.folder, f"todo-{run}")
        texts = paths.select("path", "text").join(todo.select("path", "sha", F.col("todo.kind").alias("todo")), "path")
        scan_blobs(texts.select("sha", "text", "todo"), rules).write.mode("overwrite").parquet(f"{self.folder}/found/{run}")
        todo.select("sha", F.explode("todo").alias("x")).select("sha", "x.kind", "x.version").write.mode("overwrite").parquet(f"{self.folder}/seen/{run}")
        self.log.commit([*self.log.names, run])
        return named

    def of_paths(self, named: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, sha, spans): the findings of the given rules in each path's blob, by start, then kind as listed."""
        mine = self.findings().where(F.struct("kind", "version").isin(*[F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules]))
        each = mine.groupBy("sha").agg(_merged().alias("spans"))
        each = common.written(each, self.folder, f"joined-{self.log.version}-{uuid.uuid4().hex[:8]}")
        none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
        return named.join(each, "sha", "left").select("path", "sha", F.coalesce("spans", none).alias("spans"))


def _merged() -> Column:
    """The spans of a blob in order; a path that is listed twice has its blob scanned twice, hence distinct."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans"))))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find_secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob) of every row of docs (doc_id, text).

    A null text is empty. Rows that repeat a doc_id are versions of one path and each give a row, each by its own blob;
    a null doc_id is a path like any other. Other columns are ignored; an empty table gives an empty table. Counts and
    base_sha256 are of the base kinds, spans are of all kinds.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, common.work_dir(spark, "ledger"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    # the path names row and blob together, so versions of one doc_id stay apart
    paths = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha")).alias("path"), sha.alias("sha"), text.alias("text"))
    found = ledger.of_paths(ledger.scan(paths))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [_count(kind) for kind in BASE_KINDS]
    return found.select(F.col("path.doc_id").alias("doc_id"), *counts, F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"), F.col("sha").alias("blob"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with each found span replaced by mask (spans that touch or overlap become one mask).

    All rows and columns stay; null texts stay null. Texts are matched to findings by content, so repeated and null ids
    don't matter.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, common.work_dir(spark, "ledger"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    paths = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha")).alias("path"), sha.alias("sha"), text.alias("text"))
    ledger.scan(paths)
    each = ledger.findings().groupBy("sha").agg(_merged().alias("spans"))
    each = common.written(each, ledger.folder, "spans")
    rows = docs.select(F.struct("*").alias("row"))  # no name of docs meets one of ours
    rows = rows.select("row", F.col("row.text").cast("string").alias("text"), F.sha2(F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary"), 256).alias("sha"))
    start = F.from_json(F.lit('{"at":0,"out":[]}'), "struct<at:bigint,out:array<string>>")

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] > state["at"], F.array(F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mask)))
        more = F.when((state["at"] == 0) & (F.size(state["out"]) == 0), F.coalesce(gap, F.array(F.lit(mask)))).otherwise(F.coalesce(gap, F.array().cast("array<string>")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], more).alias("out"))

    def end(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.length("text")))

    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, end)).otherwise(F.col("text"))
    out = rows.join(each, "sha", "left").withColumn("row", F.col("row").withField("text", clean))
    return out.select("row").select("row.*")
