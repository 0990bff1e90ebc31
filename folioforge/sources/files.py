"""Directory sources and file-tree sinks.

Spark's file sources pass over names that start with ``_`` or ``.``, so trees are listed on the driver and read by tasks, a
row for each file. Folders must be mounted on all machines.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter as FM
from ..functions import text as T

# What is never scanned, and size classes.
PRUNED = (".git", "node_modules", "dist", "build", "target")
KEPT_HIDDEN = ".wiki"
LARGE_BYTES, MANAGED_BYTES, SNIFFED = 1 << 20, 200 << 20, 8192
STATE = ".corpus"


def pruned(path: F.Column) -> F.Column:
    """Whether a path lies in, or is, something that is never scanned."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(parts, lambda x: x.isin(*PRUNED)) | F.exists(folders, lambda x: x.startswith(".") & (x != KEPT_HIDDEN))


def listed(root: str, recursive: bool = True, skip: tuple[str, ...] = ()) -> Iterator[tuple[str, int]]:
    """(relative path, size) of plain files below root, links not followed, in the order of path components."""
    skip = tuple(os.path.realpath(x) for x in skip)

    def walk(folder: str, prefix: str) -> Iterator[tuple[str, int]]:
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.name in PRUNED or os.path.realpath(entry.path) in skip or entry.is_symlink():
                continue
            if entry.is_dir():
                if recursive and (not entry.name.startswith(".") or entry.name == KEPT_HIDDEN):
                    yield from walk(entry.path, f"{prefix}{entry.name}/")
            elif entry.is_file():
                yield prefix + entry.name, entry.stat().st_size

    yield from walk(root, "")


def is_text(head: bytes) -> bool:
    """No NUL, and UTF-8 but for a character that the end of the first bytes cuts."""
    if b"\0" in head:
        return False
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.reason == "unexpected end of data" and len(head) >= SNIFFED
    return True


def scan(spark: SparkSession, root: str, recursive: bool = True, skip: tuple[str, ...] = (), partitions: int = 64) -> DataFrame:
    """(path, size, content, kind, reason): kind is regular, large or skipped. A file as root is scanned alone."""
    if os.path.isfile(root):
        root, found = os.path.dirname(root) or ".", [(os.path.basename(root), os.path.getsize(root))]
    else:
        found = list(listed(root, recursive, skip))
    # so many files, or bytes, to a task
    tasks = max(partitions, -(-len(found) // 1000), -(-sum(n for _, n in found) // (64 << 20)))
    rows = spark.createDataFrame(found, "path string, size long").repartition(min(tasks, max(1, len(found))), "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size in zip(pdf["path"], pdf["size"], strict=True):
                with open(os.path.join(root, path), "rb") as f:
                    content = f.read(SNIFFED)
                    text = is_text(content)
                    if text and path.endswith(".md"):  # of others no more than the head is read
                        content += f.read()
                yield pd.DataFrame({"path": [path], "size": [size], "content": [content], "text": [text]})

    rows = rows.mapInPandas(read, "path string, size long, content binary, text boolean")
    reason = F.when(~F.col("path").rlike(r"[^/]\.md$"), "not markdown").when(~F.col("text") & F.expr("contains(content, X'00')"), "binary").when(~F.col("text"), "not UTF-8")
    reason = F.coalesce(reason, F.when(F.expr("contains(content, X'00')"), "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8"))
    kind = F.when(reason.isNotNull(), "skipped").when(F.col("size") > LARGE_BYTES, "large").otherwise("regular")
    note = F.coalesce(reason, F.when(F.col("size") > MANAGED_BYTES, "over 200 MiB"))
    return rows.select("path", "size", F.when(kind != "skipped", F.col("content")).alias("content"), kind.alias("kind"), note.alias("reason"))


def notes(files: DataFrame) -> DataFrame:
    """Notes of regular files in the shape of `corpus.notes`, with content, fm_line_end and fragment; wiki: false stays away."""
    rows = files.where("kind = 'regular'").select(F.col("path").alias("source_path"), F.col("content").cast("string").alias("content"))
    rows = rows.withColumn("fm", FM.front_matter("content")).where(~F.col("fm.wiki").eqNullSafe(F.lit(False)))
    path = F.col("source_path")
    return rows.select(
        "source_path", T.entry_path(path).alias("entry_path"), T.entry_dir(path).alias("entry_dir"), T.parent_of(path).alias("dir"), T.stem_of(path).alias("stem"),
        F.col("fm.title").alias("fm_title"), "fm.aliases", "fm.tags", "fm.related", "fm.body", "content", F.col("fm.line_end").alias("fm_line_end"), F.coalesce("fm.fragment", F.lit(True)).alias("fragment"),
    )


class OutputLock:
    """One writer at a time: a lock file that is made only if it isn't there, beside the output."""

    def __init__(self, out: str):
        name = hashlib.sha256(os.path.realpath(out).encode()).hexdigest()[:16]
        self.path = os.path.join(os.path.dirname(os.path.realpath(out)), f".{name}.lock")

    def __enter__(self) -> OutputLock:
        os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        return self

    def __exit__(self, *_: object) -> None:
        os.remove(self.path)


def _place(root: str, path: str, body: bytes) -> None:
    at = root
    for part in path.split("/")[:-1]:
        at = os.path.join(at, part)
        if os.path.islink(at) or (os.path.exists(at) and not os.path.isdir(at)):
            raise ValueError(f"{at} is no directory")
        os.makedirs(at, exist_ok=True)
    goal = os.path.join(at, path.split("/")[-1])
    if os.path.islink(goal):
        raise ValueError(f"{goal} is a link")
    with open(f"{goal}.part", "wb") as f:
        f.write(body)
    os.replace(f"{goal}.part", goal)


def write_tree(rows: DataFrame, root: str) -> int:
    """Writes (path, body) as files, by the tasks; paths with empty, '.' or '..' parts are refused. The number written."""
    from ..operators.incremental import invalid_paths

    if not invalid_paths(rows).isEmpty():
        raise ValueError("a path leaves the output folder")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, body in zip(pdf["path"], pdf["body"], strict=True):
                _place(root, path, bytes(body))
            yield pd.DataFrame({"n": [len(pdf)]})

    return int(rows.select("path", F.col("body").cast("binary").alias("body")).mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def read_manifest(root: str) -> dict | None:
    """What the last run was and where its tables of hashes are; None where there was none."""
    try:
        with open(f"{root}/{STATE}/manifest.json") as f:
            found = json.load(f)
    except FileNotFoundError:
        return None
    if found.get("version") != 2:
        raise ValueError("unknown manifest version")
    if not re.fullmatch(r"tables-\d+", found["tables"]):
        raise ValueError("the manifest names no table of its folder")
    return found


def hashes_of(spark: SparkSession, root: str, name: str, manifest: dict | None) -> DataFrame:
    """(path, hash) of the last run: `generated` or `sources`. Paths that would leave the output folder are refused."""
    from ..operators.incremental import invalid_paths

    if manifest is None:
        return spark.createDataFrame([], "path string, hash string")
    rows = spark.read.schema("path string, hash string").parquet(f"file://{os.path.realpath(root)}/{STATE}/{manifest['tables']}/{name}")
    if not invalid_paths(rows).isEmpty():
        raise ValueError("a path of the manifest leaves the output folder")
    return rows


def _delete(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path in pdf["path"]:
            goal = os.path.join(root, path)
            with contextlib.suppress(FileNotFoundError):
                os.remove(goal)
            folder = os.path.dirname(goal)
            while folder != root:  # folders that are left empty go, whichever task empties them
                try:
                    os.rmdir(folder)
                except OSError:
                    break
                folder = os.path.dirname(folder)
        yield pd.DataFrame({"n": [len(pdf)]})


def apply_incremental(desired: DataFrame, root: str, about: dict | None = None, sources: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """Brings a tree to the desired (path, body): new and changed files are written, stale ones go, others stay untouched.

    Files are written and removed by tasks; hashes are Parquet tables, so the driver holds counts alone. All checks come before
    the first change, and the manifest, which is written last, decides which tables count. about goes into the manifest, sources
    are (path, hash) of the input, and tables are kept beside the hashes.
    """
    from ..operators import incremental as I

    spark, root = desired.sparkSession, os.path.realpath(root)
    os.makedirs(f"{root}/{STATE}", exist_ok=True)
    with OutputLock(f"{root}/{STATE}"):
        had = read_manifest(root)
        new, old = I.hashes(desired), hashes_of(spark, root, "generated", had)
        existing = spark.createDataFrame([(p, n) for p, n in listed(root) if not p.startswith(f"{STATE}/")], "path string, size long")
        bad = I.collisions(new, existing, old).take(5)
        if bad:
            raise ValueError(f"in the way: {[r.path for r in bad]}")
        name = f"tables-{int(had['tables'].split('-')[1]) + 1 if had else 0}"
        place = f"file://{root}/{STATE}/{name}"
        # a file that someone has removed or changed in size is written again
        sizes = desired.select("path", F.octet_length(F.col("body").cast("binary")).cast("long").alias("size"))
        lost = sizes.join(existing, ["path", "size"], "left_anti").select("path", F.lit(True).alias("lost"))
        actions = I.diff(new, old).join(lost, "path", "left")
        actions = actions.select("path", F.when((F.col("action") == "noop") & F.col("lost"), "update").otherwise(F.col("action")).alias("action"))
        actions.write.mode("overwrite").parquet(f"{place}/actions")
        new.write.mode("overwrite").parquet(f"{place}/generated")
        (sources if sources is not None else new.where("false")).write.mode("overwrite").parquet(f"{place}/sources")
        for key, df in (tables or {}).items():
            df.write.mode("overwrite").parquet(f"{place}/{key}")
        actions = spark.read.schema("path string, action string").parquet(f"{place}/actions")
        gone = actions.where("action = 'delete'").select("path").mapInPandas(lambda batches: _delete(batches, root), "n long")
        gone.agg(F.sum("n")).collect()  # before others are written, as a folder may take a file's place
        write_tree(desired.join(actions.where("action in ('insert', 'update')"), "path", "left_semi"), root)
        counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        _place(root, f"{STATE}/manifest.json", json.dumps({"version": 2, "tables": name} | (about or {}), sort_keys=True).encode())
        if had:
            shutil.rmtree(f"{root}/{STATE}/{had['tables']}", ignore_errors=True)
        return counts


def load_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of the Markdown files of a generated tree."""
    files = scan(spark, root)
    return files.where(F.col("content").isNotNull() & ~F.col("path").startswith(f"{STATE}/")).select("path", F.col("content").cast("string").alias("body"))
