"""The three entry points: init, add and context."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compile as C
from ..operators import incremental, retrieval
from ..sources import files

__all__ = ["add", "context", "init"]


def _input(root: str) -> tuple[str, str]:
    """Kind (file or directory) and real path of an input."""
    if not os.path.exists(root):
        raise ValueError(f"{root} does not exist")
    real = os.path.realpath(root)
    if os.path.isfile(real) and not real.endswith(".md"):
        raise ValueError(f"{root} is no Markdown file")
    return "file" if os.path.isfile(real) else "directory", real


def _run(spark: SparkSession, kind: str, root: str, out: str, recursive: bool, schema_text: str | None) -> dict[str, int]:
    schema = retrieval.SchemaPack.load(schema_text) if schema_text is not None else None
    if os.path.exists(root):
        found = files.scan(spark, root, recursive, skip=(out,))
    else:  # a single file that has gone leaves an empty corpus
        found = spark.createDataFrame([], "path string, size long, content binary, kind string, reason string")
    title = os.path.splitext(os.path.basename(root))[0] or "Index"
    large = found.where("kind = 'large'")
    made = C.compile_corpus(files.notes(found), title, large.select("path", "content") if not large.isEmpty() else None, schema)
    about = {"input": {"kind": kind, "path": root, "recursive": recursive}, "schema": {"id": schema.id, "version": schema.version} if schema else None}
    sources = incremental.hashes(found.where("content is not null").select("path", F.col("content").alias("body")))
    return files.apply_incremental(made.pages, out, about, sources, {"catalog": made.catalog} if made.catalog is not None else {})


def init(spark: SparkSession, root: str, out: str, recursive: bool = True, schema_text: str | None = None) -> dict[str, int]:
    """Compiles a folder of notes, or one note, into the folder out, which must be new, empty, or made by an earlier run."""
    if os.path.isdir(out) and os.listdir(out) and files.read_manifest(out) is None:
        raise ValueError(f"{out} holds files of others")
    return _run(spark, *_input(root), out, recursive, schema_text)


def add(spark: SparkSession, out: str, path: str | None = None, schema_text: str | None = None) -> dict[str, int]:
    """Brings out up to date with the input that it was made from, as a fresh `init` would; only what differs is written. path,
    where given, must be of that input."""
    had = files.read_manifest(out)
    if had is None:
        raise ValueError(f"{out} has no manifest")
    kind, root, recursive = (had["input"][k] for k in ("kind", "path", "recursive"))
    if path is not None:
        if not os.path.exists(path):
            raise ValueError(f"{path} does not exist")
        real = os.path.realpath(path)
        if kind == "file" and real != root:
            raise ValueError(f"{out} was made from {root} alone")
        if os.path.commonpath([real, root]) != root:
            raise ValueError(f"{path} is not below {root}")
    if had["schema"] and schema_text is None:
        raise ValueError("this output was made with a schema, which is needed to keep its catalog")
    if os.path.exists(root):
        if _input(root)[0] != kind:
            raise ValueError(f"{root} is no {kind} any more")
    elif kind != "file":
        raise ValueError(f"{root} does not exist")
    return _run(spark, kind, root, out, recursive, schema_text)


def load_catalog(spark: SparkSession, out: str, schema: retrieval.SchemaPack) -> DataFrame:
    """The catalog that a run with this schema has left in out."""
    had = files.read_manifest(out)
    if had is None or not had["schema"]:
        raise ValueError(f"{out} has no catalog; init or add it with a schema")
    if had["schema"] != {"id": schema.id, "version": schema.version}:
        raise ValueError("the catalog is of another schema; init or add with this one")
    return spark.read.schema(C.CATALOG).parquet(f"file://{os.path.realpath(out)}/{files.STATE}/{had['tables']}/catalog")


def context(spark: SparkSession, out: str, schema_text: str, task: str, entities: list[str] | None = None, query: str | None = None, time: str | None = None, budget: int | None = None) -> str:
    """The evidence pack of a request over a compiled folder."""
    schema = retrieval.SchemaPack.load(schema_text)
    cat = load_catalog(spark, out, schema)
    edges = cat.select(F.col("generated_path").alias("src"), F.explode("outgoing").alias("dst"))
    proof = cat.select("generated_path", F.explode("fields").alias("field", "items")).select("field", "generated_path", F.explode("items").alias("x"))
    proof = proof.select("field", "generated_path", "x.source_path", "x.line_start", "x.line_end", "x.text")
    return retrieval.context_pack(cat, edges, proof, schema, task, entities, query, time, budget)
