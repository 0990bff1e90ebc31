"""Large documents: line records, section trees, size-bounded leaves and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import kept
from . import indexes, markdown, render

LIMIT = 30_000


def line_kind(line) -> F.Column:
    t = F.regexp_replace(line, r"(?U)^\s+", "")
    return (
        F.when(t == "", "blank")
        .when(t.startswith("```") | t.startswith("~~~"), "fence")
        .when(t.rlike(r"^#{1,6}\s"), "heading")
        .when(t.rlike(r"^\|.*\|"), "table")
        .when(t.rlike(r"^([-*+] |[0-9]+\. )"), "list")
        .otherwise("plain")
    )


def line_records(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, line_no, byte_start, byte_end, n_chars, kind) from (doc_id, body); line_no from 1, a line has its break. With
    "text" to keep also the line with its break."""
    rows = docs.select("doc_id", F.posexplode(F.split("body", "\n")).alias("i", "line"), F.size(F.split("body", "\n")).alias("n"))
    text = F.when(F.col("i") < F.col("n") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    rows = rows.select("doc_id", "i", "line", text.alias("text"), F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("n_chars")).where("bytes > 0")
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("bytes").over(w)
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), (end - F.col("bytes")).alias("byte_start"), end.alias("byte_end"), "n_chars", line_kind(F.col("line")).alias("kind"), *keep)


def _placed(records: DataFrame, limit: int, *carry: str) -> DataFrame:
    """Line records with island and page_no: lines packed greedily up to the limit; a line beyond it stands alone."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    over = F.when(F.col("n_chars") > limit, 1).otherwise(0)
    # an over-long line ends the island before it and starts another after it
    rows = records.withColumn("island", F.sum(over + F.coalesce(F.lag(over).over(w), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return indexes.packed(rows, ["doc_id", "island"], ["line_no"], "n_chars", limit, carry=["byte_start", "byte_end", "n_chars", *carry])


def chunks(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, chunk_no, line_start, line_end, byte_start, byte_end, n_chars): lines packed greedily up to the limit; a line
    beyond it is a chunk of its own (see byte_windows)."""
    rows = _placed(records, limit)
    out = rows.groupBy("doc_id", "island", "page_no").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.sum("n_chars").alias("n_chars"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_start")).cast("long")
    return out.select("doc_id", nth.alias("chunk_no"), "line_start", "line_end", "byte_start", "byte_end", "n_chars")


def _windows(text, limit: int):
    """The text cut every `limit` characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{limit}}})"), F.lit(1))


def byte_windows(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, line_no, window_no, char_start, n_chars, text): lines beyond the limit, cut every `limit` characters."""
    rows = docs.select("doc_id", F.posexplode(F.split("body", "\n")).alias("i", "line")).where(F.length("line") > limit)
    rows = rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.posexplode(_windows(F.col("line"), limit)).alias("k", "text"))
    return rows.select("doc_id", "line_no", (F.col("k") + 1).cast("long").alias("window_no"), (F.col("k") * limit).cast("long").alias("char_start"), F.length("text").cast("long").alias("n_chars"), "text")


def leaves(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, no, n, split_reason, line_start, line_end, byte_start, byte_end, text): all leaves of large documents in order;
    their texts one after another are the document."""
    records = line_records(docs, "text")
    rows = _placed(records.where(F.col("n_chars") <= limit).unionByName(records.where(F.col("n_chars") > limit).withColumn("text", F.lit(""))), limit, "text")
    out = rows.where(F.col("n_chars") <= limit).groupBy("doc_id", "island", "page_no").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    whole = out.join(split_reason(records, limit), "doc_id").select("doc_id", F.col("reason").alias("split_reason"), "line_start", "line_end", "byte_start", "byte_end", "text")
    cut = records.where(F.col("n_chars") > limit).select("doc_id", "line_no", "byte_start", F.posexplode(_windows(F.col("text"), limit)).alias("k", "text"))
    end = F.col("byte_start") + F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("doc_id", "line_no").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("end", end).select("doc_id", F.lit("byte_window").alias("split_reason"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), (F.col("end") - F.octet_length("text")).alias("byte_start"), F.col("end").alias("byte_end"), "text")
    by_doc = Window.partitionBy("doc_id")
    all_ = whole.unionByName(cut)
    return all_.withColumn("no", F.row_number().over(by_doc.orderBy("byte_start")).cast("long")).withColumn("n", F.count(F.lit(1)).over(by_doc))


def pages(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Entry and leaf pages of large files (path, content): path, body, kind, title, source, split_reason, byte_ranges, line_ranges,
    parent, prev, next, headings. Files whose names give the same folder get folders of their own."""
    named = files.select("path", T.slug_or(T.stem_of(F.col("path")), "note").alias("base"), F.substring_index("path", "/", -1).alias("name"))
    named = kept(markdown.unused_names(named, [], "path", "base", "folder"), "large-names")
    rows = leaves(files.select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("body")), limit).join(named, F.col("doc_id") == F.col("path")).drop("path")
    rows = kept(rows, "leaves")
    place, file = F.concat(F.lit("fragments/"), "folder"), lambda k: F.concat(F.lit("part-"), T.page_number(k), F.lit(".md"))
    page = F.concat(place, F.lit("/"), file(F.col("no")))
    prev, next_ = F.when(F.col("no") > 1, file(F.col("no") - 1)), F.when(F.col("no") < F.col("n"), file(F.col("no") + 1))
    way = lambda word, c: F.when(c.isNotNull(), F.concat(F.lit(f" · {word}: [{word}]("), c, F.lit(")"))).otherwise("")
    text = F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    pair = lambda a, b: F.array(F.struct(F.col(a).cast("long").alias("first"), F.col(b).cast("long").alias("last")))
    heads = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s*#{1,6} (.*)$"), F.lit(1)), lambda x: T.trim(F.regexp_replace(T.trim(x), "#+$", "")))
    leaf = rows.select(
        page.alias("path"), F.concat(F.lit("> Parent: [Parent](index.md)"), way("Prev", prev), way("Next", next_), F.lit("\n---\n\n"), text).alias("body"), F.lit("leaf").alias("kind"), F.concat(F.lit("Part "), F.col("no").cast("string")).alias("title"),
        F.col("doc_id").alias("source"), "split_reason", pair("byte_start", "byte_end").alias("byte_ranges"), pair("line_start", "line_end").alias("line_ranges"), F.lit("index.md").alias("parent"), prev.alias("prev"), next_.alias("next"), heads.alias("headings"),
    )
    n = rows.groupBy("doc_id").agg(F.max("n").alias("n"))
    entry = named.join(n, F.col("doc_id") == F.col("path"), "left").withColumn("at", F.concat(F.lit("fragments/"), "folder", F.lit("/index.md")))
    tops = F.array(F.concat(F.lit("# "), "name"), F.lit(""), F.concat(F.lit("- Leaf pages: `"), F.coalesce("n", F.lit(0)).cast("string"), F.lit("`")), F.lit(""), F.lit("## Fragments"), F.lit(""))
    none = F.array().cast("array<string>")
    lines = render._lines(entry.select("at", F.posexplode(tops).alias("i", "line")), F.col("at"), none, F.col("i"), F.col("line"))
    item = F.concat(F.lit("- ["), "folder", F.lit(":part-"), T.page_number(F.col("no")), F.lit("]("), file(F.col("no")), F.lit(")"))
    lines = lines.unionByName(render._lines(rows, F.concat(place, F.lit("/index.md")), F.array(F.lit("1")), F.col("no"), item))
    found = render.documents(lines).join(entry.select(F.concat(F.lit("fragments/"), "folder").alias("dir"), "name", F.col("path").alias("source")), T.parent_of(F.col("path")) == F.col("dir"))
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")
    null = F.lit(None).cast("string")
    first = found.select("path", "body", F.lit("entry").alias("kind"), F.col("name").alias("title"), "source", F.lit("heading").alias("split_reason"), empty.alias("byte_ranges"), empty.alias("line_ranges"), null.alias("parent"), null.alias("prev"), null.alias("next"), F.array("name").alias("headings"))
    return leaf.unionByName(first)


def split_reason(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, reason): a vote over a document's lines, in this order of precedence."""
    is_kind = lambda k: F.bool_or(F.col("kind") == k)
    n_headings = F.count_if(F.col("kind") == "heading")
    reason = (
        F.when(F.bool_or(F.col("n_chars") > limit), "byte_window")
        .when(is_kind("fence"), "code_fence")
        .when(is_kind("table"), "table")
        .when(n_headings > 1, "heading")
        .when(n_headings == 0, "paragraph")
        .otherwise("line_window")
    )
    return records.groupBy("doc_id").agg(reason.alias("reason"))


def page_plan(found: DataFrame) -> DataFrame:
    """(doc_id, page, prev, next, chunk_no, n_chars): leaf pages of chunks with their neighbours."""
    name = F.concat(F.lit("part-"), F.lpad(F.col("chunk_no").cast("string"), 3, "0"), F.lit(".md"))
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    rows = found.withColumn("page", F.when(F.col("chunk_no") < 1000, name).otherwise(F.concat(F.lit("part-"), F.col("chunk_no").cast("string"), F.lit(".md"))))
    return rows.select("doc_id", "page", F.lag("page").over(w).alias("prev"), F.lead("page").over(w).alias("next"), "chunk_no", "n_chars")


def range_coverage(records: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, contiguous): whether line ranges follow each other from 0 without gap or overlap."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = records.withColumn("ok", F.coalesce(F.lag("byte_end").over(w), F.lit(0)) == F.col("byte_start"))
    return rows.groupBy("doc_id").agg(F.max("byte_end").alias("n_bytes"), F.bool_and("ok").alias("contiguous"))


def section_tree(extents: DataFrame) -> DataFrame:
    """(source_path, line_idx, level, id, parent_id, end_idx): ids by level and count, parents the last heading of a smaller
    level, found by one running maximum for each level."""
    w = Window.partitionBy("source_path").orderBy("line_idx")
    nth = F.row_number().over(Window.partitionBy("source_path", "level").orderBy("line_idx")).cast("string")
    rows = extents.withColumn("id", F.concat(F.lit("h"), F.col("level").cast("string"), F.lit("-"), nth, F.lit("-"), T.slug_or(F.col("text"), "section")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lasts = F.array(*[F.max(F.when(F.col("level") == k, F.struct("line_idx", "id"))).over(before) for k in range(1, 7)])
    rows = rows.withColumn("lasts", lasts)
    above = F.array_max(F.filter(F.slice("lasts", F.lit(1), (F.col("level") - 1).cast("int")), lambda x: x.isNotNull()))
    return rows.select("source_path", "line_idx", "level", "id", F.coalesce(above["id"], F.lit("root")).alias("parent_id"), "end_idx")


def invalid_sections(tree: DataFrame) -> DataFrame:
    """Sections whose parent is missing, not above them, or doesn't contain them."""
    up = tree.select("source_path", F.col("id").alias("parent_id"), F.col("level").alias("up_level"), F.col("line_idx").alias("up_line"), F.col("end_idx").alias("up_end"))
    rows = tree.join(up, ["source_path", "parent_id"], "left")
    bad = (F.col("parent_id") != "root") & (F.col("up_level").isNull() | (F.col("up_level") >= F.col("level")) | (F.col("up_line") >= F.col("line_idx")) | (F.col("up_end") < F.col("end_idx")))
    return rows.where(bad).select("source_path", "id", "parent_id")


def children(tree: DataFrame) -> DataFrame:
    return tree.groupBy("source_path", "parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "id"))), lambda x: x["id"]), ",").alias("children"))
