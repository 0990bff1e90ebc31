"""Indexes of the corpus: tags, directories, headings, terms, the page catalog, and their paging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from . import markdown

PAGE_CHARS, TERM_PAGES = 30_000, 20
# Terms that name generated pages.
STOP_TERMS = ("index", "_index", "headings", "links", "tags", "fragments", "page catalog")


def note_tags(notes: DataFrame) -> DataFrame:
    return notes.select("entry_path", F.explode("tags").alias("tag"))


def tag_index(notes: DataFrame) -> DataFrame:
    """(tag, entry_path) for every prefix of a trimmed tag, each once."""
    rows = note_tags(notes).withColumn("tag", T.trim(F.col("tag"))).where("tag != ''")
    return rows.select(F.explode(T.prefixes(F.col("tag"))).alias("tag"), "entry_path").distinct()


def tag_counts(notes: DataFrame) -> DataFrame:
    return tag_index(notes).groupBy("tag").agg(F.count(F.lit(1)).alias("n_notes"))


def directory_rollup(notes: DataFrame, fragments: DataFrame) -> DataFrame:
    """(dir, n_notes, n_fragments, n_direct, n_subdirs) for every directory above a note, '' at the top.

    Notes are added up by their own directory before they are spread over its ancestors.
    """
    count = fragments.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    rows = notes.select("source_path").join(count, "source_path", "left")
    own = rows.groupBy(T.parent_of(F.col("source_path")).alias("own")).agg(F.count(F.lit(1)).alias("notes"), F.sum(F.coalesce("n", F.lit(0))).alias("fragments"))
    chain = F.when(F.col("own") == "", F.array(F.lit(""))).otherwise(F.concat(T.ancestors(F.col("own")), F.array("own")))
    spread = own.withColumn("chain", F.array_distinct(chain)).select("own", "notes", "fragments", F.posexplode("chain").alias("depth", "dir"), F.size("chain").alias("size"), "chain")
    below = F.when(F.col("depth") < F.col("size") - 1, F.get("chain", F.col("depth") + 1))
    return spread.groupBy("dir").agg(
        F.sum("notes").alias("n_notes"),
        F.sum("fragments").alias("n_fragments"),
        F.sum(F.when(F.col("own") == F.col("dir"), F.col("notes")).otherwise(0)).alias("n_direct"),
        F.countDistinct(below).alias("n_subdirs"),
    )


def top_directories(notes: DataFrame, fragments: DataFrame) -> DataFrame:
    """(top, n_notes, n_fragments) by first path component; '(root)' for notes without a directory."""
    count = fragments.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    rows = notes.select("source_path").join(count, "source_path", "left")
    return rows.groupBy(F.coalesce(T.top_dir(F.col("source_path")), F.lit("(root)")).alias("top")).agg(F.count(F.lit(1)).alias("n_notes"), F.sum(F.coalesce("n", F.lit(0))).alias("n_fragments"))


def first_titles(notes: DataFrame, k: int = 3) -> DataFrame:
    """(dir, rank, title): the k first titles of each directory, by title then path. Each task keeps k of a directory."""
    rows = markdown.titles(notes).withColumn("dir", T.parent_of(F.col("source_path")))
    by_dir = Window.partitionBy("dir").orderBy("title", "source_path")
    return rows.withColumn("rank", F.row_number().over(by_dir).cast("long")).where(F.col("rank") <= k).select("dir", "rank", "title")


def heading_index(notes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(source_path, line_idx, level, text, anchor): the first h1 and every h2, anchors by a counter for equal ones of a level."""
    rows = markdown.headings(notes) if heads is None else heads
    first = rows.where("level = 1").groupBy("source_path").agg(F.min("line_idx").alias("line_idx"))
    kept = rows.where("level = 2").unionByName(rows.where("level = 1").join(first, ["source_path", "line_idx"]).select(*rows.columns))
    return markdown.counter_slugs(kept, ["source_path", "level"], "line_idx", default="").withColumnRenamed("slug", "anchor")


def is_suppressed(term) -> F.Column:
    return term.isin(*STOP_TERMS) | term.rlike(r"^page-\d+$")


def suppressed_source(path) -> F.Column:
    """Generated pages that give no terms."""
    return path.isin("index.md", "_unresolved.md") | (F.substring_index(path, "/", -1) == "_index.md") | path.rlike("^(headings|links|agent)(/|$)")


LABELS = r"\[([^\]\n]+)\]\([^)\n]+\)"


def terms(notes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(term, kind, page): lower-cased terms of five kinds with the entry pages that have them, each once."""
    page = F.col("entry_path").alias("page")
    heads = markdown.headings(notes) if heads is None else heads
    own = notes.select("source_path", "entry_path")
    parts = [
        note_tags(notes).select(F.col("tag").alias("term"), F.lit("tag").alias("kind"), page),
        heads.join(own, "source_path").select(F.col("text").alias("term"), F.lit("heading").alias("kind"), page),
        markdown.titles(notes, heads).join(own, "source_path").select(F.col("title").alias("term"), F.lit("title").alias("kind"), page),
        notes.select(F.col("stem").alias("term"), F.lit("file").alias("kind"), page),
        notes.select(F.explode(F.regexp_extract_all("body", F.lit(LABELS), F.lit(1))).alias("term"), F.lit("link_label").alias("kind"), page),
    ]
    return _cleaned(parts)


def _cleaned(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows = rows.withColumn("term", F.lower(T.trim(T.plain_link_label(F.col("term")))))
    return rows.where((F.col("term") != "") & ~is_suppressed(F.col("term")) & ~suppressed_source(F.col("page"))).distinct()


def tag_of_page(path) -> F.Column:
    """The tag that a tag page stands for; null for other pages."""
    return F.when(path.startswith("tags/") & (path != "tags/index.md"), F.regexp_replace(F.regexp_replace(path, "^tags/", ""), r"\.md$", ""))


def page_terms(pages: DataFrame) -> DataFrame:
    """(term, kind, page) of rendered pages (path, body, title, source): the tag of a tag page; of others headings, title, file
    and link labels, lists and navigation included."""
    own = tag_of_page(F.col("path"))
    others = pages.where(own.isNull())
    heads = markdown.headings(others.select(F.col("path").alias("source_path"), T.strip_front_matter(F.col("body")).alias("body")))
    page = F.col("path").alias("page")
    parts = [
        pages.where(own.isNotNull()).select(own.alias("term"), F.lit("tag").alias("kind"), page),
        heads.select(F.col("text").alias("term"), F.lit("heading").alias("kind"), F.col("source_path").alias("page")),
        others.select(F.col("title").alias("term"), F.lit("title").alias("kind"), page),
        others.where("source != ''").select(T.stem_of(F.col("source")).alias("term"), F.lit("file").alias("kind"), page),
        others.select(F.explode(F.regexp_extract_all("body", F.lit(LABELS), F.lit(1))).alias("term"), F.lit("link_label").alias("kind"), page),
    ]
    return _cleaned(parts)


def page_summary(text) -> F.Column:
    """Entries of a page of an index: how many link labels, or headings where there are none, with the first and the last."""
    labels = F.regexp_extract_all(text, F.lit(LABELS), F.lit(1))
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^\s*#{1,6} (.*)$"), F.lit(1))
    found = F.when(F.size(labels) > 0, labels).otherwise(heads)
    end = lambda k: F.coalesce(T.plain_link_label(F.try_element_at(found, F.lit(k))), F.lit(""))
    return F.struct(F.size(found).cast("long").alias("n"), end(1).alias("first"), end(-1).alias("last"))


def term_index(rows: DataFrame, most: int = TERM_PAGES) -> DataFrame:
    """(term, kind, n_pages, pages, n_more): the first `most` pages of each term by path.

    A common term is cut within salted parts first, so no task gets all its pages.
    """
    parts = F.split("page", "/")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(32)))
    nth = F.row_number().over(Window.partitionBy("term", "kind", "salt").orderBy(parts))
    cut = salted.withColumn("nth", nth).where(F.col("nth") <= most)
    listed = cut.groupBy("term", "kind").agg(F.slice(F.array_sort(F.collect_list(F.struct(parts.alias("parts"), F.col("page")))), 1, most).alias("l"))
    total = rows.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n_pages"))
    out = total.join(listed, ["term", "kind"])
    return out.select("term", "kind", "n_pages", F.array_join(F.transform("l", lambda x: x["page"]), ",").alias("pages"), F.greatest(F.col("n_pages") - most, F.lit(0)).alias("n_more"))


def page_kind(path) -> F.Column:
    """Kind of a generated page by its place."""
    name = F.substring_index(path, "/", -1)
    return (
        F.when(path == "index.md", "root_index")
        .when(path.startswith("tags/"), "tag_index")
        .when(path.startswith("headings/"), "heading_index")
        .when(path.startswith("links/"), "link_index")
        .when(path.startswith("agent/"), "agent_index")
        .when(name == "_index.md", "directory_index")
        .when(name == "index.md", "entry")
        .otherwise("leaf")
    )


def page_catalog(notes: DataFrame, pages: DataFrame, nav: DataFrame) -> DataFrame:
    """(path, kind, title, source, section, parent, prev, next), the source being the true one."""
    rows = pages.join(nav.withColumnRenamed("parent", "up"), "output_path", "left")
    none = F.lit("")
    return rows.select(
        F.col("output_path").alias("path"), "kind", "title", F.col("source_path").alias("source"), F.array_join(F.split("output_path", "/"), " > ").alias("section"), F.coalesce("up", none).alias("parent"), F.coalesce("prev", none).alias("prev"), F.coalesce("next", none).alias("next")
    )


def pages_by_source(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_path").agg(F.count(F.lit(1)).alias("n_pages"), F.min("output_path").alias("first_page"), F.max("output_path").alias("last_page"))


def root_summary(notes: DataFrame, pages: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: notes, leaf fragments, tags, unresolved links."""
    one = notes.agg(F.count(F.lit(1)).alias("n_notes"))
    two = pages.agg(F.count_if(F.col("kind").isin("h2leaf", "h3leaf")).alias("n_fragments"))
    three = tag_index(notes).agg(F.countDistinct("tag").alias("n_tags"))
    four = unresolved.agg(F.count(F.lit(1)).alias("n_unresolved"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four)  # one row each


def packed(rows: DataFrame, scope: list[str], order: list[str], size: str, limit: int = PAGE_CHARS, header: int = 0, carry: list[str] | None = None) -> DataFrame:
    """(*scope, *order, *carry, page_no): rows in order go to a page until the next would take it beyond the limit (greedy, with
    reset). Rows of a scope pass by in order; what is held is the page's number and how full it is."""
    names = [*scope, *order, *(carry or [])]
    rows = rows.select(*names, F.col(size).cast("long").alias("_n"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, page, used = None, 0, -1
        for batch in batches:
            out = []
            for key, n in zip(zip(*(batch.column(c).to_pylist() for c in scope), strict=True), batch.column("_n").to_pylist(), strict=True):
                if key != now:
                    now, page, used = key, 0, -1
                if used >= 0 and used + n > limit:
                    page, used = page + 1, -1
                used = (header if used < 0 else used) + n
                out.append(page)
            yield batch.select(names).append_column(pa.field("page_no", pa.int64()), pa.array(out, pa.int64()))

    placed = rows.repartition(*scope).sortWithinPartitions(*scope, *order)
    return placed.mapInArrow(fold, StructType([*rows.schema.fields[:-1], StructField("page_no", LongType())]))
