"""A corpus of notes compiled into pages: the shared tables, and every generated page from them.

Tables that several operators read are written once to the shared folder: headings, pages, links, resolutions, edges. Page texts
are written once before metadata, terms and the catalog read them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import kept, work_folder, written
from . import indexes, large, links, markdown, render, retrieval


class Corpus:
    """The tables of a corpus of notes, each made when it is first asked for and kept in one folder."""

    def __init__(self, notes: DataFrame, resplit: int = markdown.RESPLIT_LINES):
        self.spark, self.resplit = notes.sparkSession, resplit
        self.folder = work_folder(self.spark, "corpus")
        self.notes = self.kept(notes, "notes")

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, self.folder, name)

    @cached_property
    def heads(self) -> DataFrame:
        return self.kept(markdown.headings(self.notes), "headings")

    @cached_property
    def sections(self) -> DataFrame:
        return markdown.sections(self.notes, self.resplit, self.heads)

    @cached_property
    def pages(self) -> DataFrame:
        return self.kept(markdown.pages(self.notes, self.resplit, self.heads), "pages")

    @property
    def titles(self) -> DataFrame:
        return self.pages.select(F.col("output_path").alias("path"), "title")

    @property
    def bodies(self) -> DataFrame:
        return links.bodies(self.notes, found=self.pages)

    @cached_property
    def links(self) -> DataFrame:
        return self.kept(links.page_links(self.bodies), "links")

    @cached_property
    def goals(self) -> DataFrame:
        return self.kept(links.targets(self.notes, self.pages, self.heads), "goals")

    @cached_property
    def resolved(self) -> DataFrame:
        return self.kept(links.resolve(self.notes, links.wikilinks(self.links), self.goals), "resolved")

    @cached_property
    def md(self) -> DataFrame:
        return self.kept(links.resolve_markdown(self.notes, links.markdown_links(self.links), self.goals), "md")

    @cached_property
    def edges(self) -> DataFrame:
        return self.kept(links.edges(self.notes, self.resolved, self.md), "edges")

    @property
    def unresolved(self) -> DataFrame:
        return links.unresolved(self.resolved)


def fragment_pages(c: Corpus) -> DataFrame:
    """(path, body) of the pages of all notes."""
    main = render.rewritten(c.bodies, c.links, c.resolved, c.md)
    lists = [render.fragment_lists(c.pages), render.backlink_lists(c.edges, c.titles), render.related_lists(links.top_related(c.notes), c.titles)]
    return render.assembled(c.pages, main, render.navigation_lines(c.pages), lists)


def index_documents(c: Corpus, title: str) -> DataFrame:
    """(path, body) of headings, links, tags, directories, unresolved links and the root."""
    leaves = c.pages.where("kind in ('h2leaf', 'h3leaf')")
    lines = render.heading_lines(c.notes, c.pages, indexes.heading_index(c.notes, c.heads))
    for x in (
        render.link_lines(c.edges, c.titles),
        render.tag_lines(c.notes, c.pages.where("kind = 'entry'").select(F.col("output_path").alias("path"), "title")),
        render.unresolved_lines(c.unresolved),
        render.directory_lines(c.notes, c.pages),
        render.root_lines(title, indexes.root_summary(c.notes, c.pages, c.unresolved), indexes.top_directories(c.notes, leaves), render.heading_preview(c.heads)),
    ):
        lines = lines.unionByName(x)
    return render.documents(c.kept(lines, "index-lines"))


#: A rendered page with what is known of it beyond its text; what is null is read from the text and the path.
PAGE = "path string, body string, kind string, title string, source string, split_reason string, byte_ranges array<struct<first:bigint,last:bigint>>, line_ranges array<struct<first:bigint,last:bigint>>, parent string, prev string, next string"


def bare(pages: DataFrame, **known) -> DataFrame:
    """Pages (path, body) in the shape of PAGE."""
    columns = [(x.split()[0], x.split()[1]) for x in PAGE.replace("struct<first:bigint,last:bigint>", "PAIR").split(", ")]
    pair = "struct<first:bigint,last:bigint>"
    return pages.select(*[(F.col(c) if c in ("path", "body") else known.get(c, F.lit(None))).cast(t.replace("PAIR", pair)).alias(c) for c, t in columns])


# The routes of the guide, by what is asked for.
ROUTES = (
    ("definition", "`agent/terms/`, `headings/`", "`fragments/_index.md`"),
    ("specification", "`headings/`, a search of texts", "leaf pages before and after"),
    ("relationship", "`links/`, lists of backlinks", "related pages"),
    ("tag", "`tags/`", "`agent/terms/`"),
    ("schema field", "`agent/fields/`", "`agent/pages/`"),
    ("unresolved", "`_unresolved.md`", "`agent/pages/`"),
    ("long source", "`agent/pages/`, by source and line range", "leaf pages before and after"),
    ("ambiguous", "`agent/terms/`, a search of texts", "`agent/pages/`"),
)


def guide(spark, with_fields: bool) -> DataFrame:
    """(path, body) of agent/index.md."""
    listed = ["../fragments/_index.md", "../headings/index.md", "../links/index.md", "../tags/index.md", "../_unresolved.md", "pages/index.md", "terms/index.md"] + ["fields/index.md"] * with_fields
    body = "# Agent Guide\n\n- A page has at most 40,000 characters, unless a single section is longer\n- Find pages through the indexes; Do not read every leaf page in turn\n- Cite source, line range and page path\n\n## Indexes\n\n"
    body += "".join(f"- [{x}]({x})\n" for x in listed)
    body += "\n## Query Routing\n\n| Query type | First | Then |\n|---|---|---|\n" + "".join(f"| {a} | {b} | {c} |\n" for a, b, c in ROUTES)
    body += "\n## Steps\n\n1. `index.md`, then this page.\n2. The index that the query's type names.\n3. Entry pages, then single leaf pages.\n4. Neighbours, backlinks and links only as needed.\n"
    return bare(spark.createDataFrame([("agent/index.md", body)], "path string, body string"), kind=F.lit("agent_guide"), title=F.lit("Agent Guide"), parent=F.lit("../index.md"))


def with_metadata(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of PAGE, written: (path, body, kind, title, source, parent, prev, next, chars) with a metadata block in each body.
    sources: (path, source) of the pages of notes. chars counts the whole page.

    What a page links to, and what hangs on it, are links in its text whose goal is among the pages.
    """
    found = pages.select("path", "body", F.posexplode(F.regexp_extract_all("body", F.lit(links.MDLINK), F.lit(2))).alias("at", "target"))
    goal = T.normalize_path(F.concat_ws("/", F.nullif(T.parent_of(F.col("path")), F.lit("")), "target"))
    found = found.select("path", "at", goal.alias("goal")).join(pages.select(F.col("path").alias("goal")), "goal", "left_semi")
    listed = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "goal"))), lambda x: x["goal"]).alias("goals"))
    heads = markdown.headings(pages.select(F.col("path").alias("source_path"), "body")).groupBy(F.col("source_path").alias("path")).agg(F.min_by(F.struct("level", "text"), "line_idx").alias("head"))
    rows = pages.join(heads, "path", "left").join(listed, "path", "left").join(sources.withColumnRenamed("source", "of"), "path", "left")
    nav = F.regexp_extract("body", r"(?m)^(> Parent: .*)$", 1)
    way = lambda word: F.regexp_extract(nav, rf"{word}: \[[^\]\n]+\]\(([^)]+)\)", 1)
    own = F.col("path").rlike("^(headings|links|tags)/") | F.col("path").isin("index.md", "_unresolved.md") | F.col("path").rlike(r"(^|/)_index(-page-\d+)?\.md$")
    kind = F.coalesce("kind", F.when(own, "paged_index").when(F.col("path").startswith("fragments/") & F.col("path").endswith("/index.md"), "entry").otherwise("leaf"))
    none = F.array().cast("array<string>")
    goals = F.coalesce("goals", none)
    n_lines = F.size(F.split(F.regexp_replace("body", r"\n\z", ""), "\n")).cast("long")
    rows = rows.select(
        "path", "body", kind.alias("kind"), F.coalesce("title", "head.text", "path").alias("title"), F.coalesce("source", "of", F.lit("")).alias("source"), F.col("head.level").alias("heading_level"), "split_reason",
        F.length("body").cast("long").alias("chars"), F.coalesce("byte_ranges", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("byte_ranges"),
        F.coalesce("line_ranges", F.array(F.struct(F.lit(1).cast("long").alias("first"), n_lines.alias("last")))).alias("line_ranges"),
        *[F.coalesce(k, way(w)).alias(k) for k, w in (("parent", "Parent"), ("prev", "Prev"), ("next", "Next"))],
        F.when(F.col("body").contains("## Fragments"), goals).otherwise(none).alias("children"), F.array_compact(F.array(indexes.tag_of_page(F.col("path")))).alias("tags"),
        F.when(kind == "paged_index", none).otherwise(goals).alias("outgoing"), T.occurrences(F.col("body"), "## Backlinks").alias("backlinks_count"),
    )
    blocks = render.metadata_block(rows).withColumnRenamed("body", "block")
    whole = F.concat("block", "body")
    out = rows.select("path", "body", "kind", "title", "source", "parent", "prev", "next").join(blocks, "path")
    return out.select("path", whole.alias("body"), "kind", "title", "source", "parent", "prev", "next", F.length(whole).cast("long").alias("chars"))


# ---------------------------------------------------------------- tables of terms and pages

TABLES = {
    "agent/terms": ("Term Index", "term_index", "| term | kind | pages |\n|---|---|---|\n"),
    "agent/pages": ("Page Catalog", "page_catalog", "| path | kind | title | source | section | chars | parent | prev | next |\n|---|---|---|---|---|---:|---|---|---|\n"),
}


def table_pages(rows: DataFrame, place: str, limit: int = render.PAGE_CHARS) -> DataFrame:
    """Pages of PAGE from the rows (k, line, label) of one table, in the order of k: one page, or an index of pages that are
    packed greedily. A task gathers one page."""
    name, kind, header = TABLES[place]
    rows = rows.withColumn("scope", F.lit(place)).withColumn("size", F.length("line").cast("long"))
    placed = indexes.packed(rows, ["scope"], ["k"], "size", limit, len(header), carry=["line", "label"])
    texts = placed.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("k", "line", "label"))).alias("l"))
    texts = texts.select("page_no", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"), F.size("l").alias("n"), F.element_at("l", 1)["label"].alias("first"), F.element_at("l", -1)["label"].alias("last"))
    texts = kept(texts, "table-pages")
    texts = texts.withColumn("pages", F.lit(texts.count())).withColumn("no", T.page_number(F.col("page_no") + 1)).withColumn("nth", (F.col("page_no") + 1).cast("string"))
    file = lambda n: F.concat(F.lit("page-"), T.page_number(n), F.lit(".md"))
    many = texts.where("pages > 1")
    own = many.select(F.concat(F.lit(f"{place}/page-"), "no", F.lit(".md")).alias("path"), F.concat(F.lit(f"# {name} "), "nth", F.lit(f"\n\n{header}"), "text").alias("body"), "page_no", "pages", "nth")
    own = bare(own, kind=F.lit(kind), title=F.concat(F.lit(f"{name} "), "nth"), parent=F.lit("index.md"), prev=F.when(F.col("page_no") > 0, file(F.col("page_no"))), next=F.when(F.col("page_no") + 1 < F.col("pages"), file(F.col("page_no") + 2)))
    line = F.concat(F.lit("- [Page "), "nth", F.lit("](page-"), "no", F.lit(".md): "), F.col("n").cast("string"), F.lit(" rows, `"), "first", F.lit("` to `"), "last", F.lit("`\n"))
    listed = many.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", line.alias("line")))), lambda x: x["line"]), "").alias("text"))
    one = texts.where("pages = 1").groupBy().agg(F.max("text").alias("text"))
    index = listed.withColumnRenamed("text", "listed").crossJoin(one)  # one row each
    body = F.concat(F.lit(f"# {name}\n\n"), F.when(F.col("listed") != "", F.col("listed")).otherwise(F.concat(F.lit(header), F.coalesce("text", F.lit("")))))
    index = index.select(F.lit(f"{place}/index.md").alias("path"), body.alias("body"))
    return own.unionByName(bare(index, kind=F.lit(kind), title=F.lit(name), parent=F.lit("../index.md")))


def term_pages(found: DataFrame) -> DataFrame:
    """Pages of PAGE of the term index, from (term, kind, page)."""
    rows = indexes.term_index(found)
    linked = F.array_join(F.transform(F.split("pages", ","), lambda p: F.concat(F.lit("["), p, F.lit("](../../"), p, F.lit(")"))), ", ")
    more = F.when(F.col("n_more") > 0, F.format_string(", ... %d more; see [Page Catalog](../pages/index.md)", "n_more")).otherwise(F.lit(""))
    line = F.concat(F.lit("| "), T.escape_table(F.col("term")), F.lit(" | `"), "kind", F.lit("` | "), linked, more, F.lit(" |\n"))
    return table_pages(rows.select(F.array("term", "kind").alias("k"), line.alias("line"), F.col("term").alias("label")), "agent/terms")


def catalog_line(row=F.col) -> F.Column:
    cell = lambda c: T.escape_table(row(c))
    first = F.concat(F.lit("| ["), cell("path"), F.lit("](../../"), row("path"), F.lit(") | `"), cell("kind"), F.lit("` | "))
    return F.concat(first, F.concat_ws(" | ", cell("title"), cell("source"), cell("section"), row("chars").cast("string"), cell("parent"), cell("prev"), cell("next")), F.lit(" |\n"))


def source_pages(rows: DataFrame) -> DataFrame:
    """Pages of PAGE for each source, from catalog rows (path, kind, title, source, chars), and an index of these."""
    mine = rows.where("source != ''")
    names = kept(markdown.unused_names(mine.select("source").distinct().withColumn("base", T.source_page_stem(F.col("source"))), [], "source", "base", "name", ".md").select("source", "name"), "source-names")
    line = F.concat(F.lit("| ["), T.escape_table(F.col("path")), F.lit("](../../../"), "path", F.lit(") | `"), "kind", F.lit("` | "), T.escape_table(F.col("title")), F.lit(" | "), F.col("chars").cast("string"), F.lit(" |"))
    place = F.concat(F.lit("agent/pages/by-source/"), "name")
    listed = mine.join(names, "source")
    none = F.array().cast("array<string>")
    top = names.select(F.explode(F.array(*[F.struct(place.alias("path"), F.lit(i).alias("n"), t.alias("line")) for i, t in enumerate((F.concat(F.lit("# "), "source"), F.lit(""), F.lit("| page | kind | title | chars |"), F.lit("|---|---|---|---:|")))])).alias("x"))
    lines = render._lines(top.select("x.*"), F.col("path"), none, F.col("n"), F.col("line"))
    lines = lines.unionByName(render._lines(listed.withColumn("of", place), F.col("of"), F.split("path", "/"), F.lit(0), line))
    index = "agent/pages/by-source/index.md"
    counts = listed.groupBy("source", "name").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.unionByName(render.head_of(rows.sparkSession, index, "# Pages By Source", ""))
    lines = lines.unionByName(render._lines(counts, F.lit(index), F.array("source"), F.lit(0), F.concat(F.lit("- ["), "source", F.lit("]("), "name", F.lit("): "), F.col("n").cast("string"), F.lit(" pages"))))
    docs = render.documents(lines)
    return bare(docs, kind=F.lit("page_catalog"), parent=F.when(F.col("path") == index, "../index.md").otherwise("index.md"))


def catalog_rows(pages: DataFrame) -> DataFrame:
    """(path, kind, title, source, section, chars, parent, prev, next) of pages with metadata."""
    return pages.select("path", "kind", "title", "source", F.array_join(F.split("path", "/"), " > ").alias("section"), "chars", "parent", "prev", "next")


def catalog_pages(rows: DataFrame) -> DataFrame:
    line = catalog_line()
    return table_pages(rows.select(F.split("path", "/").alias("k"), line.alias("line"), F.col("path").alias("label")), "agent/pages")


# ---------------------------------------------------------------- schema outputs

CATALOG = """generated_path string, entry_path string, source_path string, line_start long, line_end long, title string, kind string, entities array<string>, tags array<string>,
headings array<string>, fields map<string,array<struct<text:string,source_path:string,line_start:bigint,line_end:bigint>>>, outgoing array<string>, backlinks array<string>"""


def catalog(c: Corpus, schema: retrieval.SchemaPack, more: DataFrame | None = None) -> DataFrame:
    """The internal catalog, a row of CATALOG for each page: a note's attributes for all its pages, evidence of the schema's
    fields on entry pages, links in and out. more: pages of large files (path, title, kind, source, headings, lines)."""
    found = retrieval.catalog(c.notes, c.pages, markdown.titles(c.notes, c.heads), c.heads)
    size = c.notes.select("source_path", F.greatest(F.size(F.split(F.regexp_replace(F.coalesce(*[x for x in ("content", "body") if x in c.notes.columns]), r"\n\z", ""), "\n")), F.lit(1)).cast("long").alias("line_end"))
    proof = retrieval.evidence(c.notes, schema)
    by_field = proof.groupBy("generated_path", "field").agg(F.array_sort(F.collect_list(F.struct("line_start", "line_end", "source_path", "text"))).alias("l"))
    shown = F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["source_path"].alias("source_path"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end")))
    fields = by_field.groupBy("generated_path").agg(F.map_from_entries(F.collect_list(F.struct("field", shown.alias("l")))).alias("fields"))
    out = c.edges.groupBy(F.col("src").alias("generated_path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "dst"))), lambda x: x["dst"]).alias("outgoing"))
    # of a page that very many link to the first ones by path are listed, as on the page itself
    back = c.edges.withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(32)))
    back = back.withColumn("nth", F.row_number().over(Window.partitionBy("dst", "salt").orderBy("src"))).where(F.col("nth") <= render.BACKLINKS)
    back = back.groupBy(F.col("dst").alias("generated_path")).agg(F.slice(F.array_sort(F.collect_list("src")), 1, render.BACKLINKS).alias("backlinks"))
    none = F.array().cast("array<string>")
    rows = found.join(size, "source_path").join(fields, "generated_path", "left").join(out, "generated_path", "left").join(back, "generated_path", "left")
    empty = F.create_map().cast("map<string,array<struct<text:string,source_path:string,line_start:bigint,line_end:bigint>>>")
    rows = rows.select("generated_path", "entry_path", "source_path", F.lit(1).cast("long").alias("line_start"), "line_end", "title", "kind", "entities", "tags", "headings", F.coalesce("fields", empty).alias("fields"), F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("backlinks", none).alias("backlinks"))
    if more is None:
        return rows
    entities = F.array_sort(F.array_distinct(F.concat(F.array("title", "source", T.stem_of(F.col("source"))), "headings")))
    large_ = more.join(rows.select(F.col("generated_path").alias("path")), "path", "left_anti")
    return rows.unionByName(large_.select(F.col("path").alias("generated_path"), F.concat(T.parent_of(F.col("path")), F.lit("/index.md")).alias("entry_path"), F.col("source").alias("source_path"), F.col("lines.first").alias("line_start"), F.col("lines.last").alias("line_end"), "title", "kind", entities.alias("entities"), none.alias("tags"), "headings", empty.alias("fields"), none.alias("outgoing"), none.alias("backlinks")))


def field_pages(rows: DataFrame, schema: retrieval.SchemaPack) -> DataFrame:
    """(path, body) of agent/fields: a page for each field of the schema with its evidence, and an index."""
    spark = rows.sparkSession
    each = rows.select("generated_path", F.explode("fields").alias("field", "items")).select("generated_path", "field", F.posexplode("items").alias("n", "x"))
    path = F.concat(F.lit("agent/fields/"), "field", F.lit(".md"))
    line = F.concat(F.lit("- `"), "generated_path", F.lit("` lines "), F.col("x.line_start").cast("string"), F.lit("-"), F.col("x.line_end").cast("string"), F.lit(": "), T.compact_line(F.col("x.text")))
    lines = render._lines(each.join(spark.createDataFrame([(f,) for f in schema.fields], "field string"), "field", "left_semi"), path, F.array("generated_path"), F.col("n"), line)
    fixed = [("agent/fields/index.md", [], 0, "# Fields"), ("agent/fields/index.md", [], 1, "")]
    for k, f in enumerate(sorted(schema.fields)):
        fixed += [("agent/fields/index.md", [f], 0, f"- [{schema.label(f)}]({f}.md)"), (f"agent/fields/{f}.md", [], 0, f"# {schema.label(f)}"), (f"agent/fields/{f}.md", [], 1, "")]
    return render.documents(lines.unionByName(spark.createDataFrame(fixed, render.LINES)))


# ---------------------------------------------------------------- all pages


class Compiled:
    """Everything that a run generates: pages (path, body) and, with a schema, the catalog."""

    def __init__(self, pages: DataFrame, rows: DataFrame, catalog_: DataFrame | None):
        self.pages, self.rows, self.catalog = pages, rows, catalog_


def compile_corpus(notes: DataFrame, title: str = "Index", files: DataFrame | None = None, schema: retrieval.SchemaPack | None = None, resplit: int = markdown.RESPLIT_LINES) -> Compiled:
    """Compiles notes, and large files (path, content), if there are any.

    The order matters: indexes are paged, pages get metadata, terms are read from these, and the catalog lists all of them,
    the term index included. Of equal paths a page of a large file stays.
    """
    c = Corpus(notes, resplit)
    base = bare(fragment_pages(c)).unionByName(bare(index_documents(c, title)))
    sources = c.pages.select(F.col("output_path").alias("path"), F.col("source_path").alias("source"))
    found, more = None, None
    if files is not None:
        plans = c.kept(large.pages(files), "large")
        own = plans.select(*[F.col(x.split()[0]) for x in PAGE.replace("struct<first:bigint,last:bigint>", "PAIR").split(", ")])
        base = base.join(own.select("path"), "path", "left_anti").unionByName(own)
        more = plans.where("kind in ('entry', 'leaf')").select("path", "title", "kind", "source", "headings", F.coalesce(F.try_element_at("line_ranges", F.lit(1)), F.struct(F.lit(1).cast("long").alias("first"), F.lit(1).cast("long").alias("last"))).alias("lines"))
    if schema is not None:
        found = c.kept(catalog(c, schema, more), "catalog")
        base = base.unionByName(bare(field_pages(found, schema), kind=F.lit("leaf")))
    spark = c.spark
    base = c.kept(base.unionByName(guide(spark, schema is not None)), "texts")
    pages = c.kept(with_metadata(base, sources), "pages-with-metadata")
    terms = c.kept(with_metadata(term_pages(indexes.page_terms(pages)), sources), "term-pages")
    listed = pages.unionByName(terms)
    by_source = c.kept(with_metadata(source_pages(catalog_rows(listed)), sources), "source-pages")
    listed = listed.unionByName(by_source)
    rows = catalog_rows(listed)
    own = spark.createDataFrame([("agent/pages/index.md", "page_catalog", "Page Catalog", "", "agent > pages > index.md", 0, "../index.md", "", "")], rows.schema)
    last = c.kept(with_metadata(catalog_pages(rows.unionByName(own)), sources), "catalog-pages")
    everything = listed.unionByName(last)
    return Compiled(everything.select("path", "body"), catalog_rows(everything), found)
