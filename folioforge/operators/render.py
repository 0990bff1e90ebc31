"""Page texts: links rewritten, pages with navigation and lists, index documents and their paging.

Each text is a thin projection: rows of lines with an order are gathered by page. Lists that can be long, as backlinks of a hot
page, are cut before they are gathered; index documents are cut into pages of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as FM
from ..functions import text as T
from ..sources.tables import kept
from . import indexes, links

UNRESOLVED_MARK = "(unresolved)"
#: Backlinks that a page lists; the others are in the link index.
BACKLINKS = 1000
#: Characters of an index document, and of a page of one that is longer.
INDEX_CHARS, PAGE_CHARS = 40_000, 30_000


def joined(rows: DataFrame, keys: list[str], order: list[Column], line: Column, sep: str = "\n") -> DataFrame:
    """Lines of each key in order, as one text."""
    at = [c.alias(f"o{i}") for i, c in enumerate(order)]
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*at, line.alias("line")))), lambda x: x["line"]), sep).alias("body"))


def _goal(page: Column) -> Column:
    return F.concat(T.relative_link(page, F.col("dst")), F.coalesce(F.concat(F.lit("#"), F.col("anchor")), F.lit("")))


def rewritten(shielded: DataFrame, found: DataFrame, resolved: DataFrame, md: DataFrame) -> DataFrame:
    """(output_path, main): raw texts of pages with their links as relative links. A wikilink that leads nowhere keeps its
    brackets and gets a mark; other links stay as they are. A text is cut at its links, so a rewritten link is not read again."""
    page = F.col("output_path")
    shown = F.coalesce("alias", F.when(F.col("heading").isNotNull(), F.concat_ws("#", "target", "heading")), F.col("target"))
    wiki = F.when(F.col("dst").isNull(), F.concat(F.regexp_replace("raw", "^!", ""), F.lit(" " + UNRESOLVED_MARK))).otherwise(F.concat(F.lit("["), shown, F.lit("]("), _goal(page), F.lit(")")))
    other = F.when(F.col("dst").isNull(), F.col("raw")).otherwise(F.concat(F.lit("["), F.col("label"), F.lit("]("), _goal(page), F.lit(")")))
    news = resolved.select("output_path", "at", wiki.alias("new")).union(md.select("output_path", "at", other.alias("new")))
    all_ = found.select("output_path", "at", "raw").join(news, ["output_path", "at"], "left")
    listed = all_.groupBy("output_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", "raw").alias("new")))), lambda x: x["new"]).alias("news"))
    pieces = F.split("raw", links.ANYLINK, -1)
    text = F.array_join(F.flatten(F.transform(pieces, lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(F.get("news", i - 1), p)))), "")
    out = shielded.select("output_path", "raw").join(listed, "output_path", "left")
    return out.select("output_path", F.replace(F.when(F.col("news").isNull(), F.col("raw")).otherwise(text), F.lit(f"[{FM.SHIELD}["), F.lit("[[")).alias("main"))


def _item(label: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("- ["), T.link_label(label), F.lit("]("), T.relative_link(source, target), F.lit(")"))


def navigation_lines(pages: DataFrame) -> DataFrame:
    """(output_path, head): the line with the page above and, of a leaf, the ones before and after it."""
    siblings = Window.partitionBy("above").orderBy("ord")
    rows = pages.where("kind != 'entry'")
    for name, way in (("prev", F.lag), ("next", F.lead)):
        rows = rows.withColumn(name, F.when(F.col("kind") != "shell", way(F.struct("output_path", "title")).over(siblings)))
    up = pages.select(F.col("output_path").alias("above"), F.col("title").alias("above_title"))
    rows = rows.join(up, "above")
    link = lambda word, title, path: F.concat(F.lit(f"{word}: ["), T.link_label(title), F.lit("]("), T.relative_link(F.col("output_path"), path), F.lit(")"))
    parts = [link("Parent", F.col("above_title"), F.col("above"))] + [F.when(F.col(x).isNotNull(), link(w, F.col(f"{x}.title"), F.col(f"{x}.output_path"))) for x, w in (("prev", "Prev"), ("next", "Next"))]
    return rows.select("output_path", F.concat(F.lit("> "), F.array_join(F.array_compact(F.array(*parts)), " · ")).alias("head"))


def fragment_lists(pages: DataFrame) -> DataFrame:
    """(output_path, fragments): the pages that hang on an entry page or a shell."""
    rows = pages.where("above is not null")
    out = joined(rows, ["above"], [F.col("ord")], _item(F.col("title"), F.col("above"), F.col("output_path")))
    return out.select(F.col("above").alias("output_path"), F.concat(F.lit("## Fragments\n\n"), "body", F.lit("\n")).alias("fragments"))


def backlink_lists(edges: DataFrame, titles: DataFrame, most: int = BACKLINKS) -> DataFrame:
    """(output_path, backlinks): the first pages by path that link to a page, and how many more there are. titles: (path, title).

    Links are cut within salted parts first, so no task gets all links to a page.
    """
    parts = F.split("src", "/")
    salted = edges.select("src", "dst").withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(32)))
    cut = salted.withColumn("nth", F.row_number().over(Window.partitionBy("dst", "salt").orderBy(parts))).where(F.col("nth") <= most)
    cut = cut.withColumn("nth", F.row_number().over(Window.partitionBy("dst").orderBy(parts))).where(F.col("nth") <= most)
    rows = cut.join(titles.select(F.col("path").alias("src"), "title"), "src", "left")
    listed = joined(rows, ["dst"], [F.col("nth")], _item(F.coalesce("title", "src"), F.col("dst"), F.col("src")))
    n = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > most, F.format_string("- ... %d more; see [Links](%s)\n", F.col("n") - most, T.relative_link(F.col("dst"), F.lit("links/index.md")))).otherwise(F.lit(""))
    return listed.join(n, "dst").select(F.col("dst").alias("output_path"), F.concat(F.lit("## Backlinks\n\n"), "body", F.lit("\n"), more).alias("backlinks"))


def related_lists(related: DataFrame, titles: DataFrame) -> DataFrame:
    """(output_path, related): related entries as `links.top_related` ranks them."""
    rows = related.join(titles.select(F.col("path").alias("dst"), "title"), "dst", "left")
    out = joined(rows, ["src"], [F.col("why"), F.col("rank")], _item(F.coalesce("title", "dst"), F.col("src"), F.col("dst")))
    return out.select(F.col("src").alias("output_path"), F.concat(F.lit("## Related\n\n"), "body", F.lit("\n")).alias("related"))


def assembled(pages: DataFrame, main: DataFrame, heads: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """(path, body) of pages: navigation, a rule, the text, a rule and its lists, of which each is (output_path, text)."""
    rows, names = pages.select("output_path").join(main, "output_path").join(heads, "output_path", "left"), []
    for x in lists:
        rows, names = rows.join(x, "output_path", "left"), [*names, x.columns[1]]
    autos = F.array_compact(F.array(*names))
    closed = F.when(F.col("main").endswith("\n"), F.col("main")).otherwise(F.concat("main", F.lit("\n")))
    top = F.coalesce(F.concat("head", F.lit("\n---\n\n")), F.lit(""))
    body = F.when(F.size(autos) == 0, F.concat(top, "main")).otherwise(F.concat(top, closed, F.lit("\n---\n\n"), F.array_join(autos, "\n")))
    return rows.select(F.col("output_path").alias("path"), body.alias("body"))


# ---------------------------------------------------------------- index documents

#: Lines of index documents: (path, k, n, line), in the order of k, then n.
LINES = "path string, k array<string>, n long, line string"


def _lines(rows: DataFrame, path: Column, k: Column, n: Column, line: Column) -> DataFrame:
    return rows.select(path.alias("path"), k.cast("array<string>").alias("k"), n.cast("long").alias("n"), line.alias("line"))


def head_of(spark, path: str, *texts: str) -> DataFrame:
    """The first lines of a document."""
    return spark.createDataFrame([(path, [], i, t) for i, t in enumerate(texts)], LINES)


def _listed(rows: DataFrame, path: str, sub: Column, key: Column, n: Column, line: Column) -> DataFrame:
    """Blocks of a document: a heading for each key, a blank line, its lines and another blank line. rows are the lines."""
    one = rows.select(key.alias("key"), sub.alias("sub")).distinct()
    where = F.lit(path)
    parts = [_lines(one, where, F.col("key"), F.lit(at), text) for at, text in ((-2, F.concat(F.lit("## "), F.col("sub"))), (-1, F.lit("")), (1 << 40, F.lit("")))]
    out = _lines(rows, where, key, n, line)
    for x in parts:
        out = out.unionByName(x)
    return out


def heading_lines(notes: DataFrame, pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Of headings/index.md: for each note its first heading of level one and its second-level headings with their pages, or
    anchors where the note isn't cut. entries: `indexes.heading_index`."""
    path = "headings/index.md"
    at = F.lit(path)
    cut = pages.where("kind in ('h2leaf', 'shell')").select("source_path", F.col("ord").alias("line_idx"), F.col("output_path").alias("page"))
    titles = pages.where("kind = 'entry'").select("source_path", "entry_path", "title")
    rows = entries.join(titles, "source_path").join(cut, ["source_path", "line_idx"], "left")
    own = F.when(F.col("level") == 1, T.relative_link(at, F.col("entry_path"))).when(F.col("page").isNotNull(), T.relative_link(at, F.col("page"))).otherwise(F.concat(T.relative_link(at, F.col("entry_path")), F.lit("#"), F.col("anchor")))
    line = F.concat(F.when(F.col("level") == 2, "  ").otherwise(""), F.lit("- ["), T.link_label(F.col("text")), F.lit("]("), own, F.lit(")"))
    top = F.concat(F.lit("["), T.link_label(F.col("title")), F.lit("]("), T.relative_link(at, F.col("entry_path")), F.lit(")"))
    n = F.when(F.col("level") == 1, F.lit(0)).otherwise(F.col("line_idx") + 1)
    return head_of(notes.sparkSession, path, "# Headings", "").unionByName(_listed(rows, path, top, F.split("source_path", "/"), n, line))


def link_lines(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """Of links/index.md: for each page, by path, the pages it links to, in order. titles: (path, title) of all pages."""
    path = "links/index.md"
    at = F.lit(path)
    src, dst = titles.select(F.col("path").alias("src"), F.col("title").alias("src_title")), titles.select(F.col("path").alias("dst"), F.col("title").alias("dst_title"))
    rows = edges.join(src, "src").join(dst, "dst", "left")
    top = F.concat(F.lit("["), T.link_label(F.col("src_title")), F.lit("]("), T.relative_link(at, F.col("src")), F.lit(")"))
    return head_of(edges.sparkSession, path, "# Links", "").unionByName(_listed(rows, path, top, F.split("src", "/"), F.col("first_ord"), _item(F.coalesce("dst_title", "dst"), at, F.col("dst"))))


def unresolved_lines(unresolved: DataFrame) -> DataFrame:
    """Of _unresolved.md: for each page, by path, its wikilinks that lead nowhere, by target, and the reason."""
    path = "_unresolved.md"
    w = Window.partitionBy("output_path").orderBy("target", F.desc("at"))
    rows = unresolved.withColumn("n", F.row_number().over(w))
    top = F.concat(F.lit("`"), F.col("output_path"), F.lit("`"))
    return head_of(unresolved.sparkSession, path, "# Unresolved wikilinks", "").unionByName(_listed(rows, path, top, F.split("output_path", "/"), F.col("n"), unresolved_line()))


def unresolved_line() -> Column:
    name = F.concat(F.concat_ws("#", "target", "heading"), F.coalesce(F.concat(F.lit("|"), "alias"), F.lit("")))
    return F.concat(F.lit("- `[["), name, F.lit("]]`: "), F.when(F.col("heading").isNotNull(), "heading missing").otherwise("note missing"))


def unresolved_report(unresolved: DataFrame) -> DataFrame:
    """(output_path, body): links of each page that lead nowhere, with the reason."""
    return joined(unresolved, ["output_path"], [F.col("target"), F.col("at")], unresolved_line())


def tag_lines(notes: DataFrame, titles: DataFrame) -> DataFrame:
    """Of tags/index.md and a page for each tag prefix. titles: (path, title)."""
    index = kept(indexes.tag_index(notes), "tag-index")
    rows = index.join(titles.withColumnRenamed("path", "entry_path"), "entry_path", "left").withColumn("path", T.tag_page_path(F.col("tag")))
    none = F.array().cast("array<string>")
    tops = index.select("tag").distinct().withColumn("path", T.tag_page_path(F.col("tag")))
    out = _lines(rows, F.col("path"), F.split("entry_path", "/"), F.lit(0), _item(F.coalesce("title", "entry_path"), F.col("path"), F.col("entry_path")))
    out = out.unionByName(_lines(tops, F.col("path"), none, F.lit(0), F.concat(F.lit("# Tag: `"), "tag", F.lit("`")))).unionByName(_lines(tops, F.col("path"), none, F.lit(1), F.lit("")))
    at = F.lit("tags/index.md")
    counts = index.groupBy("tag").agg(F.count(F.lit(1)).alias("n_notes")).withColumn("path", T.tag_page_path(F.col("tag")))
    line = F.concat(F.lit("- [`"), "tag", F.lit("`]("), T.relative_link(at, F.col("path")), F.lit(") ("), F.col("n_notes").cast("string"), F.lit(")"))
    return out.unionByName(_lines(counts, at, F.array("tag"), F.lit(0), line)).unionByName(head_of(notes.sparkSession, "tags/index.md", "# Tags", ""))


def directory_lines(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Of the _index.md of each directory above entry pages: counts, directories below with their first titles, and notes."""
    leaves = pages.where("kind in ('h2leaf', 'h3leaf')")
    titles = pages.where("kind = 'entry'").select("source_path", "entry_path", "title")
    # entry pages stand in a directory of their own, so directories above them are those of the sources, below fragments/
    roll = indexes.directory_rollup(notes.select("source_path"), leaves)
    place = lambda d: F.concat_ws("/", F.lit("fragments"), F.nullif(d, F.lit("")))
    roll = kept(roll.withColumn("place", place(F.col("dir"))).withColumn("path", F.concat("place", F.lit("/_index.md"))), "directories")
    s = lambda c: F.col(c).cast("string")
    none = F.array().cast("array<string>")
    tops = [F.concat(F.lit("# "), "place"), F.lit(""), F.lit("## Summary"), F.lit(""), F.concat(F.lit("- Notes: "), s("n_notes"), F.lit(" (recursive)")), F.concat(F.lit("- Fragments: "), s("n_fragments"), F.lit(" (recursive)")), F.concat(F.lit("- Subdirectories: "), s("n_subdirs")), F.lit("")]
    out = _lines(roll.select("path", F.posexplode(F.array(*tops)).alias("n", "line")), F.col("path"), none, F.col("n"), F.col("line"))
    has = roll.where("n_subdirs > 0")
    for k, text in (("1", "## Subdirectories"), ("3", "## Directory Preview")):
        out = out.unionByName(_lines(has, F.col("path"), F.array(F.lit(k)), F.lit(-2), F.lit(text))).unionByName(_lines(has, F.col("path"), F.array(F.lit(k)), F.lit(-1), F.lit(""))).unionByName(_lines(has, F.col("path"), F.array(F.lit(k + "~")), F.lit(0), F.lit("")))
    below = roll.where("dir != ''").withColumn("name", F.substring_index("dir", "/", -1)).withColumn("up", F.concat(place(T.parent_of(F.col("dir"))), F.lit("/_index.md")))
    link = F.concat(F.lit("- ["), "name", F.lit("]("), "name", F.lit("/_index.md): "), s("n_notes"), F.lit(" notes"))
    out = out.unionByName(_lines(below, F.col("up"), F.array(F.lit("1"), F.col("name")), F.lit(0), link))
    out = out.unionByName(_lines(below, F.col("up"), F.array(F.lit("3"), F.col("name")), F.lit(0), F.concat(link, F.lit(", "), s("n_fragments"), F.lit(" fragments"))))
    first = first_titles_below(titles).join(below.select("dir", "up", "name"), "dir")
    out = out.unionByName(_lines(first, F.col("up"), F.array(F.lit("3"), F.col("name")), F.col("rank"), F.concat(F.lit("  - "), T.link_label(F.col("title")))))
    own = titles.withColumn("path", F.concat(place(T.parent_of(F.col("source_path"))), F.lit("/_index.md"))).withColumn("name", F.element_at(F.split("entry_path", "/"), -2))
    with_notes = roll.where("n_direct > 0")
    for at, text in ((-2, "## Notes"), (-1, "")):
        out = out.unionByName(_lines(with_notes, F.col("path"), F.array(F.lit("5")), F.lit(at), F.lit(text)))
    out = out.unionByName(_lines(with_notes, F.col("path"), F.array(F.lit("5~")), F.lit(0), F.lit("")))
    return out.unionByName(_lines(own, F.col("path"), F.array(F.lit("5"), F.col("name")), F.lit(0), F.concat(F.lit("- ["), T.link_label(F.col("title")), F.lit("]("), "name", F.lit("/index.md)"))))


def first_titles_below(titles: DataFrame, k: int = 3) -> DataFrame:
    """(dir, rank, title): the k first titles of all notes below each directory. Each directory's own first ones are found
    before they are spread over the directories above it."""
    rows = titles.select("title", "source_path", T.parent_of(F.col("source_path")).alias("own"))
    by = lambda key: Window.partitionBy(key).orderBy("title", "source_path")
    rows = rows.withColumn("nth", F.row_number().over(by("own"))).where(F.col("nth") <= k)
    chain = F.concat(T.ancestors(F.col("own")), F.array("own"))
    rows = rows.where("own != ''").select("title", "source_path", F.explode(F.array_distinct(chain)).alias("dir"))
    return rows.withColumn("rank", F.row_number().over(by("dir"))).where(F.col("rank") <= k).select("dir", "rank", "title")


def root_lines(title: str, summary: DataFrame, tops: DataFrame, preview: DataFrame, most: int = 12) -> DataFrame:
    """Of index.md: counts, the way to the indexes, the first directories and the first headings. summary: one row of
    `indexes.root_summary`; tops: `indexes.top_directories`; preview: (n, text) of at most `most` headings."""
    spark, at = summary.sparkSession, F.lit("index.md")
    none = lambda k: F.array(F.lit(k))
    names = (("Notes", "n_notes"), ("Fragments", "n_fragments"), ("Tags", "n_tags"), ("Unresolved links", "n_unresolved"))
    counts = F.array(F.lit(f"# {title}"), F.lit(""), F.lit("## Summary"), F.lit(""), *[F.concat(F.lit(f"- {n}: "), F.col(c).cast("string")) for n, c in names], F.lit(""))
    out = _lines(summary.select(F.posexplode(counts).alias("n", "line")), at, none("0"), F.col("n"), F.col("line"))
    # The pages that every output has, and what they are for.
    ways = (("Agent Guide", "agent/index.md", "how to read this output"), ("Page Catalog", "agent/pages/index.md", "all pages with sources and sizes"), ("Term Index", "agent/terms/index.md", "titles, headings, tags, files and link labels"), ("Notes", "fragments/_index.md", "notes by directory"), ("Headings", "headings/index.md", "headings of the first two levels"), ("Links", "links/index.md", "links from page to page"), ("Tags", "tags/index.md", "tags and their prefixes"), ("Unresolved", "_unresolved.md", "wikilinks that lead nowhere"))
    rows = [("## Sections", ""), *[(f"- [{n}]({p}): {why}", "") for n, p, why in ways]]
    fixed = [rows[0][0], "", *[x for x, _ in rows[1:]], "", "## Contents Preview", "", "### Notes", ""]
    out = out.unionByName(spark.createDataFrame([("index.md", ["1"], i, t) for i, t in enumerate(fixed)], LINES))
    s = lambda c: F.col(c).cast("string")
    ranked = tops.withColumn("own", F.when(F.col("top") == "(root)", 0).otherwise(1)).withColumn("n", F.row_number().over(Window.orderBy("own", "top")))  # a row for each top directory
    of = F.concat(F.lit(": "), s("n_notes"), F.lit(" notes, "), s("n_fragments"), F.lit(" fragments"))
    line = F.when(F.col("own") == 0, F.concat(F.lit("- Root notes"), of)).otherwise(F.concat(F.lit("- ["), "top", F.lit("](fragments/"), "top", F.lit("/_index.md)"), of))
    kept = F.when(F.col("own") == 0, F.lit(True)).otherwise(F.col("nth") <= most)
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("own").orderBy("top")))
    out = out.unionByName(_lines(ranked.where(kept), at, none("2"), F.col("n"), line))
    over = tops.where("top != '(root)'").agg((F.count(F.lit(1)) - most).alias("over")).where("over > 0")
    out = out.unionByName(_lines(over, at, none("3"), F.lit(0), F.format_string("- ... %d more directories", "over")))
    for i, t in enumerate(("", "### Headings Preview", "")):
        out = out.unionByName(spark.createDataFrame([("index.md", ["4"], i, t)], LINES))
    return out.unionByName(_lines(preview, at, none("5"), F.col("n"), F.concat(F.lit("- "), F.col("text"))))


def heading_preview(heads: DataFrame, most: int = 12) -> DataFrame:
    """(n, text): the first headings of the first two levels over all notes, by path and place."""
    first = heads.where("level <= 2").orderBy(F.split("source_path", "/"), "line_idx").limit(most)
    return first.select((F.row_number().over(Window.orderBy(F.split("source_path", "/"), "line_idx"))).alias("n"), "text")  # `most` rows


def documents(lines: DataFrame, most: int = INDEX_CHARS, page: int = PAGE_CHARS) -> DataFrame:
    """(path, body) of index documents from their lines. One of over `most` characters is cut into pages, greedily by lines, and
    its own page lists these; no task gathers more than a page."""
    rows = lines.withColumn("size", (F.length("line") + 1).cast("long"))
    sizes = rows.groupBy("path").agg(F.sum("size").alias("chars"))
    long_ = kept(sizes.where(F.col("chars") > most).select("path"), "long-indexes")
    short = rows.join(long_, "path", "left_anti")
    whole = joined(short, ["path"], [F.col("k"), F.col("n")], F.col("line")).select("path", F.concat("body", F.lit("\n")).alias("body"))
    cut = rows.join(long_, "path", "left_semi")
    placed = indexes.packed(cut, ["path"], ["k", "n"], "size", page, carry=["line"])
    return whole if long_.isEmpty() else whole.unionByName(_paged(kept(placed, "index-pages")))


def _paged(placed: DataFrame) -> DataFrame:
    """Pages (path, k, n, line, page_no) as (path, body), and the page that lists them."""
    number = T.page_number(F.col("page_no") + 1)
    stem = F.when(F.substring_index("path", "/", -1) == "index.md", F.regexp_replace("path", r"index\.md$", "")).otherwise(F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit("-")))
    name = F.concat(stem, F.lit("page-"), number, F.lit(".md"))
    title = F.when(F.col("path") == "headings/index.md", "Headings").when(F.col("path") == "links/index.md", "Links").otherwise(F.col("path"))
    texts = joined(placed, ["path", "page_no"], [F.col("k"), F.col("n")], F.col("line"))
    texts = texts.select("path", "page_no", name.alias("page"), title.alias("title"), F.concat("body", F.lit("\n")).alias("text"))
    pages = texts.select(F.col("page").alias("path"), F.concat(F.lit("# "), "title", F.lit(" "), (F.col("page_no") + 1).cast("string"), F.lit("\n\n"), "text").alias("body"))
    found = texts.withColumn("x", indexes.page_summary(F.col("text")))
    line = F.concat(F.lit("- [Page "), (F.col("page_no") + 1).cast("string"), F.lit("]("), F.substring_index("page", "/", -1), F.lit("): "), F.col("x.n").cast("string"), F.lit(" entries, `"), "x.first", F.lit("` ... `"), "x.last", F.lit("`"))
    listed = joined(found, ["path", "title"], [F.col("page_no")], line)
    n = texts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    manifest = listed.join(n, "path").select("path", F.concat(F.lit("# "), "title", F.lit("\n\n- Paged index pages: `"), F.col("n").cast("string"), F.lit("`\n"), "body", F.lit("\n")).alias("body"))
    return pages.unionByName(manifest)


# ---------------------------------------------------------------- metadata

META = ("split_reason", "byte_ranges", "line_ranges", "children", "tags", "outgoing")


def metadata_block(rows: DataFrame) -> DataFrame:
    """(path, body) of rows (path, kind, title, source, parent, prev, next): the metadata of a page as YAML, keys in fixed order,
    empty ones left out. What of heading_level, chars and META is there comes too."""
    scalar = lambda c: T.yaml_scalar(T.markdown_path(F.col(c)))
    one = lambda key, value, there: F.when(there, F.concat(F.lit(f"  {key}: "), value))
    many = lambda key, c, show: F.when(F.size(c) > 0, F.concat(F.lit(f"  {key}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("    - "), show(x))), "\n")))
    there = set(rows.columns)
    parts: list[Column] = [F.lit("---\npage_meta:"), F.concat(F.lit("  page_kind: "), "kind"), F.concat(F.lit("  title: "), T.yaml_scalar(F.col("title")))]
    parts.append(one("source", scalar("source"), F.col("source") != ""))
    if "chars" in there:
        parts.insert(1, F.lit("  schema_version: 1"))
        parts.insert(3, F.concat(F.lit("  output_path: "), scalar("path")))
        parts.append(many("section_path", F.split("path", "/"), T.yaml_scalar))
        parts += [one("heading_level", F.col("heading_level").cast("string"), F.col("heading_level").isNotNull()), one("split_reason", F.col("split_reason"), F.col("split_reason").isNotNull()), F.concat(F.lit("  char_count: "), F.col("chars").cast("string"))]
        pair = lambda x: F.concat(F.lit("["), x["first"].cast("string"), F.lit(", "), x["last"].cast("string"), F.lit("]"))
        parts += [many("byte_ranges", F.col("byte_ranges"), pair), many("line_ranges", F.col("line_ranges"), pair)]
    parts += [one(k, scalar(k), F.col(k) != "") for k in ("parent", "prev", "next")]
    if "chars" in there:
        quoted = lambda x: T.yaml_scalar(T.markdown_path(x))
        parts += [many("children", F.col("children"), quoted), many("tags", F.col("tags"), T.yaml_scalar), many("outgoing_links", F.col("outgoing"), quoted)]
        parts.append(F.concat(F.lit("  backlinks_count: "), F.col("backlinks_count").cast("string")))
    return rows.select("path", F.concat(F.array_join(F.array_compact(F.array(*parts)), "\n"), F.lit("\n---\n")).alias("body"))
