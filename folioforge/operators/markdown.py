"""Lines, fences, headings, sections and pages of notes (source_path, ..., body)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as FM
from ..functions import text as T

RESPLIT_LINES = 300
FENCE = r"^(?U)\s*(```|~~~)"
HEADING = r"^(?U)\s*(#{1,6})(?: (.*))?$"


def lines(notes: DataFrame, *keep: str) -> DataFrame:
    """A row for each line: (source_path, *keep, line_idx, line, fenced), line_idx from 0; a fence mark counts as fenced."""
    rows = notes.select("source_path", *keep, F.posexplode(F.split("body", "\n")).alias("line_idx", "line"))
    mark = F.col("line").rlike(FENCE)
    before = Window.partitionBy("source_path").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.sum(F.when(mark, 1).otherwise(0)).over(before)
    return rows.withColumn("fenced", mark | (opened % 2 == 1)).withColumn("line_idx", F.col("line_idx").cast("long"))


def heading_text(rest) -> F.Column:
    return T.trim(F.regexp_replace(T.trim(rest), "#+$", ""))


def headings(notes: DataFrame, *keep: str) -> DataFrame:
    """(source_path, *keep, line_idx, level, text) of headings outside fences.

    Only lines that can be a heading or a fence are numbered against each other; the others are dropped before the window.
    """
    rows = notes.select("source_path", *keep, F.posexplode(F.split("body", "\n")).alias("line_idx", "line"))
    mark = F.col("line").rlike(FENCE)
    rows = rows.where(mark | F.col("line").rlike(HEADING))
    before = Window.partitionBy("source_path").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("opened", F.sum(F.when(mark, 1).otherwise(0)).over(before)).where(~mark & (F.col("opened") % 2 == 0))
    return rows.select("source_path", *keep, F.col("line_idx").cast("long").alias("line_idx"), F.length(F.regexp_extract("line", HEADING, 1)).cast("long").alias("level"), heading_text(F.coalesce(F.regexp_extract("line", HEADING, 2), F.lit(""))).alias("text"))


def is_fragmented(notes: DataFrame):
    """Whether a note is cut into pages, unless it says not to."""
    return F.coalesce(F.col("fragment"), F.lit(True)) if "fragment" in notes.columns else F.lit(True)


def sections(notes: DataFrame, resplit: int = RESPLIT_LINES, heads: DataFrame | None = None) -> DataFrame:
    """Second-level sections of notes that are cut: (source_path, sec, line_idx, end_idx, text, n_h3, first_h3, is_shell), by the
    next such heading or the end."""
    size = notes.where(is_fragmented(notes)).select("source_path", F.size(F.split("body", "\n")).cast("long").alias("n_lines"))
    marks = (headings(notes) if heads is None else heads).where("level in (2, 3)").join(size, "source_path")
    by_note = Window.partitionBy("source_path").orderBy("line_idx")
    marks = marks.withColumn("sec", F.sum(F.when(F.col("level") == 2, 1).otherwise(0)).over(by_note.rowsBetween(Window.unboundedPreceding, 0)))
    third = F.when(F.col("level") == 3, F.col("line_idx"))
    grouped = marks.where("sec > 0").groupBy("source_path", "sec", "n_lines").agg(
        F.min("line_idx").alias("line_idx"), F.min_by("text", "line_idx").alias("text"), F.count(third).cast("long").alias("n_h3"), F.min(third).alias("first_h3")
    )
    end = F.lead("line_idx").over(by_note)
    out = grouped.withColumn("end_idx", F.coalesce(end, F.col("n_lines")))
    shell = (F.col("end_idx") - F.col("line_idx") - 1 > resplit) & (F.col("n_h3") >= 2)
    return out.select("source_path", F.col("sec").cast("long").alias("sec"), "line_idx", "end_idx", "text", "n_h3", "first_h3", shell.alias("is_shell"))


def counter_slugs(rows: DataFrame, scope: list[str], order: str, text: str = "text", default: str = "section") -> DataFrame:
    """Adds `slug`: of equal slugs within a scope the second gets -1, the third -2, ..."""
    rows = FM.normalised(rows, text, "_plain").withColumn("_base", T.slug_or(F.col("_plain"), default)).drop("_plain")
    nth = F.row_number().over(Window.partitionBy(*scope, "_base").orderBy(order)) - 1
    return rows.withColumn("slug", F.when(nth == 0, F.col("_base")).otherwise(F.concat_ws("-", "_base", nth.cast("string")))).drop("_base")


def probing_slugs(rows: DataFrame, scope: list[str], order: str, text: str = "text", default: str = "section") -> DataFrame:
    """Adds `slug`, as `counter_slugs`, but a suffix is also passed over where a slug within the scope has it already."""
    rows = FM.normalised(rows, text, "_plain").withColumn("_base", T.slug_or(F.col("_plain"), default)).drop("_plain")
    return unused_names(rows, scope, order, "_base", "slug").drop("_base")


def unused_names(rows: DataFrame, scope: list[str], order: str, base: str, out: str, extension: str = "") -> DataFrame:
    """Adds `out`: the base name, or else the first of base-1, base-2, ... that none before it in the scope has; an extension
    comes last.

    A fold over each scope's names that are not alone: a name whose base no other name of the scope begins with is free.
    """
    bare = F.regexp_replace(F.col(base), r"(-\d+)+$", "")  # names can only collide where these are equal
    rows = rows.withColumn("_root", bare)
    listed = rows.groupBy(*scope, "_root").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(base).alias("base")))).alias("l"))
    start = F.struct(F.array().cast("array<string>").alias("used"))

    def step(state, x):
        free = F.filter(
            F.concat(F.array(x["base"]), F.transform(F.sequence(F.lit(1), F.size(state["used"]) + 1), lambda k: F.concat_ws("-", x["base"], k.cast("string")))),
            lambda y: ~F.array_contains(state["used"], y),
        )
        return F.struct(F.concat(state["used"], F.array(F.element_at(free, 1))).alias("used"))

    given = F.when(F.size("l") == 1, F.transform("l", lambda x: x["base"])).otherwise(F.aggregate("l", start, step, lambda s: s["used"]))
    found = listed.select(*scope, "_root", F.explode(F.arrays_zip(F.transform("l", lambda x: x["at"]).alias("at"), given.alias("name"))).alias("x"))
    found = found.select(*scope, "_root", F.col("x.at").alias(order), F.concat(F.col("x.name"), F.lit(extension)).alias(out))
    return rows.join(found, [*scope, "_root", order]).drop("_root")


def pages(notes: DataFrame, resplit: int = RESPLIT_LINES, heads: DataFrame | None = None) -> DataFrame:
    """(output_path, entry_path, source_path, ord, kind, title, slug, above, first, last): entry, then leaves, or a shell and its
    third-level leaves. A page has its note's lines from first to before last; above is the page it hangs on."""
    heads = headings(notes) if heads is None else heads
    cut = sections(notes, resplit, heads)
    size = notes.select("source_path", "entry_path", F.size(F.split("body", "\n")).cast("long").alias("n_lines"))
    none = F.lit(None).cast("string")
    titled = size.join(titles(notes, heads), "source_path").join(cut.groupBy("source_path").agg(F.min("line_idx").alias("first_h2")), "source_path", "left")
    entry = titled.select(
        F.col("entry_path").alias("output_path"), "entry_path", "source_path", F.lit(-1).cast("long").alias("ord"), F.lit("entry").alias("kind"), "title",
        none.alias("slug"), none.alias("above"), F.lit(0).cast("long").alias("first"), F.coalesce("first_h2", "n_lines").alias("last"),
    )
    second = probing_slugs(cut, ["source_path"], "line_idx").join(notes.select("source_path", "entry_path", "entry_dir"), "source_path")
    leaf = F.concat(F.col("entry_dir"), F.lit("/"), F.col("slug"), F.when(F.col("is_shell"), F.lit("/index.md")).otherwise(F.lit(".md")))
    two = second.select(
        leaf.alias("output_path"), "entry_path", "source_path", F.col("line_idx").alias("ord"), F.when(F.col("is_shell"), F.lit("shell")).otherwise(F.lit("h2leaf")).alias("kind"), F.col("text").alias("title"),
        "slug", F.col("entry_path").alias("above"), F.col("line_idx").alias("first"), F.when(F.col("is_shell"), F.col("first_h3")).otherwise(F.col("end_idx")).alias("last"),
    )
    shells = second.where("is_shell").select("source_path", "entry_path", F.concat_ws("/", "entry_dir", "slug").alias("dir"), F.col("line_idx").alias("lo"), F.col("end_idx").alias("hi"))
    third = heads.where("level = 3").join(shells, "source_path").where("line_idx > lo and line_idx < hi")
    third = probing_slugs(third, ["source_path", "lo"], "line_idx")
    end = F.coalesce(F.lead("line_idx").over(Window.partitionBy("source_path", "lo").orderBy("line_idx")), F.col("hi"))
    three = third.select(
        F.concat(F.col("dir"), F.lit("/"), F.col("slug"), F.lit(".md")).alias("output_path"), "entry_path", "source_path", F.col("line_idx").alias("ord"), F.lit("h3leaf").alias("kind"), F.col("text").alias("title"),
        "slug", F.concat(F.col("dir"), F.lit("/index.md")).alias("above"), F.col("line_idx").alias("first"), end.alias("last"),
    )
    return entry.unionByName(two).unionByName(three)


def page_bodies(notes: DataFrame, found: DataFrame) -> DataFrame:
    """The pages found, with their lines as `raw`."""
    all_ = F.split("body", "\n")
    rows = found.join(notes.select("source_path", "body"), "source_path")
    return rows.select(*found.columns, F.array_join(F.slice(all_, (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")), "\n").alias("raw"))


def titles(notes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(source_path, title): the given title, else the first first-level heading, else the stem."""
    first = (headings(notes) if heads is None else heads).where("level = 1").groupBy("source_path").agg(F.min_by("text", "line_idx").alias("h1"))
    return notes.select("source_path", "fm_title", "stem").join(first, "source_path", "left").select("source_path", F.coalesce("fm_title", F.nullif("h1", F.lit("")), "stem").alias("title"))


def navigation(found: DataFrame) -> DataFrame:
    """(output_path, parent, prev, next) of all pages but entries. Neighbours are the pages that hang on the same page; a shell
    has a parent alone."""
    siblings = Window.partitionBy("above").orderBy("ord")
    rows = found.where("kind != 'entry'").withColumn("before", F.lag("output_path").over(siblings)).withColumn("after", F.lead("output_path").over(siblings))
    leaf = F.col("kind") != "shell"
    return rows.select("output_path", F.col("above").alias("parent"), F.when(leaf, F.col("before")).alias("prev"), F.when(leaf, F.col("after")).alias("next"))


def section_bodies(notes: DataFrame, resplit: int = RESPLIT_LINES) -> DataFrame:
    """(source_path, line_idx, body) of each second-level section, its heading line included."""
    rows = sections(notes, resplit).join(notes.select("source_path", F.split("body", "\n").alias("all")), "source_path")
    return rows.select("source_path", "line_idx", F.array_join(F.slice("all", (F.col("line_idx") + 1).cast("int"), (F.col("end_idx") - F.col("line_idx")).cast("int")), "\n").alias("body"))


def first_paragraph(notes: DataFrame) -> DataFrame:
    """(source_path, paragraph): the first island of text lines, joined by spaces."""
    rows = lines(notes).withColumn("is_text", ~F.col("fenced") & (T.trim(F.col("line")) != "") & ~F.col("line").rlike(HEADING))
    by_note = Window.partitionBy("source_path").orderBy("line_idx")
    rows = rows.withColumn("breaks", F.sum(F.when(F.col("is_text"), 0).otherwise(1)).over(by_note.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("is_text")
    first = rows.groupBy("source_path").agg(F.min("breaks").alias("breaks"))
    rows = rows.join(first, ["source_path", "breaks"])
    return rows.groupBy("source_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", T.trim(F.col("line")).alias("t")))), lambda x: x["t"]), " ").alias("paragraph"))


def section_extents(notes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(source_path, line_idx, level, text, end_idx): a section ends at the next heading of its level or above it.

    The nearest such heading is the least over one running minimum for each level, so no heading is joined to another.
    """
    size = notes.select("source_path", F.size(F.split("body", "\n")).cast("long").alias("n_lines"))
    rows = (headings(notes) if heads is None else heads).join(size, "source_path")
    after = Window.partitionBy("source_path").orderBy("line_idx").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") == k, F.col("line_idx"))).over(after) for k in range(1, 7)]
    rows = rows.select("source_path", "line_idx", "level", "text", "n_lines", F.array(*nexts).alias("nexts"))
    end = F.array_min(F.slice("nexts", F.lit(1), F.col("level").cast("int")))
    return rows.select("source_path", "line_idx", "level", "text", F.coalesce(end, F.col("n_lines")).alias("end_idx"))


def page_plan(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page_id, page_kind, output_path, source_path, section_path, parent, prev, next, n_chars) of pages, ways relative to the
    page. bodies: `page_bodies`."""
    nav = navigation(found)
    near = lambda c: F.when(F.col(c).isNotNull(), T.relative_link(F.col("output_path"), F.col(c)))
    up = found.select(F.col("output_path").alias("above"), F.col("title").alias("above_title"), F.col("kind").alias("above_kind"))
    notes = found.where("kind = 'entry'").select("source_path", F.col("title").alias("note_title"))
    rows = found.join(nav, "output_path", "left").join(up, "above", "left").join(notes, "source_path").join(bodies.select("output_path", F.length("raw").cast("long").alias("n_chars")), "output_path")
    path = F.array_compact(F.array(F.col("note_title"), F.when(F.col("above_kind") == "shell", F.col("above_title")), F.when(F.col("kind") != "entry", F.col("title"))))
    tail = F.when(F.col("kind") == "entry", "entry").when(F.col("kind") == "shell", F.concat("slug", F.lit(":shell"))).when(F.col("above_kind") == "shell", F.concat(F.element_at(F.split("above", "/"), -2), F.lit(":"), "slug")).otherwise(F.col("slug"))
    kind = F.when(F.col("kind").isin("h2leaf", "h3leaf"), "leaf").otherwise(F.col("kind"))
    return rows.select(F.concat("entry_path", F.lit(":"), tail).alias("page_id"), kind.alias("page_kind"), "output_path", "source_path", F.array_join(path, " > ").alias("section_path"), near("parent").alias("parent"), near("prev").alias("prev"), near("next").alias("next"), "n_chars")
