"""Links between pages: extraction, name resolution with tie-breaks, the page graph, related notes."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as FM
from ..functions import text as T
from ..sources.tables import kept
from . import markdown

WIKILINK = r"(!?)\[\[([^\[\]\n]+)\]\]"
MDLINK = r"\[([^\]\n]+)\]\(([^)\s]+)\)"
ANYLINK = r"!?\[\[[^\[\]\n]+\]\]|\[[^\]\n]+\]\([^)\s]+\)"
TOP_RELATED, LEAST_SHARED, MAX_TAGS, MAX_TASKS = 3, 2, 10, 10_000


def bodies(notes: DataFrame, resplit: int = markdown.RESPLIT_LINES, found: DataFrame | None = None) -> DataFrame:
    """Pages with their raw text, in which what stands in code or comments no longer looks like a wikilink."""
    found = markdown.pages(notes, resplit) if found is None else found
    return FM.with_shields(markdown.page_bodies(notes, found), "raw")


def page_links(shielded: DataFrame) -> DataFrame:
    """(output_path, entry_path, source_path, at, raw): all links of each page in order, wikilinks and Markdown links."""
    return shielded.select("output_path", "entry_path", "source_path", F.posexplode(F.regexp_extract_all("raw", F.lit(f"({ANYLINK})"), F.lit(1))).alias("at", "raw"))


def wikilinks(found: DataFrame) -> DataFrame:
    """Of page links the wikilinks: (output_path, entry_path, source_path, at, raw, embed, target, heading, alias)."""
    rows = found.where(F.col("raw").rlike(r"^!?\[\[")).withColumn("inner", F.regexp_extract("raw", WIKILINK, 2))
    name = F.substring_index("inner", "|", 1)
    after = lambda c, mark: F.when(F.instr(c, mark) > 0, T.trim(F.substring(c, F.instr(c, mark) + 1, F.length(c))))
    return rows.select("output_path", "entry_path", "source_path", "at", "raw", F.col("raw").startswith("!").alias("embed"), T.trim(F.substring_index(name, "#", 1)).alias("target"), after(name, "#").alias("heading"), after(F.col("inner"), "|").alias("alias"))


def markdown_links(found: DataFrame) -> DataFrame:
    """Of page links those to Markdown files or headings: (output_path, entry_path, source_path, at, raw, label, target)."""
    rows = found.where(~F.col("raw").rlike(r"^!?\[\["))
    rows = rows.select("output_path", "entry_path", "source_path", "at", "raw", F.regexp_extract("raw", MDLINK, 1).alias("label"), F.regexp_extract("raw", MDLINK, 2).alias("target"))
    return rows.where(T.is_markdown_target(F.col("target")) & ~T.is_external(F.col("target")))


def names(notes: DataFrame) -> DataFrame:
    """(name, prio, note_path, note_entry): aliases and given titles (0) before stems (1)."""
    named = notes.select(F.explode(F.concat("aliases", F.when(F.col("fm_title").isNotNull(), F.array("fm_title")).otherwise(F.array().cast("array<string>")))).alias("name"), F.lit(0).alias("prio"), F.col("source_path").alias("note_path"), F.col("entry_path").alias("note_entry"))
    stems = notes.select(F.col("stem").alias("name"), F.lit(1).alias("prio"), F.col("source_path").alias("note_path"), F.col("entry_path").alias("note_entry"))
    return named.union(stems)


def best_names(notes: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (name, from_dir) -> (name, from_dir, note_entry): of the notes that have the name by the better kind, one in the
    asking directory (the first by source path), else the one with the shallowest, then first entry.

    Common names have many notes and many askers, so notes are never paired with askers: the best of each name, and the best
    of each name and directory, are found by aggregation and joined.
    """
    have = names(notes)
    kind = have.groupBy("name").agg(F.min("prio").alias("prio"))
    have = have.join(kind, ["name", "prio"])
    parts = F.split("note_entry", "/")
    anywhere = have.groupBy("name").agg(F.min(F.struct(F.size(parts).alias("depth"), parts.alias("parts"), F.col("note_entry").alias("entry"))).alias("b")).select("name", F.col("b.entry").alias("any_entry"))
    near = have.groupBy("name", T.source_dir_of(F.col("note_entry")).alias("from_dir")).agg(F.min(F.struct(F.split("note_path", "/").alias("parts"), F.col("note_entry").alias("entry"))).alias("b")).select("name", "from_dir", F.col("b.entry").alias("near_entry"))
    found = asks.select("name", "from_dir").distinct().join(anywhere, "name").join(near, ["name", "from_dir"], "left")
    return found.select("name", "from_dir", F.coalesce("near_entry", "any_entry").alias("note_entry"))


def targets(notes: DataFrame, found: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(note_entry, slug, dst, anchor): what a heading link can lead to. Of a note that is cut into pages, the page of each
    second-level section by its slug; of another, the entry page and the anchors of its second-level headings."""
    cut = found.where("kind in ('h2leaf', 'shell')").select(F.col("entry_path").alias("note_entry"), "slug", F.col("output_path").alias("dst"), F.lit(None).cast("string").alias("anchor"))
    whole = notes.join(found.where("kind in ('h2leaf', 'shell')").select("source_path").distinct(), "source_path", "left_anti").select("source_path", F.col("entry_path").alias("note_entry"))
    rows = (markdown.headings(notes) if heads is None else heads).where("level = 2").join(whole, "source_path")
    anchors = markdown.counter_slugs(rows, ["note_entry"], "line_idx", default="").select("note_entry", "slug", F.col("note_entry").alias("dst"), F.col("slug").alias("anchor"))
    return cut.unionByName(anchors.distinct())


def _with_heading(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (..., heading, note_entry) with status (entry, page, anchor or missing), dst and anchor."""
    rows = FM.normalised(rows, "heading", "plain").withColumn("slug", T.slugify(F.col("plain"))).drop("plain")
    rows = rows.join(goals.withColumnRenamed("dst", "goal"), ["note_entry", "slug"], "left")
    dst = F.when(F.col("heading").isNull(), F.col("note_entry")).otherwise(F.col("goal"))
    status = F.when(dst.isNull(), "missing").when(F.col("heading").isNull(), "entry").when(F.col("anchor").isNull(), "page").otherwise("anchor")
    return rows.withColumn("status", status).withColumn("dst", dst).drop("goal", "slug", "note_entry")


def resolve(notes: DataFrame, wiki: DataFrame, goals: DataFrame) -> DataFrame:
    """Wikilinks with status, dst (a page) and anchor; only second-level headings resolve."""
    links = wiki.withColumn("from_dir", T.source_dir_of(F.col("entry_path")))
    asks = links.select(F.col("target").alias("name"), "from_dir")
    found = links.join(best_names(notes, asks).withColumnRenamed("name", "target"), ["target", "from_dir"], "left").drop("from_dir")
    return _with_heading(found, goals)


def resolve_markdown(notes: DataFrame, md: DataFrame, goals: DataFrame) -> DataFrame:
    """Markdown links with status, dst and anchor, by normalised source path; a bare heading is one of the link's own note."""
    file = F.split_part("target", F.lit("#"), F.lit(1))
    after = F.when(F.instr("target", "#") > 0, F.substring(F.col("target"), F.instr("target", "#") + 1, F.length("target")))
    path = F.when(file == "", F.col("source_path")).otherwise(T.normalize_path(F.concat_ws("/", T.parent_of(F.col("source_path")), file)))
    have = notes.select(F.col("source_path").alias("path"), F.col("entry_path").alias("note_entry"))
    return _with_heading(md.withColumn("heading", after).withColumn("path", path).join(have, "path", "left").drop("path"), goals)


def unresolved(resolved: DataFrame) -> DataFrame:
    """Wikilinks that lead nowhere: (output_path, source_path, at, target, heading, alias)."""
    return resolved.where("status = 'missing'").select("output_path", "source_path", "at", "target", "heading", "alias")


def edges(notes: DataFrame, resolved: DataFrame, md: DataFrame) -> DataFrame:
    """(src, dst, first_ord): related entries, then wikilinks in reverse order, then Markdown links, of each page; no self links,
    each pair once, at its first place."""
    related = related_entries(notes).select(F.col("entry_path").alias("src"), "dst", F.struct(F.lit(0).alias("a"), F.col("rank").alias("b")).alias("o"))
    wiki = resolved.where("dst is not null").select(F.col("output_path").alias("src"), "dst", F.struct(F.lit(1).alias("a"), (-F.col("at")).cast("long").alias("b")).alias("o"))
    other = md.where("dst is not null").select(F.col("output_path").alias("src"), "dst", F.struct(F.lit(2).alias("a"), F.col("at").cast("long").alias("b")).alias("o"))
    rows = related.union(wiki).union(other).where("src != dst")
    return rows.groupBy("src", "dst").agg(F.min("o").alias("o")).withColumn("first_ord", (F.row_number().over(Window.partitionBy("src").orderBy("o", "dst")) - 1).cast("long")).drop("o")


def backlinks(edges: DataFrame) -> DataFrame:
    """(dst, src, n): a row for each link into a page, and how many pages link to it. Hot pages stay spread over rows."""
    n = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_src"))
    return edges.join(n, "dst").select("dst", "src", "n_src")


def related_entries(notes: DataFrame) -> DataFrame:
    """(source_path, entry_path, rank, dst) of the related list: an exact entry path, else the best note of the value without
    its last extension."""
    rows = notes.select("source_path", "entry_path", F.posexplode("related").alias("rank", "value")).withColumn("rank", F.col("rank").cast("long"))
    rows = rows.withColumn("name", T.stem_of(F.col("value"))).withColumn("from_dir", T.source_dir_of(F.col("entry_path")))
    exact = notes.select(F.col("entry_path").alias("value"), F.col("entry_path").alias("same"))
    found = rows.join(exact, "value", "left").join(best_names(notes, rows), ["name", "from_dir"], "left")
    return found.select("source_path", "entry_path", "rank", F.coalesce("same", "note_entry").alias("dst")).where("dst is not null")


def shared_tags(notes: DataFrame, least: int = LEAST_SHARED, block: int = 1024, deal: int = 16, group: int = 8192) -> DataFrame:
    """(a, b, n_shared): pairs of notes, a before b, with at least `least` raw tags in common.

    Notes of the same tags are gathered in blocks, so tags are compared once for two blocks and each row is made once. Blocks
    meet by pairs of tags, not by a tag: two that share two tags share a pair of them, so common tags alone pair nobody. A pair
    of tags that many blocks have is dealt out as pairs of `deal` blocks. Pairs of blocks travel as numbers: blocks lie in groups
    of about `group` notes, two groups meet once with their notes, and all their pairs of blocks read them there.
    """
    if least < 2:
        raise ValueError("pairs need two shared tags at least")
    tags = notes.select("entry_path", F.array_sort(F.array_distinct("tags")).alias("tags")).where(F.size("tags") >= least)
    size = tags.groupBy("tags").agg(F.count(F.lit(1)).alias("n_notes"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    size = kept(size, "tag-sets")
    tasks = max(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), notes.sparkSession.sparkContext.defaultParallelism)
    n_notes = size.agg(F.sum("n_notes")).first()[0] or 1
    n_groups = max(ceil(n_notes / group), min(ceil(n_notes / block), ceil(sqrt(8 * tasks))))
    blocks = tags.join(size, "tags").withColumn("part", F.pmod(F.xxhash64("entry_path"), F.col("n")).cast("int"))
    blocks = blocks.groupBy("tags", "part").agg(F.array_sort(F.collect_list("entry_path")).alias("members"))
    blocks = blocks.withColumn("g", F.pmod(F.xxhash64("tags", "part"), F.lit(n_groups)).cast("int"))
    blocks = kept(blocks.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("tags", "part"))), "tag-blocks")
    both = F.flatten(F.transform("tags", lambda x: F.transform(F.filter("tags", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    rows = blocks.select(F.struct("g", "at").alias("block"), "tags", F.explode(both).alias("k"))
    deals = rows.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / deal).cast("int").alias("nb"))
    rows = rows.join(deals, "k").withColumn("own", F.pmod(F.xxhash64("block"), F.col("nb")).cast("int"))
    left = rows.select("k", F.col("block").alias("l"), F.col("tags").alias("tl"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("nb") - 1)).alias("j"))
    right = rows.select("k", F.col("block").alias("r"), F.col("tags").alias("tr"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"))
    met = left.join(right, ["k", "i", "j"]).where("i < j or l <= r")
    common = F.array_intersect("tl", "tr")
    # the least pair of shared tags stands for the pair of blocks
    met = met.where((F.col("k.x") == F.element_at(common, 1)) & (F.col("k.y") == F.element_at(common, 2)))
    met = met.select(F.size(common).cast("long").alias("n_shared"), F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).where(F.col("n_shared") >= least)
    cell = lambda g, h: (F.shiftright(h * (h + 1), 1) + g).alias("cell")
    met = met.select(cell(F.col("l.g"), F.col("r.g")), F.col("l.at").alias("l"), F.col("r.at").alias("r"), (F.col("l") == F.col("r")).alias("same"), "n_shared")
    # each two groups have a task of their own: its notes are few enough for a dictionary where the rows are written
    n_cells = n_groups * (n_groups + 1) // 2
    there = lambda df: df.repartitionById(min(n_cells, MAX_TASKS), F.col("cell")).hint("merge")
    groups = blocks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "members"))).alias("blocks")).select("g", F.col("blocks.members").alias("lists"))
    lefts = groups.select(F.col("lists").alias("bl"), "g", F.explode(F.sequence("g", F.lit(n_groups - 1))).alias("h")).select(cell(F.col("g"), F.col("h")), "bl")
    rights = groups.select(F.col("lists").alias("br"), "g", F.explode(F.sequence(F.lit(0), "g")).alias("h")).select(cell(F.col("h"), F.col("g")), "br")
    # the lists meet first, so they are not copied for each pair of blocks
    met = there(met).join(there(lefts).join(there(rights), "cell"), "cell")
    met = met.select("n_shared", "same", F.element_at("bl", F.col("l")).alias("xs"), F.element_at("br", F.col("r")).alias("ys"))
    # members are sorted: most pairs of blocks have rows one way only
    one, other = F.struct("xs", "ys"), F.struct(F.col("ys").alias("xs"), F.col("xs").alias("ys"))
    ways = met.select("n_shared", F.explode(F.when(F.col("same"), F.array(one)).otherwise(F.array(one, other))).alias("w"))
    ways = ways.select("n_shared", "w.xs", "w.ys").where(F.element_at("xs", 1) < F.element_at("ys", -1))
    pairs = ways.select("n_shared", "ys", F.explode("xs").alias("a")).select("a", F.explode("ys").alias("b"), "n_shared")
    return pairs.where("a < b")


def top_related(notes: DataFrame, top: int = TOP_RELATED) -> DataFrame:
    """(src, dst, rank, why, n_shared): all related entries first, then up to `top` more by shared tags, then path.

    No pairs are listed: notes are grouped by every subset of two or more of their tags, each group keeps its first notes by
    path, and a note picks among the groups of its own subsets. Whoever is not among the first of the group of all shared
    tags has enough notes before it. Notes with over MAX_TAGS tags have too many subsets and are paired instead.
    """
    explicit = related_entries(notes).groupBy(F.col("entry_path").alias("src"), "dst").agg(F.min("rank").alias("rank")).where("src != dst")
    most = explicit.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    keep = top + int(most) + 1
    tags = notes.select("entry_path", F.array_sort(F.array_distinct("tags")).alias("tags")).where(F.size("tags") >= LEAST_SHARED)
    few = tags.where(F.size("tags") <= MAX_TAGS)
    masks = F.filter(F.sequence(F.lit(0), F.expr("cast(shiftleft(1, size(tags)) - 1 as int)")), lambda m: F.bit_count(m) >= LEAST_SHARED)
    subsets = F.expr("transform(masks, m -> filter(tags, (x, i) -> getbit(m, i) = 1))")
    rows = few.withColumn("masks", masks).select("entry_path", "tags", F.explode(subsets).alias("k"))
    parts = F.struct(F.split("entry_path", "/").alias("parts"), F.col("entry_path").alias("entry"), F.col("tags"))
    first = Window.partitionBy("k", "salt").orderBy(F.split("entry_path", "/"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("entry_path"), F.lit(32))).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= keep)
    heads = salted.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(parts)), 1, keep).alias("heads"))
    met = rows.select("k", F.col("entry_path").alias("src"), F.col("tags").alias("own")).join(heads, "k").select("src", "own", F.explode("heads").alias("h"))
    both = met.select("src", F.col("h.entry").alias("dst"), F.size(F.array_intersect("own", "h.tags")).cast("long").alias("n_shared"))
    wide = tags.where(F.size("tags") > MAX_TAGS)
    if not wide.isEmpty():
        names = wide.select("entry_path")
        shared = shared_tags(notes)
        shared = shared.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n_shared").union(shared.select(F.col("b").alias("src"), F.col("a").alias("dst"), "n_shared"))
        some = shared.join(names.withColumnRenamed("entry_path", "src"), "src", "left_semi").union(shared.join(names.withColumnRenamed("entry_path", "dst"), "dst", "left_semi").select("src", "dst", "n_shared"))
        both = both.union(some)
    rest = both.where("src != dst").distinct().join(explicit.select("src", "dst"), ["src", "dst"], "left_anti")
    rest = rest.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n_shared"), F.split("dst", "/"))).cast("long")).where(F.col("rank") <= top)
    none = F.lit(None).cast("long")
    return explicit.select("src", "dst", "rank", F.lit("related").alias("why"), none.alias("n_shared")).union(rest.select("src", "dst", "rank", F.lit("tags").alias("why"), "n_shared"))
