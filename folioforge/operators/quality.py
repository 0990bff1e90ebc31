"""Data-quality checks of a compiled corpus: each is one aggregate or anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PAGE_LIMIT, ROUTE_STEPS = 40_000, 5


def corpus_metrics(rows: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """One row of (path, body): pages, bytes, longest page, pages beyond the limit."""
    n = F.length("body")
    return rows.agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0).cast("long")).alias("n_bytes"), F.coalesce(F.max(n).cast("long"), F.lit(0).cast("long")).alias("max_chars"), F.count_if(n > limit).alias("n_oversized"))


def oversized(rows: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    return rows.where(F.length("body") > limit).select("path", F.length("body").cast("long").alias("n_chars"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links (path, target) whose normalised target is not among pages (path)."""
    file = F.split_part("target", F.lit("#"), F.lit(1))
    rows = links.withColumn("goal", T.normalize_path(F.concat_ws("/", F.nullif(T.parent_of(F.col("path")), F.lit("")), file)))
    return rows.join(pages.select(F.col("path").alias("goal")), "goal", "left_anti").select("path", "target", "goal")


def nav_violations(nav: DataFrame, pages: DataFrame) -> DataFrame:
    """(output_path, problem): the parent is no page, or the next page doesn't point back."""
    lone = nav.join(pages.select(F.col("output_path").alias("parent")).distinct(), "parent", "left_anti").select("output_path", F.lit("parent").alias("problem"))
    back = nav.select(F.col("output_path").alias("next"), F.col("prev").alias("back"))
    cut = nav.where(F.col("next").isNotNull()).join(back, "next", "left").where(~F.col("back").eqNullSafe(F.col("output_path"))).select("output_path", F.lit("next").alias("problem"))
    return lone.union(cut)


def duplicates_and_gaps(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, problem): pages that the catalog misses or lists twice."""
    gaps = pages.select("path").join(catalog.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("problem"))
    return gaps.union(catalog.groupBy("path").count().where("count > 1").select("path", F.lit("repeated").alias("problem")))


def absent(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Of the wanted keys those that are not there: required pages, terms or markers."""
    return wanted.select(key).join(have.select(key), key, "left_anti")


def marker_check(rows: DataFrame, markers: list[str]) -> DataFrame:
    """(marker, found): whether any body holds it."""
    out = rows.agg(*[F.bool_or(F.col("body").contains(m)).alias(f"m{i}") for i, m in enumerate(markers)])
    return out.select(F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.coalesce(F.col(f"m{i}"), F.lit(False)).alias("found")) for i, m in enumerate(markers)])).alias("x")).select("x.marker", "x.found")


def reachable_routes(routes: DataFrame, edges: DataFrame, most: int = ROUTE_STEPS) -> DataFrame:
    """(route, n_steps, ok): routes (route, step, src, dst) all of whose steps are edges, at most `most` of them."""
    met = routes.join(edges.select("src", "dst").distinct().withColumn("there", F.lit(True)), ["src", "dst"], "left")
    return met.groupBy("route").agg(F.count(F.lit(1)).alias("n_steps"), F.bool_and(F.coalesce("there", F.lit(False))).alias("all_there")).select("route", "n_steps", (F.col("all_there") & (F.col("n_steps") <= most)).alias("ok"))


def weighted_score(checks: DataFrame) -> DataFrame:
    """checks (name, points, passed) -> score out of all points, as a percentage, and whether all passed."""
    return checks.agg((100 * F.sum(F.when(F.col("passed"), F.col("points")).otherwise(0.0)) / F.sum("points")).alias("score"), F.bool_and("passed").alias("all_passed"))


# ---------------------------------------------------------------- gates over a compiled tree: pages (path, body)

# The pages that every tree has, the routes that its guide names, and what a metadata block holds.
ENTRY_POINTS = ("agent/index.md", "fragments/_index.md", "headings/index.md", "links/index.md", "tags/index.md", "_unresolved.md")
ROUTE_NAMES = ("agent/terms/", "headings/", "tags/", "links/", "_unresolved.md", "agent/pages/")
META_KEYS = ("  schema_version: 1\n", "  page_kind: ", "  output_path: ", "  char_count: ")
LEAF_KEYS = ("  source: ", "  line_ranges:")


def _one(pages: DataFrame, path: str, passed) -> DataFrame:
    """(passed) of a condition on one page's body; false where there is no such page."""
    return pages.where(F.col("path") == path).agg(F.coalesce(F.bool_or(passed), F.lit(False)).alias("passed"))


def _all(rows: DataFrame, passed) -> DataFrame:
    """(passed) of a condition on all rows, of which there must be one at least."""
    return rows.agg(F.coalesce(F.bool_and(passed), F.lit(False)).alias("passed"))


def _holds(body, parts) -> F.Column:
    out = F.lit(True)
    for x in parts:
        out = out & body.contains(x)
    return out


def entry_points(pages: DataFrame) -> DataFrame:
    """(passed): the root names all entry points, and they exist."""
    named = pages.where("path = 'index.md'").where(_holds(F.col("body"), ENTRY_POINTS)).select(F.lit("index.md").alias("path"))
    there = pages.where(F.col("path").isin(*ENTRY_POINTS)).select("path").union(named)
    return there.agg((F.countDistinct("path") == len(ENTRY_POINTS) + 1).alias("passed"))


def terms_listed(pages: DataFrame, wanted: list[str]) -> DataFrame:
    """(passed): every wanted term is somewhere in the term index."""
    index = pages.where(F.col("path").startswith("agent/terms/")).select(F.lower("body").alias("body"))
    return marker_check(index, [x.lower() for x in wanted]).agg(F.bool_and("found").alias("passed"))


def routes_named(pages: DataFrame) -> DataFrame:
    """(passed): the guide names every route, and says not to read everything."""
    return _one(pages, "agent/index.md", _holds(F.col("body"), (*ROUTE_NAMES, "Do not read every leaf page")))


def metadata_present(pages: DataFrame) -> DataFrame:
    return _all(pages, F.col("body").startswith("---\npage_meta:\n") & _holds(F.col("body"), META_KEYS))


def traceable(pages: DataFrame) -> DataFrame:
    """(passed): every leaf names its source and lines."""
    return _all(pages.where(F.col("body").contains("  page_kind: leaf\n")), _holds(F.col("body"), LEAF_KEYS))


def forced_splits(leaves: DataFrame, expected: DataFrame, limit: int = 30_000) -> DataFrame:
    """(doc_id, passed): whether all leaves (doc_id, split_reason, n_chars) are cut for the expected reason (doc_id, reason), and
    none is beyond the limit."""
    rows = expected.join(leaves, "doc_id", "left")
    return rows.groupBy("doc_id").agg(F.bool_and(F.coalesce((F.col("split_reason") == F.col("reason")) & (F.col("n_chars") <= limit), F.lit(False))).alias("passed"))


def index_budget(pages: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """(passed): all pages of indexes are within the limit."""
    own = F.col("path").rlike("^(agent|headings|links|tags)/") | (F.col("path") == "_unresolved.md") | F.col("path").rlike("(^|/)_index[^/]*$")
    return _all(pages.where(own), F.length("body") <= limit)


def wikilink_residue(pages: DataFrame) -> DataFrame:
    """(path, n): raw wikilinks that pages still hold, the list of unresolved ones apart."""
    n = T.occurrences(F.col("body"), "[[")
    return pages.where(~F.col("path").startswith("_unresolved")).select("path", n.alias("n")).where("n > 0")


def navigation_lines(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(path): expected pages (path) without a navigation line that a rule follows."""
    good = pages.where(F.col("body").rlike(r"(?m)^> Parent: [^\n]*\n---$")).select("path")
    return expected.select("path").join(good, "path", "left_anti")


def relations(pages: DataFrame, linked: DataFrame, related: DataFrame, points: float = 15.0) -> DataFrame:
    """(points): half for all wanted backlinks (path, link), half for all wanted related notes (path, link)."""
    wanted = linked.withColumn("part", F.lit("## Backlinks")).unionByName(related.withColumn("part", F.lit("## Related")))
    met = wanted.join(pages, "path", "left").select("part", F.coalesce(F.contains(F.col("body"), F.col("part")) & F.contains(F.col("body"), F.col("link")), F.lit(False)).alias("ok"))
    return met.groupBy("part").agg(F.bool_and("ok").alias("ok")).agg(F.coalesce(F.sum(F.when(F.col("ok"), points / 2).otherwise(0.0)), F.lit(0.0)).alias("points"))


def tree_heading_lines(tree: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_path, line_idx, line): a line of a heading index for each section of a tree. entries: (source_path, entry_path)."""
    rows = tree.join(entries, "source_path")
    return rows.select("source_path", "line_idx", F.concat(F.lit("- ["), "id", F.lit("](../"), "entry_path", F.lit(")")).alias("line"))


def repaired(leaves: DataFrame) -> DataFrame:
    """leaves (..., split_reason, text) with code fenced anew and table headers repeated, so that each leaf can be read alone."""
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    code = F.filter(lines, lambda x: ~F.ltrim(x).startswith("```") & ~x.startswith("# "))
    rows = F.filter(lines, lambda x: T.trim(x).startswith("|") & ~x.contains("---") & ~T.trim(x).contains(" id "))
    closed = lambda c: F.when(F.size(c) > 0, F.concat(F.array_join(c, "\n"), F.lit("\n"))).otherwise("")
    text = F.when(F.col("split_reason") == "code_fence", F.concat(F.lit("```text\n"), closed(code), F.lit("```\n"))).when(F.col("split_reason") == "table", F.concat(F.lit("| id | value |\n|---|---|\n"), closed(rows))).otherwise(F.col("text"))
    return leaves.withColumn("text", text)


FIXTURES = {
    "headings": lambda i: F.concat(F.lit("## Chapter "), i, F.lit("\n\n### Topic "), i, F.lit("\nmarker-headings-"), i, F.lit("\n")),
    "no_heading": lambda i: F.concat(F.lit("paragraph marker-no-heading-"), i, F.lit(" of plain text.\n")),
    "single_line": lambda i: F.concat(F.lit("single-line-marker-"), i, F.lit("-")),
    "code": lambda i: F.concat(F.lit("code-marker-"), i, F.lit("=value-"), i),
    "table": lambda i: F.concat(F.lit("| "), i, F.lit(" | table-marker-"), i, F.lit(" |")),
    "links": lambda i: F.concat(F.lit("see [[target-"), i, F.lit("]] marker-links-"), i),
}
TOPS = {"code": "# Code\n\n```text", "table": "# Table\n\n| id | value |\n|---|---|", "links": "# Links\n"}


def fixture(spark, kind: str, n: int) -> DataFrame:
    """(n, line): the lines of a synthetic large note of a kind, n units after its head; the text depends on nothing else."""
    units = spark.range(n).select((F.col("id") + 1).alias("n"), FIXTURES[kind](F.col("id").cast("string")).alias("line"))
    return spark.createDataFrame([(0, "---\ntitle: Large Fixture\n---\n" + TOPS.get(kind, ""))], "n long, line string").unionByName(units)


def gate(checks: dict[str, tuple[float, DataFrame]]) -> DataFrame:
    """(name, points, passed) of named checks, each with its points and a row (passed); `weighted_score` adds them up."""
    out = None
    for name, (points, found) in checks.items():
        row = found.select(F.lit(name).alias("name"), F.lit(points).alias("points"), "passed")
        out = row if out is None else out.unionByName(row)
    return out


def write_report(checks: DataFrame, path: str) -> None:
    """A machine-readable report: a JSON line for each check."""
    checks.coalesce(1).write.mode("overwrite").json(path)
