"""Retrieval: schema packs, field evidence, candidate pages, and the budgeted evidence pack."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as FM
from ..functions import text as T

DEFAULT_BUDGET = 20_000


@dataclass(frozen=True)
class Section:
    title: str
    fields: tuple[str, ...] = ()
    kind: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Recipe:
    title: str | None
    sections: tuple[Section, ...]
    budget: int | None = None


@dataclass(frozen=True)
class SchemaPack:
    """Declared fields (name -> label and sources) and context recipes (task -> sections)."""

    id: str
    version: int
    fields: dict[str, tuple[str | None, tuple[tuple[str, str], ...]]]  # label, sources as (kind, key)
    contexts: dict[str, Recipe] = field(default_factory=dict)

    @staticmethod
    def load(text: str) -> SchemaPack:
        """From YAML; raises ValueError for what a pack must not be."""
        import yaml

        raw = yaml.safe_load(text) or {}
        fields = {}
        for name, x in (raw.get("fields") or {}).items():
            sources = tuple((k, s[k]) for s in x.get("sources") or [] for k in ("frontmatter", "heading") if s.get(k))
            fields[name] = (x.get("label"), sources)
        contexts = {}
        for task, x in (raw.get("contexts") or {}).items():
            sections = tuple(Section(s.get("title", ""), tuple(s.get("fields") or ()), s.get("kind"), bool(s.get("required"))) for s in x.get("sections") or [])
            contexts[task] = Recipe(x.get("title"), sections, x.get("default_budget_chars"))
        out = SchemaPack(str(raw.get("id") or ""), raw.get("version"), fields, contexts)
        out.check()
        return out

    def check(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(bool(self.id.strip()), "a schema needs an id")
        need(self.version == 1, "the schema version must be 1")
        need(bool(self.fields), "a schema needs fields")
        need(bool(self.contexts), "a schema needs contexts")
        for name, (_, sources) in self.fields.items():
            need(bool(sources), f"field {name} needs sources")
        for task, recipe in self.contexts.items():
            need(bool(recipe.sections), f"context {task} needs sections")
            for s in recipe.sections:
                need(s.kind == "sources" or bool(s.fields), f"section {s.title} of {task} needs fields")
                for f in s.fields:
                    need(f in self.fields, f"section {s.title} of {task} names {f}, which is no field")

    def label(self, name: str) -> str:
        return self.fields[name][0] or name


def heading_evidence(notes: DataFrame, wanted: dict[str, str], offset: str | None = None) -> DataFrame:
    """(field, generated_path, source_path, line_start, line_end, text) of the first section under an exact heading text.

    wanted: field -> heading. Any level counts and fences don't matter; the section ends at the next heading of its level or
    above. Blank edges are trimmed and empty sections give nothing. Lines count from 1, from the start of the file where
    offset names a column with the lines before the body.
    """
    # a final empty line is none
    body = F.split(F.regexp_replace("body", r"\n\z", ""), "\n")
    rows = notes.select("source_path", "entry_path", body.alias("all"), (F.col(offset) if offset else F.lit(0)).cast("long").alias("off"))
    each = rows.select("source_path", F.posexplode("all").alias("i", "line"), F.size("all").alias("n"))
    pattern = r"^(?U)\s*(#{1,6}) (.*)$"
    heads = each.where(F.col("line").rlike(pattern)).select("source_path", "i", "n", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), T.trim(F.regexp_replace(T.trim(F.regexp_extract("line", pattern, 2)), "#+$", "")).alias("text"))
    after = Window.partitionBy("source_path").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    nexts = F.array(*[F.min(F.when(F.col("level") == k, F.col("i"))).over(after) for k in range(1, 7)])
    heads = heads.withColumn("nexts", nexts).withColumn("end", F.coalesce(F.array_min(F.slice("nexts", F.lit(1), F.col("level"))), F.col("n")))
    first = heads.where(F.col("text").isin(*set(wanted.values()))).groupBy("source_path", F.col("text").alias("heading")).agg(F.min(F.struct("i", "end")).alias("x"))
    found = first.join(rows, "source_path").select("source_path", "entry_path", "heading", "off", F.col("x.i").alias("i"), F.slice("all", F.col("x.i") + 2, F.greatest(F.col("x.end") - F.col("x.i") - 1, F.lit(0))).alias("part"))
    solid = F.filter(F.transform("part", lambda x, k: F.when(T.trim(x) != "", k)), lambda k: k.isNotNull())
    found = found.withColumn("solid", solid).where(F.size("solid") > 0).withColumn("a", F.array_min("solid")).withColumn("b", F.array_max("solid"))
    text = T.trim(F.array_join(F.slice("part", F.col("a") + 1, F.col("b") - F.col("a") + 1), "\n"))
    start, end = F.col("i") + 2 + F.col("a") + F.col("off"), F.col("i") + 2 + F.col("b") + F.col("off")
    names = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(h).alias("heading")) for f, h in sorted(wanted.items())]))
    found = found.select("source_path", F.col("entry_path").alias("generated_path"), "heading", start.cast("long").alias("line_start"), end.cast("long").alias("line_end"), text.alias("text"))
    return found.withColumn("want", names).where("want.heading = heading").select(F.col("want.field").alias("field"), "generated_path", "source_path", "line_start", "line_end", "text")


def front_matter_evidence(files: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """As `heading_evidence`, from YAML paths of files (source_path, entry_path, content, fm_line_end)."""
    rows = files.withColumn("json", FM.yaml_json("content")).where(F.col("json").isNotNull())
    out = None
    for name, path in sorted(wanted.items()):
        one = rows.select(F.lit(name).alias("field"), F.col("entry_path").alias("generated_path"), "source_path", F.lit(1).cast("long").alias("line_start"), F.col("fm_line_end").cast("long").alias("line_end"), FM.yaml_field(path)("json").alias("text")).where(F.col("text").isNotNull())
        out = one if out is None else out.union(one)
    return out


def evidence(notes: DataFrame, schema: SchemaPack) -> DataFrame:
    """(field, generated_path, source_path, line_start, line_end, text) of all fields of a schema over notes; notes without a
    front matter (content, fm_line_end) give what their headings have. A field may name several headings or paths."""
    out = notes.sparkSession.createDataFrame([], "field string, generated_path string, source_path string, line_start long, line_end long, text string")
    of_files = "content" in notes.columns
    turn = 0
    while True:  # the sources of a field of each kind one after another
        some = {k: {f: [key for kind, key in sources if kind == k][turn : turn + 1] for f, (_, sources) in schema.fields.items()} for k in ("heading", "frontmatter")}
        wanted = {k: {f: x[0] for f, x in v.items() if x} for k, v in some.items()}
        if not any(wanted.values()):
            return out
        if wanted["heading"]:
            out = out.unionByName(heading_evidence(notes, wanted["heading"], "fm_line_end" if of_files else None))
        if wanted["frontmatter"] and of_files:
            out = out.unionByName(front_matter_evidence(notes, wanted["frontmatter"]))
        turn += 1


def catalog(notes: DataFrame, pages: DataFrame, titles: DataFrame, heads: DataFrame) -> DataFrame:
    """(generated_path, entry_path, source_path, title, kind, entities, tags, headings): pages with their note's attributes."""
    texts = heads.groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]).alias("headings"))
    given = F.when(F.col("fm_title").isNotNull(), F.array("fm_title")).otherwise(F.array().cast("array<string>"))
    rows = notes.join(titles.withColumnRenamed("title", "note_title"), "source_path").join(texts, "source_path", "left")
    entities = F.array_sort(F.array_distinct(F.concat(F.array("note_title"), given, "aliases", "tags")))
    rows = rows.select("source_path", entities.alias("entities"), "tags", F.coalesce("headings", F.array().cast("array<string>")).alias("headings"))
    return pages.join(rows, "source_path").select(F.col("output_path").alias("generated_path"), "entry_path", "source_path", "title", "kind", "entities", "tags", "headings")


def matches_text(needle: str) -> F.Column:
    q = needle.lower()
    return F.lower("title").contains(q) | F.exists(F.concat("entities", "tags", "headings"), lambda x: F.lower(x).contains(q))


def candidates(cat: DataFrame, edges: DataFrame, evidence: DataFrame, fields: list[str], entities: list[str], query: str | None = None, time: str | None = None) -> DataFrame:
    """(generated_path, priority, in_scope): pages by entity (0), neighbours of these (1), pages with a wanted field (2), text
    matches of query (3) and time (4); each page once, by its least priority. In scope: what a selector has found, or
    everything where there is no selector."""
    spark = cat.sparkSession
    parts = []
    if entities:
        wanted = F.array(*[F.lit(x) for x in entities])
        hit = cat.where(F.arrays_overlap(F.concat("entities", "tags"), wanted)).select("generated_path")
        both = edges.select(F.col("src").alias("generated_path"), F.col("dst").alias("n")).union(edges.select(F.col("dst").alias("generated_path"), F.col("src").alias("n")))
        near = both.join(hit, "generated_path", "left_semi").select(F.col("n").alias("generated_path")).distinct().join(cat.select("generated_path"), "generated_path", "left_semi")
        parts += [hit.select("generated_path", F.lit(0).alias("priority"), F.lit(True).alias("hit")), near.select("generated_path", F.lit(1).alias("priority"), F.lit(True).alias("hit"))]
    have = evidence.where(F.col("field").isin(*fields)).select("generated_path").distinct()
    parts.append(have.select("generated_path", F.lit(2).alias("priority"), F.lit(False).alias("hit")))
    for needle, priority in ((query, 3), (time, 4)):
        if needle is not None:
            by_field = evidence.where(F.lower("text").contains(needle.lower())).select("generated_path").distinct()
            found = cat.where(matches_text(needle)).select("generated_path").union(by_field).distinct()
            parts.append(found.select("generated_path", F.lit(priority).alias("priority"), F.lit(True).alias("hit")))
    rows = parts[0] if parts else spark.createDataFrame([], "generated_path string, priority int, hit boolean")
    for x in parts[1:]:
        rows = rows.unionByName(x)
    open_ = not (entities or query is not None or time is not None)
    return rows.groupBy("generated_path").agg(F.min("priority").cast("long").alias("priority"), (F.bool_or("hit") | F.lit(open_)).alias("in_scope"))


def missing_required(found: DataFrame, evidence: DataFrame, sections: list[tuple[str, str]]) -> DataFrame:
    """(section, field) of required sections (title, field) without evidence on any page in scope."""
    want = found.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field")) for s, f in sections])).alias("x")).select("x.section", "x.field")
    have = evidence.join(found.where("in_scope").select("generated_path"), "generated_path", "left_semi").select("field").distinct()
    return want.join(have, "field", "left_anti").select("section", "field")


def source_trail(found: DataFrame, evidence: DataFrame, fields: list[str]) -> DataFrame:
    """(line): a distinct citation for each evidence of the wanted fields on a candidate page."""
    rows = evidence.where(F.col("field").isin(*fields)).join(found.select("generated_path"), "generated_path", "left_semi")
    line = F.concat(F.lit("- `"), "generated_path", F.lit("` from `"), "source_path", F.lit("` lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(" ("), "field", F.lit(")"))
    return rows.select(line.alias("line")).distinct()


def within_budget(lines: DataFrame, budget: int) -> DataFrame:
    """(line, used): lines in order while their running length fits.

    A line has one character and its break at least, so no more than budget / 2 lines can fit: these are the only ones that are
    brought into one order, by a top-k that each task takes part in.
    """
    first = lines.orderBy("line").limit(budget // 2 + 1).withColumn("n", (F.length("line") + 1).cast("long"))
    used = F.sum("n").over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return first.select("line", used.alias("used")).where(F.col("used") <= budget)


def enforce_budget(pack: str, budget: int) -> str:
    """Cuts a pack that is beyond its budget: header, missing evidence where it fits, a note, and as much of the trail as fits;
    ever shorter forms where even that is too long."""
    if len(pack) <= budget:
        return pack
    head, mark, trail = pack.partition("\n## Source Trail\n\n")
    mark = "\n## Source Trail\n\n"
    at = head.find("\n## ")
    prefix, rest = (head, "") if at < 0 else (head[:at], head[at:])
    note, cut = "\n\nOmitted due to budget.\n", "- Omitted due to budget.\n"
    out = prefix
    lost = rest.find("\n## Missing Required Evidence")
    if lost >= 0:
        end = rest.find("\n## ", lost + 4)
        section = rest[lost : end if end >= 0 else len(rest)]
        if len(out) + len(section) + len(note) + len(mark) + len(cut) <= budget:
            out += section
    out += note + mark
    if len(out) + len(cut) > budget:
        return _floor(prefix, budget)
    lines, taken = trail.splitlines(), 0
    for line in lines:
        if len(out) + len(line) + 1 + len(cut) > budget:
            break
        out += line + "\n"
        taken += 1
    return out if 0 < taken == len(lines) else out + cut


def _floor(prefix: str, budget: int) -> str:
    title = next((x for x in prefix.splitlines() if x.startswith("# ")), "# Context")
    head = f"---\ncontext:\n  budget_chars: {budget}\n---\n"
    bare = "---\ncontext: {}\n---\n## Source Trail\n"
    for form in (f"{head}{title}\n\n## Source Trail\n", f"{head}## Source Trail\n", bare):
        if len(form) <= budget:
            return form
    return bare[:budget]


def context_pack(cat: DataFrame, edges: DataFrame, evidence: DataFrame, schema: SchemaPack, task: str, entities: list[str] | None = None, query: str | None = None, time: str | None = None, budget: int | None = None) -> str:
    """The evidence pack of one request, as text.

    What reaches the driver is bounded by the budget: a pack that is beyond it has no evidence at all, so of each section and of
    the trail so many rows are enough as would fill it, and whether one is beyond it is seen from these."""
    if task not in schema.contexts:
        raise ValueError(f"{task} is no context of the schema")
    recipe, entities = schema.contexts[task], entities or []
    limit = budget or recipe.budget or DEFAULT_BUDGET
    fields = sorted({f for s in recipe.sections for f in s.fields})
    found = candidates(cat, edges, evidence, fields, entities, query, time)
    order = ["priority", "generated_path", "field", "line_start", "line_end", "text"]
    most = limit // 20 + 2  # a line of evidence or of the trail is longer than 20 characters
    wanted = evidence.where(F.col("field").isin(*fields)).join(found, "generated_path").persist()
    rows = wanted.orderBy(*order).limit(most).select("field", "generated_path", "source_path", "line_start", "line_end", T.compact_line(F.col("text")).alias("short")).collect()
    scoped = {r.field for r in wanted.where("in_scope").select("field").distinct().collect()}  # fields of the schema
    by_field: dict[str, list] = {}
    for r in rows:
        by_field.setdefault(r.field, []).append(r)
    lines = [f"---\ncontext:\n  schema_id: {schema.id}\n  schema_version: {schema.version}\n  task: {task}\n  budget_chars: {limit}"]
    if entities:
        lines.append("  entities:\n" + "\n".join(f"  - {e}" for e in entities))
    lines += [f"  {k}: {v}" for k, v in (("query", query), ("time", time)) if v is not None]
    pack = "\n".join(lines) + f"\n---\n# {recipe.title or task}\n"
    trail, missing = set(), []
    for s in recipe.sections:
        if s.kind == "sources":
            continue
        body = ""
        for f in s.fields:
            items = by_field.get(f, [])
            if s.required and f not in scoped:
                missing.append(f"- `{f}` for section `{s.title}`\n")
            for r in items:
                trail.add(f"- `{r.generated_path}` from `{r.source_path}` lines {r.line_start}-{r.line_end} ({f})")
                body += f"- `{r.generated_path}` lines {r.line_start}-{r.line_end}: {r.short}\n"
        if body:
            pack += f"\n## {s.title}\n\n{body}"
    if len(rows) < most:
        rest = found.join(wanted.select("generated_path").distinct(), "generated_path", "left_anti").join(cat.select("generated_path", "source_path"), "generated_path")
        line = F.concat(F.lit("- `"), "generated_path", F.lit("` from `"), "source_path", F.lit("`"))
        trail |= {r.line for r in rest.select(line.alias("line")).distinct().orderBy("line").limit(most).collect()}
    else:  # beyond the budget: the first lines of the whole trail are wanted, not those of the first evidence
        cited_lines = source_trail(found, evidence, fields)
        rest = found.join(wanted.select("generated_path").distinct(), "generated_path", "left_anti").join(cat.select("generated_path", "source_path"), "generated_path")
        line = F.concat(F.lit("- `"), "generated_path", F.lit("` from `"), "source_path", F.lit("`"))
        trail = {r.line for r in cited_lines.unionByName(rest.select(line.alias("line")).distinct()).orderBy("line").limit(most).collect()}
    wanted.unpersist()
    if missing:
        pack += "\n## Missing Required Evidence\n\n" + "".join(missing)
    pack += "\n## Source Trail\n\n" + ("".join(x + "\n" for x in sorted(trail)) or "- No sources matched.\n")
    return enforce_budget(pack, limit)
