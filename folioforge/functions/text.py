"""Scalar text and path expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that slugs drop.
SLUG_DROPS = r"""[.,:;!?`'"()\[\]{}<>@#$%^&*+=|\\/~]"""
COMPACT_LIMIT = 220


def trim(c: Column) -> Column:
    """Strips white space of any kind, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def slugify(c: Column) -> Column:
    """Lower case, white space to dashes, punctuation and control characters dropped, dashes collapsed and trimmed.

    Compatibility characters should be normalised first where there are any (`frontmatter.nfkc`).
    """
    x = F.regexp_replace(F.lower(c), r"(?U)\s", "-")
    x = F.regexp_replace(x, SLUG_DROPS, "")
    x = F.regexp_replace(x, r"\p{Cntrl}", "")
    x = F.regexp_replace(x, "-+", "-")
    return F.regexp_replace(x, "^-|-$", "")


def slug_or(c: Column, default: str) -> Column:
    x = slugify(c)
    return F.when(x == "", default).otherwise(x)


def sanitize_component(c: Column) -> Column:
    return F.regexp_replace(c, r'[<>:"|?*\\\p{Cntrl}]', "_")


def stem_of(path: Column) -> Column:
    """File name without its last extension; a name that starts with its only dot keeps it."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def parent_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def entry_dir(source_path: Column) -> Column:
    return F.concat_ws("/", F.lit("fragments"), F.nullif(parent_of(source_path), F.lit("")), stem_of(source_path))


def entry_path(source_path: Column) -> Column:
    return F.concat(entry_dir(source_path), F.lit("/index.md"))


def source_dir_of(entry: Column) -> Column:
    """The directory above an entry page's own."""
    parts = F.split(entry, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "/")


def top_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1)))


def tag_page_path(tag: Column) -> Column:
    parts = F.filter(F.split(tag, "/"), lambda x: trim(x) != "")
    return F.concat(F.lit("tags/"), F.array_join(F.transform(parts, lambda x: sanitize_component(trim(x))), "/"), F.lit(".md"))


def prefixes(path: Column, sep: str = "/") -> Column:
    """a/b/c -> [a, a/b, a/b/c]."""
    p = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), sep))


def ancestors(path: Column) -> Column:
    """The directories above a path, the root ('') first."""
    p = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))


def normalize_path(path: Column) -> Column:
    """Folds '.' and '..'; a leading '/' goes, and '..' at the top stays away."""
    start = F.array().cast("array<string>")

    def step(out: Column, x: Column) -> Column:
        return (
            F.when((x == ".") | (x == ""), out)
            .when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
            .otherwise(F.concat(out, F.array(x)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def relative_link(source: Column, target: Column) -> Column:
    """The link from page source to page target."""
    a, b = F.split(parent_of(source), "/"), F.split(target, "/")
    a = F.when(parent_of(source) == "", F.array().cast("array<string>")).otherwise(a)
    most = F.least(F.size(a), F.size(b) - 1)
    same = F.when(most <= 0, F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    )
    return F.concat(F.repeat(F.lit("../"), F.size(a) - same), F.array_join(F.slice(b, same + 1, F.size(b) - same), "/"))


def plain_link_label(c: Column) -> Column:
    return F.regexp_replace(c, r"!?\[([^\]\n]*)\]\([^)\n]+\)", "$1")


def _until_still(c: Column, pattern: str, replacement: str) -> Column:
    """regexp_replace again and again until nothing changes; each time takes a `](` away, so their number is enough."""
    turns = F.sequence(F.lit(1), F.greatest(occurrences(c, "]("), F.lit(1)))
    return F.aggregate(turns, c, lambda x, _: F.regexp_replace(x, pattern, replacement))


def link_label(c: Column) -> Column:
    """Readable text of a label: nested images and links flattened, tags stripped, brackets escaped."""
    x = _until_still(c, r"!\[([^\]\n]*)\]\([^)]+\)", "$1")
    x = _until_still(x, r"\[([^\]\n]+)\]\([^)]+\)", "$1")
    x = F.regexp_replace(x, r"<[^>\n]+>", "")
    x = F.replace(F.replace(x, F.lit("[["), F.lit("[")), F.lit("]]"), F.lit("]"))
    x = F.replace(F.replace(x, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return squash(x)


def escape_table(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def yaml_scalar(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def markdown_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def compact_line(c: Column) -> Column:
    x = squash(c)
    return F.when(F.length(x) > COMPACT_LIMIT, F.concat(F.left(x, F.lit(COMPACT_LIMIT - 3)), F.lit("..."))).otherwise(x)


def source_page_stem(c: Column) -> Column:
    """A name for the catalog page of a source: without its extension, other characters than letters, digits and - as _."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(\.md)+$", ""), r"[^A-Za-z0-9-]+", "_"), "^_+|_+$", "")
    return F.when(x == "", "source").otherwise(x)


def metadata_value(body: Column, key: str) -> Column:
    """The value of an indented `key:` line of a page's metadata block."""
    found = F.regexp_extract(body, rf"(?m)^  {key}:(.*)$", 1)
    return F.when(body.rlike(rf"(?m)^  {key}:"), F.regexp_replace(trim(found), '^"|"$', ""))


def page_number(n: Column) -> Column:
    """001, 002, ..., 1000, ...: three digits at least."""
    return F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))


def strip_front_matter(body: Column) -> Column:
    return F.regexp_replace(body, r"\A---\n(?s:.*?)\n---\n", "")


def occurrences(body: Column, needle: str) -> Column:
    return ((F.length(body) - F.length(F.replace(body, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def is_markdown_target(c: Column) -> Column:
    return c.startswith("#") | F.split_part(c, F.lit("#"), F.lit(1)).endswith(".md")


def is_external(c: Column) -> Column:
    return F.lower(c).rlike(r"^(https?:|mailto:|//)")
