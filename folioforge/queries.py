"""Queries over the test tables, each with the SQL that an independent engine runs on the same tables.

The SQL builds the same note corpus by its own text; `CORPUS` and what follows are common table expressions that the
queries share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import compile as C
from .operators import incremental, indexes, large, links, markdown, quality, render, retrieval
from .sources import corpus

RESPLIT = 5  # lines, so that the short documents have shells
CHUNK = 2000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f, sql
        return f

    return put


def rows_of(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- shared SQL

CORPUS = r"""
WITH RECURSIVE d AS (SELECT doc_id AS i, text, lang, source, (SELECT count(*) FROM documents) AS n FROM documents),
q AS (SELECT doc_id AS i, min(quality) AS quality FROM labels GROUP BY 1),
base AS (SELECT d.*, q.quality, lang || '/' || source || CASE WHEN i % 10 = 3 THEN '/h' || i ELSE '' END AS dir,
  CASE WHEN i % 10 = 3 THEN 'hub' || (i % 7) ELSE 'n' || i END AS stem FROM d LEFT JOIN q USING (i)),
tl AS (SELECT i, n, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM base),
kinds AS (SELECT * FROM (VALUES (1, -7, '```'), (1, -6, '## not a heading [[n3]]'), (1, -5, '```'), (2, -7, '| a | b |'), (2, -6, '|---|---|'), (3, -7, '- item'), (3, -6, ''), (3, -5, '1. one')) v(m, o, line)),
bl AS (
  SELECT i, -9 AS o, '# Doc ' || i AS line FROM base
  UNION ALL SELECT i, -8, 'See [[n' || ((7 * i + 3) % n) || ']] and [[topic-' || (i % 97) || '|label ' || i || ']] or [[missing-' || (i % 17) || ']] at [[n' || ((5 * i + 1) % n) || '#Part 1]] and [file](../' || source || '/n' || ((i + 20) % n) || '.md).' FROM base
  UNION ALL SELECT i, o, line FROM base JOIN kinds ON i % 8 = m
  UNION ALL SELECT i, 2 * k, CASE WHEN i % 9 = 4 AND k = 0 THEN '## Part 1-1' ELSE '## Part ' || ((k // 4) % 3) END FROM tl WHERE k % 4 = 0
  UNION ALL SELECT i, 2 * k, '### Sub ' || CASE WHEN i % 6 = 2 THEN 0 ELSE k // 4 END FROM tl WHERE k % 4 = 2 OR (i % 6 = 2 AND k % 4 > 0)
  UNION ALL SELECT i, 2 * k, 'More `[[n1]]` <!-- [[n2]] --> [own](#Part 0) [far](../' || source || '/n' || ((i + 4) % n) || '.md#Part 1) [[n' || ((i + 4) % n) || '#Part 1-1]]' FROM tl WHERE k = 1 AND i % 7 = 0 AND i % 6 <> 2
  UNION ALL SELECT i, 2 * k + 1, t FROM tl),
bodies AS (SELECT i, string_agg(line, chr(10) ORDER BY o) AS body FROM bl GROUP BY i),
notes AS (SELECT i AS doc_id, dir || '/' || stem || '.md' AS source_path, 'fragments/' || dir || '/' || stem || '/index.md' AS entry_path,
  'fragments/' || dir || '/' || stem AS entry_dir, dir, stem, CASE WHEN i % 5 = 0 THEN 'Title ' || (i % 50) END AS fm_title,
  CASE WHEN i % 3 = 0 THEN ['topic-' || (i % 97)] ELSE [] END AS aliases,
  list_concat(['lang/' || lang, 'src/' || source, 'group/g' || (i % 13)], CASE WHEN quality IS NOT NULL THEN ['quality/' || quality] ELSE [] END) AS tags,
  CASE WHEN i % 11 = 0 THEN ['n' || ((i + 1) % n)] ELSE [] END AS related, i % 12 <> 5 AS cut, body FROM base JOIN bodies USING (i)),
raw_lines AS (SELECT source_path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_idx FROM notes),
lines AS (SELECT *, regexp_matches(line, '^[\s\p{Z}]*(```|~~~)') OR
  sum(CASE WHEN regexp_matches(line, '^[\s\p{Z}]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY source_path ORDER BY line_idx) % 2 = 1 AS fenced FROM raw_lines),
headings AS (SELECT source_path, line_idx, CAST(length(regexp_extract(line, '^[\s\p{Z}]*(#{1,6})(?: (.*))?$', 1)) AS BIGINT) AS level,
  trim(regexp_replace(trim(regexp_extract(line, '^[\s\p{Z}]*(#{1,6})(?: (.*))?$', 2)), '#+$', '')) AS text
  FROM lines WHERE NOT fenced AND regexp_matches(line, '^[\s\p{Z}]*(#{1,6})(?: (.*))?$')),
n_lines AS (SELECT source_path, count(*) AS n_lines FROM raw_lines GROUP BY 1),
h2 AS (SELECT h.source_path, line_idx, text, lead(line_idx) OVER (PARTITION BY h.source_path ORDER BY line_idx) AS nxt FROM headings h JOIN notes n ON n.source_path = h.source_path AND n.cut WHERE level = 2),
sections AS (SELECT h2.source_path, h2.line_idx, coalesce(nxt, n_lines) AS end_idx, h2.text,
  (SELECT count(*) FROM headings h WHERE h.source_path = h2.source_path AND h.level = 3 AND h.line_idx > h2.line_idx AND h.line_idx < coalesce(nxt, n_lines)) AS n_h3,
  (SELECT min(line_idx) FROM headings h WHERE h.source_path = h2.source_path AND h.level = 3 AND h.line_idx > h2.line_idx AND h.line_idx < coalesce(nxt, n_lines)) AS first_h3
  FROM h2 JOIN n_lines USING (source_path)),
shells AS (SELECT *, end_idx - line_idx - 1 > 5 AND n_h3 >= 2 AS is_shell FROM sections),
slugs AS (SELECT *, replace(lower(text), ' ', '-') AS base, row_number() OVER (PARTITION BY source_path ORDER BY line_idx) AS r FROM shells),
probe AS (SELECT source_path, r, base AS slug, [base] AS used FROM slugs WHERE r = 1
  UNION ALL SELECT source_path, r, slug, list_append(used, slug) FROM (
    SELECT s.source_path, s.r, p.used, CASE WHEN NOT list_contains(p.used, s.base) THEN s.base ELSE s.base || '-' || list_min(list_filter(range(1, len(p.used) + 2), lambda k: NOT list_contains(p.used, s.base || '-' || k))) END AS slug
    FROM probe p JOIN slugs s ON s.source_path = p.source_path AND s.r = p.r + 1)),
slugged AS (SELECT s.*, p.slug FROM slugs s JOIN probe p USING (source_path, r)),
titles AS (SELECT n.source_path, coalesce(fm_title, nullif(h1, ''), stem) AS title FROM notes n LEFT JOIN (SELECT source_path, arg_min(text, line_idx) AS h1 FROM headings WHERE level = 1 GROUP BY 1) USING (source_path)),
thirds AS (SELECT h.source_path, h.line_idx, h.text, s.slug AS above, s.end_idx, row_number() OVER (PARTITION BY h.source_path, s.line_idx, h.text ORDER BY h.line_idx) AS nth, lead(h.line_idx) OVER (PARTITION BY h.source_path, s.line_idx ORDER BY h.line_idx) AS nxt
  FROM headings h JOIN slugged s ON h.source_path = s.source_path AND s.is_shell AND h.level = 3 AND h.line_idx > s.line_idx AND h.line_idx < s.end_idx),
pages AS (
  SELECT entry_path AS output_path, entry_path, source_path, -1 AS ord, 'entry' AS kind, title, NULL AS slug, NULL AS above, 0 AS first, coalesce((SELECT min(line_idx) FROM sections s WHERE s.source_path = n.source_path), n_lines) AS last FROM notes n JOIN titles USING (source_path) JOIN n_lines USING (source_path)
  UNION ALL SELECT entry_dir || '/' || slug || CASE WHEN is_shell THEN '/index.md' ELSE '.md' END, entry_path, source_path, line_idx, CASE WHEN is_shell THEN 'shell' ELSE 'h2leaf' END, text, slug, entry_path, line_idx, CASE WHEN is_shell THEN first_h3 ELSE end_idx END FROM slugged JOIN notes USING (source_path)
  UNION ALL SELECT entry_dir || '/' || above || '/' || replace(lower(text), ' ', '-') || CASE WHEN nth = 1 THEN '' ELSE '-' || (nth - 1) END || '.md', entry_path, source_path, line_idx, 'h3leaf', text, replace(lower(text), ' ', '-') || CASE WHEN nth = 1 THEN '' ELSE '-' || (nth - 1) END, entry_dir || '/' || above || '/index.md', line_idx, coalesce(nxt, end_idx) FROM thirds JOIN notes USING (source_path)),
page_lines AS (SELECT p.output_path, p.entry_path, l.*, CASE WHEN fenced THEN '' ELSE regexp_replace(line, '`[^`]*`|<!--.*?-->', '', 'g') END AS clean FROM pages p JOIN lines l ON l.source_path = p.source_path AND l.line_idx >= p.first AND l.line_idx < p.last),
any_links AS (SELECT output_path, entry_path, source_path, raw, row_number() OVER (PARTITION BY output_path ORDER BY line_idx, pos) - 1 AS ord FROM (SELECT output_path, entry_path, source_path, line_idx,
  unnest(regexp_extract_all(clean, '!?\[\[[^\[\]\n]+\]\]|\[[^\]\n]+\]\([^)\s]+\)')) AS raw, generate_subscripts(regexp_extract_all(clean, '!?\[\[[^\[\]\n]+\]\]|\[[^\]\n]+\]\([^)\s]+\)'), 1) AS pos FROM page_lines)),
inner_links AS (SELECT *, starts_with(raw, '!') AS embed, regexp_extract(raw, '\[\[([^\[\]\n]+)\]\]', 1) AS x FROM any_links WHERE regexp_matches(raw, '^!?\[\[')),
wikilinks AS (SELECT output_path, source_path, entry_path, ord, embed, trim(split_part(split_part(x, '|', 1), '#', 1)) AS target,
  CASE WHEN contains(split_part(x, '|', 1), '#') THEN trim(substr(split_part(x, '|', 1), instr(split_part(x, '|', 1), '#') + 1)) END AS heading,
  CASE WHEN contains(x, '|') THEN trim(substr(x, instr(x, '|') + 1)) END AS alias FROM inner_links),
names AS (SELECT unnest(aliases) AS name, 0 AS prio, source_path AS note_path, entry_path AS note_entry FROM notes
  UNION ALL SELECT fm_title, 0, source_path, entry_path FROM notes WHERE fm_title IS NOT NULL
  UNION ALL SELECT stem, 1, source_path, entry_path FROM notes),
asks AS (SELECT DISTINCT target AS name, regexp_replace(entry_path, '/[^/]*/[^/]*$', '') AS from_dir FROM wikilinks
  UNION SELECT DISTINCT related[1], regexp_replace(entry_path, '/[^/]*/[^/]*$', '') FROM notes WHERE len(related) > 0),
best AS (SELECT name, from_dir, note_entry FROM (SELECT a.name, a.from_dir, m.note_entry, row_number() OVER (PARTITION BY a.name, a.from_dir
    ORDER BY m.prio, regexp_replace(m.note_entry, '/[^/]*/[^/]*$', '') = a.from_dir DESC,
    CASE WHEN regexp_replace(m.note_entry, '/[^/]*/[^/]*$', '') = a.from_dir THEN 0 ELSE len(string_split(m.note_entry, '/')) END,
    CASE WHEN regexp_replace(m.note_entry, '/[^/]*/[^/]*$', '') = a.from_dir THEN string_split(m.note_path, '/') ELSE string_split(m.note_entry, '/') END) AS r
  FROM asks a JOIN names m USING (name)) WHERE r = 1),
goals AS (SELECT entry_path AS note_entry, slug, output_path AS goal, CAST(NULL AS VARCHAR) AS anchor FROM pages WHERE kind IN ('h2leaf', 'shell')
  UNION ALL SELECT entry_path, CASE WHEN nth = 1 THEN b ELSE b || '-' || (nth - 1) END, entry_path, CASE WHEN nth = 1 THEN b ELSE b || '-' || (nth - 1) END FROM (
    SELECT source_path, replace(lower(text), ' ', '-') AS b, row_number() OVER (PARTITION BY source_path, text ORDER BY line_idx) AS nth FROM headings WHERE level = 2 AND source_path NOT IN (SELECT source_path FROM sections)) JOIN notes USING (source_path)),
resolved AS (SELECT w.*, CASE WHEN w.heading IS NULL THEN b.note_entry ELSE g.goal END AS dst, CASE WHEN w.heading IS NOT NULL THEN g.anchor END AS anchor
  FROM wikilinks w LEFT JOIN best b ON b.name = w.target AND b.from_dir = regexp_replace(w.entry_path, '/[^/]*/[^/]*$', '')
  LEFT JOIN goals g ON g.note_entry = b.note_entry AND g.slug = replace(lower(w.heading), ' ', '-')),
md_links AS (SELECT output_path, source_path, entry_path, ord, regexp_extract(raw, '\[([^\]\n]+)\]\(([^)\s]+)\)', 1) AS label, regexp_extract(raw, '\[([^\]\n]+)\]\(([^)\s]+)\)', 2) AS target FROM any_links WHERE NOT regexp_matches(raw, '^!?\[\[')),
md_goal AS (SELECT m.*, CASE WHEN contains(target, '#') THEN split_part(target, '#', 2) END AS heading, CASE WHEN starts_with(target, '#') THEN m.source_path ELSE regexp_replace(s.dir, '(^|/)[^/]*$', '') || '/' || substr(split_part(target, '#', 1), 4) END AS path FROM md_links m JOIN notes s USING (source_path)),
md_resolved AS (SELECT m.output_path, m.source_path, m.entry_path, m.ord, m.label, m.target, CASE WHEN m.heading IS NULL THEN n.entry_path ELSE g.goal END AS dst, CASE WHEN m.heading IS NOT NULL THEN g.anchor END AS anchor
  FROM md_goal m LEFT JOIN notes n ON n.source_path = m.path LEFT JOIN goals g ON g.note_entry = n.entry_path AND g.slug = replace(lower(m.heading), ' ', '-')),
related_entries AS (SELECT n.source_path, n.entry_path, 0 AS rank, b.note_entry AS dst FROM notes n JOIN best b ON len(n.related) > 0 AND b.name = n.related[1] AND b.from_dir = regexp_replace(n.entry_path, '/[^/]*/[^/]*$', '')),
all_edges AS (SELECT entry_path AS src, dst, 0 AS a, rank AS b FROM related_entries UNION ALL SELECT output_path, dst, 1, -ord FROM resolved WHERE dst IS NOT NULL UNION ALL SELECT output_path, dst, 2, ord FROM md_resolved WHERE dst IS NOT NULL),
edges AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY o, dst) - 1 AS first_ord FROM (SELECT src, dst, min([a, b]) AS o FROM all_edges WHERE src <> dst GROUP BY 1, 2)),
tag_index AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS tag, entry_path FROM (SELECT string_split(tag, '/') AS p, unnest(range(1, len(string_split(tag, '/')) + 1)) AS k, entry_path FROM (SELECT unnest(tags) AS tag, entry_path FROM notes))),
shared AS (SELECT a.entry_path AS a, b.entry_path AS b, count(*) AS n_shared FROM (SELECT entry_path, unnest(tags) AS tag FROM notes) a JOIN (SELECT entry_path, unnest(tags) AS tag FROM notes) b ON a.tag = b.tag AND a.entry_path < b.entry_path GROUP BY 1, 2 HAVING count(*) >= 2)
"""


def sql(select: str) -> str:
    """`select` over the shared table expressions."""
    return CORPUS + select


def built(spark: SparkSession, sf_dir: str) -> C.Corpus:
    """The tables that a query over the corpus reads, made when they are asked for."""
    return C.Corpus(corpus.notes(spark, sf_dir), RESPLIT)


# ---------------------------------------------------------------- corpus and Markdown


@query(sql("SELECT doc_id, source_path, entry_path, fm_title, array_to_string(tags, ',') AS tags, array_to_string(aliases, ',') AS aliases, md5(body) AS body_md5 FROM notes"))
def note_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.notes(spark, sf_dir).select("doc_id", "source_path", "entry_path", "fm_title", F.array_join("tags", ",").alias("tags"), F.array_join("aliases", ",").alias("aliases"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(sql("SELECT source_path, count(*) AS n_lines, count(*) FILTER (fenced) AS n_fenced FROM lines GROUP BY 1"))
def fenced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.lines(corpus.notes(spark, sf_dir)).groupBy("source_path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("fenced").alias("n_fenced"))


@query(sql("SELECT source_path, line_idx, level, text FROM headings"))
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.headings(corpus.notes(spark, sf_dir))


@query(sql("SELECT source_path, line_idx, CAST(end_idx AS BIGINT) AS end_idx, text, n_h3 FROM sections"))
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(corpus.notes(spark, sf_dir), RESPLIT).select("source_path", "line_idx", "end_idx", "text", "n_h3")


@query(sql("SELECT source_path, line_idx, is_shell, n_h3 FROM shells WHERE n_h3 >= 2"))
def h3_resplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(corpus.notes(spark, sf_dir), RESPLIT).where("n_h3 >= 2").select("source_path", "line_idx", "is_shell", "n_h3")


@query(sql("SELECT output_path, entry_path, source_path, CAST(ord AS BIGINT) AS ord, kind, title, slug, above, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM pages"))
def fragment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).pages


@query(sql("SELECT source_path, title FROM titles"))
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.titles(corpus.notes(spark, sf_dir))


@query(sql("SELECT source_path, line_idx, CASE WHEN nth = 1 THEN base ELSE base || '-' || (nth - 1) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY source_path, base ORDER BY line_idx) AS nth FROM slugs)"))
def slug_dedup_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.counter_slugs(markdown.sections(corpus.notes(spark, sf_dir), RESPLIT), ["source_path"], "line_idx").select("source_path", "line_idx", "slug")


@query(sql("SELECT source_path, line_idx, slug FROM slugged"))
def slug_dedup_probing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.probing_slugs(markdown.sections(corpus.notes(spark, sf_dir), RESPLIT), ["source_path"], "line_idx").select("source_path", "line_idx", "slug")


NAV = ", nav AS (SELECT output_path, above AS parent, CASE WHEN kind <> 'shell' THEN lag(output_path) OVER w END AS prev, CASE WHEN kind <> 'shell' THEN lead(output_path) OVER w END AS next FROM pages WHERE kind <> 'entry' WINDOW w AS (PARTITION BY above ORDER BY ord)) "


@query(sql(NAV + "SELECT output_path, parent, prev, next FROM nav"))
def page_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.navigation(built(spark, sf_dir).pages)


@query(sql("SELECT s.source_path, s.line_idx, md5(string_agg(l.line, chr(10) ORDER BY l.line_idx)) AS body_md5 FROM sections s JOIN raw_lines l ON l.source_path = s.source_path AND l.line_idx >= s.line_idx AND l.line_idx < s.end_idx GROUP BY 1, 2"))
def section_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.section_bodies(corpus.notes(spark, sf_dir), RESPLIT).select("source_path", "line_idx", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(sql("""SELECT h.source_path, h.line_idx, h.level, h.text, CAST(coalesce((SELECT min(g.line_idx) FROM headings g WHERE g.source_path = h.source_path AND g.line_idx > h.line_idx AND g.level <= h.level), n_lines) AS BIGINT) AS end_idx
FROM headings h JOIN n_lines USING (source_path)"""))
def section_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.section_extents(corpus.notes(spark, sf_dir))


@query(sql(""", f AS (SELECT source_path, line_idx, trim(line) AS t, NOT fenced AND trim(line) <> '' AND NOT regexp_matches(line, '^[\\s\\p{Z}]*(#{1,6})(?: (.*))?$') AS ok FROM lines),
g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY source_path ORDER BY line_idx) AS b FROM f)
SELECT source_path, string_agg(t, ' ' ORDER BY line_idx) AS paragraph FROM g WHERE ok AND b = (SELECT min(b) FROM g x WHERE x.ok AND x.source_path = g.source_path) GROUP BY 1"""))
def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.first_paragraph(corpus.notes(spark, sf_dir))


# ---------------------------------------------------------------- links


@query(sql("SELECT output_path, ord, embed, target, heading, alias FROM wikilinks"))
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.wikilinks(built(spark, sf_dir).links).select("output_path", F.col("at").cast("long").alias("ord"), "embed", "target", "heading", "alias")


@query(sql("SELECT output_path, ord, label, target FROM md_links"))
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.markdown_links(built(spark, sf_dir).links).select("output_path", F.col("at").cast("long").alias("ord"), "label", "target")


STATUS = "CASE WHEN dst IS NULL THEN 'missing' WHEN heading IS NULL THEN 'entry' WHEN anchor IS NULL THEN 'page' ELSE 'anchor' END AS status"


@query(sql(f"SELECT output_path, ord, target, heading, {STATUS}, dst, anchor FROM resolved"))
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).resolved.select("output_path", F.col("at").cast("long").alias("ord"), "target", "heading", "status", "dst", "anchor")


@query(sql("SELECT output_path, ord, target, dst, anchor FROM md_resolved"))
def relative_link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).md.select("output_path", F.col("at").cast("long").alias("ord"), "target", "dst", "anchor")


@query(sql("SELECT note_entry, slug, goal AS dst, anchor FROM goals"))
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).goals


@query(sql("SELECT output_path, source_path, ord, target, heading, alias FROM resolved WHERE dst IS NULL"))
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).unresolved.select("output_path", "source_path", F.col("at").cast("long").alias("ord"), "target", "heading", "alias")


@query(sql("SELECT output_path, count(*) AS n_missing, count(heading) AS n_headings FROM resolved WHERE dst IS NULL GROUP BY 1"))
def unresolved_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).unresolved.groupBy("output_path").agg(F.count(F.lit(1)).alias("n_missing"), F.count("heading").alias("n_headings"))


@query(sql("SELECT src, dst, first_ord FROM edges"))
def forward_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).edges


@query(sql("SELECT dst, src, count(*) OVER (PARTITION BY dst) AS n_src FROM edges"))
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.backlinks(built(spark, sf_dir).edges)


@query(sql("SELECT source_path, CAST(rank AS BIGINT) AS rank, dst FROM related_entries"))
def related_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.related_entries(corpus.notes(spark, sf_dir)).select("source_path", "rank", "dst")


@query(sql("SELECT a, b, n_shared FROM shared"))
def shared_tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.shared_tags(corpus.notes(spark, sf_dir))


@query(sql(""", ex AS (SELECT entry_path AS src, dst, min(rank) AS rank FROM related_entries WHERE entry_path <> dst GROUP BY 1, 2),
both_ways AS (SELECT a AS src, b AS dst, n_shared FROM shared UNION ALL SELECT b, a, n_shared FROM shared),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n_shared DESC, string_split(dst, '/')) AS rank, n_shared FROM both_ways ANTI JOIN ex USING (src, dst))
SELECT src, dst, CAST(rank AS BIGINT) AS rank, 'related' AS why, CAST(NULL AS BIGINT) AS n_shared FROM ex UNION ALL SELECT src, dst, rank, 'tags', n_shared FROM r WHERE rank <= 3"""))
def related_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.top_related(corpus.notes(spark, sf_dir))


# ---------------------------------------------------------------- indexes


@query(sql("SELECT tag, entry_path FROM tag_index"))
def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.tag_index(corpus.notes(spark, sf_dir))


@query(sql("SELECT tag, count(*) AS n_notes FROM tag_index GROUP BY 1"))
def tag_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.tag_counts(corpus.notes(spark, sf_dir))


@query(sql(""", f AS (SELECT n.source_path, n.dir, count(s.line_idx) AS k FROM notes n LEFT JOIN sections s USING (source_path) GROUP BY 1, 2),
a AS (SELECT source_path, dir AS own, k, unnest(list_concat([''], list_transform(range(1, len(string_split(dir, '/')) + 1), lambda j: array_to_string(string_split(dir, '/')[1:j], '/')))) AS dir FROM f)
SELECT dir, count(*) AS n_notes, CAST(sum(k) AS BIGINT) AS n_fragments, count(*) FILTER (own = dir) AS n_direct,
count(DISTINCT CASE WHEN own <> dir THEN split_part(CASE WHEN dir = '' THEN own ELSE substr(own, length(dir) + 2) END, '/', 1) END) AS n_subdirs FROM a GROUP BY 1"""))
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = corpus.notes(spark, sf_dir)
    return indexes.directory_rollup(notes, markdown.sections(notes, RESPLIT))


@query(sql("SELECT split_part(n.source_path, '/', 1) AS top, count(*) AS n_notes, CAST(sum(k) AS BIGINT) AS n_fragments FROM (SELECT n.source_path, count(s.line_idx) AS k FROM notes n LEFT JOIN sections s USING (source_path) GROUP BY 1) n GROUP BY 1"))
def top_dir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = corpus.notes(spark, sf_dir)
    return indexes.top_directories(notes, markdown.sections(notes, RESPLIT))


@query(sql("SELECT dir, rank, title FROM (SELECT dir, title, row_number() OVER (PARTITION BY dir ORDER BY title, source_path) AS rank FROM notes JOIN titles USING (source_path)) WHERE rank <= 3"))
def first_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.first_titles(corpus.notes(spark, sf_dir))


@query(sql(""", k AS (SELECT * FROM headings WHERE level = 2 UNION ALL SELECT h.* FROM headings h WHERE level = 1 AND line_idx = (SELECT min(line_idx) FROM headings g WHERE g.level = 1 AND g.source_path = h.source_path)),
b AS (SELECT *, replace(lower(text), ' ', '-') AS base FROM k)
SELECT source_path, line_idx, level, text, CASE WHEN nth = 1 THEN base ELSE base || '-' || (nth - 1) END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY source_path, level, base ORDER BY line_idx) AS nth FROM b)"""))
def heading_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.heading_index(corpus.notes(spark, sf_dir))


TERMS = """, t AS (
  SELECT unnest(tags) AS term, 'tag' AS kind, entry_path AS page FROM notes
  UNION ALL SELECT text, 'heading', entry_path FROM headings JOIN notes USING (source_path)
  UNION ALL SELECT title, 'title', entry_path FROM titles JOIN notes USING (source_path)
  UNION ALL SELECT stem, 'file', entry_path FROM notes
  UNION ALL SELECT unnest(regexp_extract_all(body, '\\[([^\\]\\n]+)\\]\\([^)\\n]+\\)', 1)), 'link_label', entry_path FROM notes),
terms AS (SELECT DISTINCT lower(trim(term)) AS term, kind, page FROM t WHERE trim(term) <> '' AND lower(trim(term)) NOT IN ('index', '_index', 'headings', 'links', 'tags', 'fragments', 'page catalog') AND NOT regexp_matches(lower(trim(term)), '^page-[0-9]+$'))
"""


@query(sql(TERMS + "SELECT term, kind, page FROM terms"))
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.terms(corpus.notes(spark, sf_dir))


@query(sql(TERMS + ", r AS (SELECT *, row_number() OVER (PARTITION BY term, kind ORDER BY string_split(page, '/')) AS nth FROM terms) SELECT term, kind, count(*) AS n_pages, string_agg(page, ',' ORDER BY nth) FILTER (nth <= 20) AS pages, greatest(count(*) - 20, 0) AS n_more FROM r GROUP BY 1, 2"))
def term_page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.term_index(indexes.terms(corpus.notes(spark, sf_dir)))


@query(sql(NAV + "SELECT p.output_path AS path, kind, title, source_path AS source, array_to_string(string_split(p.output_path, '/'), ' > ') AS section, coalesce(parent, '') AS parent, coalesce(prev, '') AS prev, coalesce(next, '') AS next FROM pages p LEFT JOIN nav USING (output_path)"))
def page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = built(spark, sf_dir)
    return indexes.page_catalog(b.notes, b.pages, markdown.navigation(b.pages))


@query(sql("SELECT source_path, count(*) AS n_pages, min(output_path) AS first_page, max(output_path) AS last_page FROM pages GROUP BY 1"))
def pages_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.pages_by_source(built(spark, sf_dir).pages)


@query(sql("SELECT (SELECT count(*) FROM notes) AS n_notes, (SELECT count(*) FROM pages WHERE kind IN ('h2leaf', 'h3leaf')) AS n_fragments, (SELECT count(DISTINCT tag) FROM tag_index) AS n_tags, (SELECT count(*) FROM resolved WHERE dst IS NULL) AS n_unresolved"))
def root_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = built(spark, sf_dir)
    return indexes.root_summary(b.notes, b.pages, b.unresolved)


@query("""WITH RECURSIVE w AS (SELECT doc_id, lang || '/' || source AS scope, length(text) % 900 + 1 AS n, row_number() OVER (PARTITION BY lang || '/' || source ORDER BY doc_id) AS r FROM documents),
p AS (SELECT scope, doc_id, r, 0 AS page_no, 100 + n AS used FROM w WHERE r = 1
  UNION ALL SELECT w.scope, w.doc_id, w.r, CASE WHEN p.used + w.n > 2000 THEN p.page_no + 1 ELSE p.page_no END, CASE WHEN p.used + w.n > 2000 THEN 100 + w.n ELSE p.used + w.n END FROM p JOIN w ON w.scope = p.scope AND w.r = p.r + 1)
SELECT scope, doc_id, CAST(page_no AS BIGINT) AS page_no FROM p""")
def page_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("scope"), "doc_id", (F.length("text") % 900 + 1).alias("n"))
    return indexes.packed(docs, ["scope"], ["doc_id"], "n", 2000, 100)


# ---------------------------------------------------------------- large documents

RECORDS = """WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM documents),
sized AS (SELECT *, strlen(line) + CASE WHEN line_no < n THEN 1 ELSE 0 END AS bytes, length(line) + CASE WHEN line_no < n THEN 1 ELSE 0 END AS n_chars, regexp_replace(line, '^[\\s\\p{Z}]+', '') AS t FROM raw),
records AS (SELECT doc_id, line_no, CAST(sum(bytes) OVER w - bytes AS BIGINT) AS byte_start, CAST(sum(bytes) OVER w AS BIGINT) AS byte_end, CAST(n_chars AS BIGINT) AS n_chars,
  CASE WHEN t = '' THEN 'blank' WHEN starts_with(t, '```') OR starts_with(t, '~~~') THEN 'fence' WHEN regexp_matches(t, '^#{1,6}\\s') THEN 'heading' WHEN regexp_matches(t, '^\\|.*\\|') THEN 'table' WHEN regexp_matches(t, '^([-*+] |[0-9]+\\. )') THEN 'list' ELSE 'plain' END AS kind
  FROM sized WHERE bytes > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM records),
walk AS (SELECT doc_id, r, line_no, n_chars, byte_start, byte_end, 1 AS chunk, n_chars AS used FROM seq WHERE r = 1
  UNION ALL SELECT s.doc_id, s.r, s.line_no, s.n_chars, s.byte_start, s.byte_end, CASE WHEN w.n_chars > 2000 OR w.used + s.n_chars > 2000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.n_chars > 2000 OR w.used + s.n_chars > 2000 THEN s.n_chars ELSE w.used + s.n_chars END
  FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.r = w.r + 1),
chunks AS (SELECT doc_id, CAST(chunk AS BIGINT) AS chunk_no, min(line_no) AS line_start, max(line_no) AS line_end, min(byte_start) AS byte_start, max(byte_end) AS byte_end, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM walk GROUP BY 1, 2)
"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))


@query(RECORDS + "SELECT doc_id, line_no, byte_start, byte_end, n_chars, kind FROM records")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.line_records(_bodies(spark, sf_dir))


NOTE_RECORDS = CORPUS + ", " + RECORDS.removeprefix("WITH RECURSIVE ").replace("(text, chr(10))", "(body, chr(10))").replace("FROM documents", "FROM notes").replace("raw AS", "raw_ AS").replace("FROM raw)", "FROM raw_)")


def _note_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.notes(spark, sf_dir).select("doc_id", "body")


@query(NOTE_RECORDS + "SELECT kind, count(*) AS n_lines, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM records GROUP BY 1")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.line_records(_note_bodies(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n_chars").alias("n_chars"))


@query(RECORDS + "SELECT doc_id, chunk_no, line_start, line_end, byte_start, byte_end, n_chars FROM chunks")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.chunks(large.line_records(_bodies(spark, sf_dir)), CHUNK)


@query(RECORDS + ", p AS (SELECT *, 'part-' || lpad(CAST(chunk_no AS VARCHAR), 3, '0') || '.md' AS page FROM chunks) SELECT doc_id, page, lag(page) OVER w AS prev, lead(page) OVER w AS next, chunk_no, n_chars FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)")
def large_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.page_plan(large.chunks(large.line_records(_bodies(spark, sf_dir)), CHUNK))


@query("""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
w AS (SELECT doc_id, line_no, line, unnest(range(0, length(line), 2000)) AS pos FROM raw WHERE length(line) > 2000)
SELECT doc_id, line_no, pos // 2000 + 1 AS window_no, pos AS char_start, CAST(length(substr(line, pos + 1, 2000)) AS BIGINT) AS n_chars, md5(substr(line, pos + 1, 2000)) AS text_md5 FROM w""")
def byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.byte_windows(_bodies(spark, sf_dir), CHUNK).withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@query(NOTE_RECORDS + """SELECT doc_id, CASE WHEN bool_or(n_chars > 2000) THEN 'byte_window' WHEN bool_or(kind = 'fence') THEN 'code_fence' WHEN bool_or(kind = 'table') THEN 'table'
WHEN count(*) FILTER (kind = 'heading') > 1 THEN 'heading' WHEN count(*) FILTER (kind = 'heading') = 0 THEN 'paragraph' ELSE 'line_window' END AS reason FROM records GROUP BY 1""")
def split_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.split_reason(large.line_records(_note_bodies(spark, sf_dir)), CHUNK)


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, TRUE AS contiguous FROM documents WHERE text <> ''")
def range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.range_coverage(large.line_records(_bodies(spark, sf_dir)))


TREE = """, ext AS (SELECT h.*, coalesce((SELECT min(g.line_idx) FROM headings g WHERE g.source_path = h.source_path AND g.line_idx > h.line_idx AND g.level <= h.level), n_lines) AS end_idx FROM headings h JOIN n_lines USING (source_path)),
ids AS (SELECT *, 'h' || level || '-' || row_number() OVER (PARTITION BY source_path, level ORDER BY line_idx) || '-' || replace(lower(text), ' ', '-') AS id FROM ext),
tree AS (SELECT source_path, line_idx, level, id, coalesce((SELECT arg_max(g.id, g.line_idx) FROM ids g WHERE g.source_path = h.source_path AND g.line_idx < h.line_idx AND g.level < h.level), 'root') AS parent_id, CAST(end_idx AS BIGINT) AS end_idx FROM ids h)
"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.section_tree(markdown.section_extents(corpus.notes(spark, sf_dir)))


@query(sql(TREE + "SELECT source_path, line_idx, level, id, parent_id, end_idx FROM tree"))
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)


@query(sql(TREE + "SELECT source_path, parent_id, string_agg(id, ',' ORDER BY line_idx) AS children FROM tree GROUP BY 1, 2"))
def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.children(_tree(spark, sf_dir))


# trees are valid, so some parents are taken away, and some sections made their own
BAD_TREE = TREE + ", bad AS (SELECT * REPLACE (CASE WHEN level = 2 AND line_idx % 5 = 0 THEN 'nowhere' WHEN level = 3 AND line_idx % 7 = 0 THEN id ELSE parent_id END AS parent_id) FROM tree) "


@query(sql(BAD_TREE + "SELECT t.source_path, t.id, t.parent_id FROM bad t LEFT JOIN bad u ON u.source_path = t.source_path AND u.id = t.parent_id WHERE t.parent_id <> 'root' AND (u.id IS NULL OR u.level >= t.level OR u.line_idx >= t.line_idx OR u.end_idx < t.end_idx)"))
def invalid_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when((F.col("level") == 2) & (F.col("line_idx") % 5 == 0), "nowhere").when((F.col("level") == 3) & (F.col("line_idx") % 7 == 0), F.col("id")).otherwise(F.col("parent_id"))
    return large.invalid_sections(_tree(spark, sf_dir).withColumn("parent_id", parent))


# ---------------------------------------------------------------- retrieval

ENTITIES, TEXT = ["topic-7", "group/g3"], "title 1"
EVIDENCE = """, every AS (SELECT source_path, line_idx, text, coalesce(lead(line_idx) OVER (PARTITION BY source_path ORDER BY line_idx), n_lines) AS end_idx FROM headings JOIN n_lines USING (source_path) WHERE level = 2),
first AS (SELECT source_path, arg_min(line_idx, line_idx) AS i, arg_min(end_idx, line_idx) AS e, text FROM every WHERE text IN ('Part 1', 'Part 2') GROUP BY source_path, text),
flat AS (SELECT f.source_path, f.text AS head, min(l.line_idx) AS a, max(l.line_idx) AS b FROM first f JOIN raw_lines l ON l.source_path = f.source_path AND l.line_idx > f.i AND l.line_idx < f.e AND trim(l.line) <> '' GROUP BY 1, 2),
evidence AS (SELECT CASE head WHEN 'Part 1' THEN 'setup' ELSE 'payoff' END AS field, n.entry_path AS generated_path, n.source_path, CAST(a + 1 AS BIGINT) AS line_start, CAST(b + 1 AS BIGINT) AS line_end,
  trim(array_to_string(string_split(n.body, chr(10))[a + 1 : b + 1], chr(10))) AS text FROM flat JOIN notes n USING (source_path))
"""
CANDIDATES = EVIDENCE + """, cat AS (SELECT p.output_path AS g, p.title, list_concat([t.title], CASE WHEN n.fm_title IS NULL THEN [] ELSE [n.fm_title] END, n.aliases, n.tags) AS ents, n.tags,
  coalesce((SELECT list(h.text) FROM headings h WHERE h.source_path = p.source_path), []) AS heads FROM pages p JOIN notes n USING (source_path) JOIN titles t USING (source_path)),
hit AS (SELECT g FROM cat WHERE list_has_any(ents, ['topic-7', 'group/g3'])),
near AS (SELECT DISTINCT dst AS g FROM edges WHERE src IN (SELECT g FROM hit) AND dst IN (SELECT g FROM cat) UNION SELECT DISTINCT src FROM edges WHERE dst IN (SELECT g FROM hit) AND src IN (SELECT g FROM cat)),
textual AS (SELECT g FROM cat WHERE contains(lower(title), 'title 1') OR contains(lower(array_to_string(ents, chr(10))), 'title 1') OR contains(lower(array_to_string(heads, chr(10))), 'title 1') UNION SELECT generated_path FROM evidence WHERE contains(lower(text), 'title 1')),
u AS (SELECT g, 0 AS priority, TRUE AS hit FROM hit UNION ALL SELECT g, 1, TRUE FROM near UNION ALL SELECT DISTINCT generated_path, 2, FALSE FROM evidence UNION ALL SELECT g, 3, TRUE FROM textual),
candidates AS (SELECT g AS generated_path, CAST(min(priority) AS BIGINT) AS priority, bool_or(hit) AS in_scope FROM u GROUP BY 1)
"""


def _evidence(notes: DataFrame) -> DataFrame:
    return retrieval.heading_evidence(notes, {"setup": "Part 1", "payoff": "Part 2"})


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = built(spark, sf_dir)
    cat = retrieval.catalog(b.notes, b.pages, markdown.titles(b.notes), markdown.headings(b.notes))
    evidence = _evidence(b.notes)
    return retrieval.candidates(cat, b.edges, evidence, ["setup", "payoff"], ENTITIES, TEXT), evidence


@query(sql(EVIDENCE + "SELECT field, generated_path, source_path, line_start, line_end, md5(text) AS text_md5 FROM evidence"))
def evidence_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(corpus.notes(spark, sf_dir)).withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@query(sql(EVIDENCE + "SELECT field, generated_path, line_start, CASE WHEN length(s) > 220 THEN left(s, 217) || '...' ELSE s END AS line FROM (SELECT *, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS s FROM evidence)"))
def compact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(corpus.notes(spark, sf_dir)).select("field", "generated_path", "line_start", T.compact_line(F.col("text")).alias("line"))


@query(sql(CANDIDATES + "SELECT generated_path, priority, in_scope FROM candidates"))
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[0]


@query(sql(CANDIDATES + "SELECT w.section, w.field FROM (VALUES ('A', 'setup'), ('B', 'payoff'), ('C', 'nowhere')) w(section, field) WHERE w.field NOT IN (SELECT field FROM evidence WHERE generated_path IN (SELECT generated_path FROM candidates WHERE in_scope))"))
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, evidence = _candidates(spark, sf_dir)
    return retrieval.missing_required(found, evidence, [("A", "setup"), ("B", "payoff"), ("C", "nowhere")])


TRAIL = ", trail AS (SELECT DISTINCT '- `' || generated_path || '` from `' || source_path || '` lines ' || line_start || '-' || line_end || ' (' || field || ')' AS line FROM evidence) "


@query(sql(EVIDENCE + TRAIL + "SELECT line FROM trail"))
def source_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(corpus.notes(spark, sf_dir))
    return retrieval.source_trail(evidence.select("generated_path").distinct(), evidence, ["setup", "payoff"])


@query(sql(EVIDENCE + TRAIL + "SELECT line, used FROM (SELECT line, CAST(sum(length(line) + 1) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM trail) WHERE used <= 5000"))
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(corpus.notes(spark, sf_dir))
    return retrieval.within_budget(retrieval.source_trail(evidence.select("generated_path").distinct(), evidence, ["setup", "payoff"]), 5000)


@query(sql(""", hit AS (SELECT entry_path AS g FROM notes WHERE list_contains(tags, 'group/g3'))
SELECT DISTINCT dst AS generated_path FROM edges WHERE src IN (SELECT g FROM hit) UNION SELECT DISTINCT src FROM edges WHERE dst IN (SELECT g FROM hit)"""))
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = built(spark, sf_dir)
    hit = b.notes.where(F.array_contains("tags", "group/g3")).select(F.col("entry_path").alias("at"))
    edges = b.edges
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("generated_path")).union(edges.select(F.col("dst").alias("at"), F.col("src").alias("generated_path")))
    return both.join(hit, "at", "left_semi").select("generated_path").distinct()


# ---------------------------------------------------------------- incremental output and quality

DIFF = """WITH old AS (SELECT 'p/' || doc_id || '.md' AS path, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0),
new AS (SELECT 'p/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 3 <> 1)
"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    old = docs.where("doc_id % 3 <> 0").select(path, F.col("text").alias("body"))
    new = docs.where("doc_id % 3 <> 1").select(path, F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("body"))
    return incremental.hashes(new), incremental.hashes(old)


@query(DIFF + "SELECT coalesce(new.path, old.path) AS path, CASE WHEN old.hash IS NULL THEN 'insert' WHEN new.hash IS NULL THEN 'delete' WHEN old.hash = new.hash THEN 'noop' ELSE 'update' END AS action FROM new FULL JOIN old ON old.path = new.path")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.diff(*_versions(spark, sf_dir))


@query(DIFF + "SELECT path FROM old ANTI JOIN new USING (path)")
def stale_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.stale(*_versions(spark, sf_dir))


@query("SELECT 'p/' || doc_id AS path, sha256(text) AS hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.hashes(corpus.table(spark, sf_dir, "documents").select(F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("body")))


@query("SELECT 'p/' || doc_id AS path, md5(CASE WHEN doc_id % 4 = 0 THEN upper(source) ELSE text END) AS body_md5 FROM documents")
def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("p/"), F.col("doc_id").cast("string")))
    out = incremental.last_writer([docs.select("path", F.col("text").alias("body")), docs.where("doc_id % 4 = 0").select("path", F.upper("source").alias("body"))])
    return out.select("path", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("SELECT count(*) AS n_pages, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes, CAST(coalesce(max(length(text)), 0) AS BIGINT) AS max_chars, count(*) FILTER (length(text) > 20000) AS n_oversized FROM documents")
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.corpus_metrics(_bodies(spark, sf_dir), 20_000)


@query("SELECT 'p/' || doc_id AS path, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE length(text) > 20000")
def oversized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.oversized(_bodies(spark, sf_dir).withColumn("path", F.concat(F.lit("p/"), F.col("doc_id").cast("string"))), 20_000)


@query(sql("SELECT source_path AS path, target, split_part(source_path, '/', 1) || '/' || substr(target, 4) AS goal FROM md_resolved WHERE dst IS NULL AND source_path NOT LIKE '%/%/h%/%' UNION ALL SELECT source_path, target, split_part(source_path, '/', 1) || '/' || split_part(source_path, '/', 2) || '/' || substr(target, 4) FROM md_resolved WHERE dst IS NULL AND source_path LIKE '%/%/h%/%'"))
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = built(spark, sf_dir)
    notes = b.notes
    return quality.broken_links(links.markdown_links(b.links).where(~F.col("target").startswith("#")).select(F.col("source_path").alias("path"), "target"), notes.select(F.col("source_path").alias("path")))


# navigation is sound, so some ways back and some parents are taken away
CUT_NAV = NAV + ", cut_nav AS (SELECT output_path, CASE WHEN length(output_path) % 11 = 0 THEN 'nowhere' ELSE parent END AS parent, CASE WHEN length(output_path) % 7 <> 0 THEN prev END AS prev, next FROM nav) "


@query(sql(CUT_NAV + "SELECT n.output_path, 'next' AS problem FROM cut_nav n LEFT JOIN cut_nav m ON m.output_path = n.next WHERE n.next IS NOT NULL AND m.prev IS DISTINCT FROM n.output_path UNION ALL SELECT output_path, 'parent' FROM cut_nav WHERE parent NOT IN (SELECT output_path FROM pages)"))
def nav_reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = built(spark, sf_dir).pages
    n = F.length("output_path")
    nav = markdown.navigation(pages).withColumn("parent", F.when(n % 11 == 0, "nowhere").otherwise(F.col("parent"))).withColumn("prev", F.when(n % 7 != 0, F.col("prev")))
    return quality.nav_violations(nav, pages)


@query(sql("SELECT output_path AS path, 'missing' AS problem FROM pages WHERE kind = 'shell'"))
def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = built(spark, sf_dir).pages.select(F.col("output_path").alias("path"), "kind")
    return quality.duplicates_and_gaps(pages.where("kind != 'shell'"), pages)


@query(sql("SELECT source_path, (length(body) - length(replace(body, '[[', ''))) // 2 AS n_links, (length(body) - length(replace(body, '## ', ''))) // 3 AS n_marks FROM notes"))
def substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.notes(spark, sf_dir).select("source_path", T.occurrences(F.col("body"), "[[").alias("n_links"), T.occurrences(F.col("body"), "## ").alias("n_marks"))


@query(sql(", m AS (SELECT unnest(['Part 2', 'no such marker', 'label 3']) AS marker) SELECT marker, EXISTS (SELECT 1 FROM notes WHERE contains(body, marker)) AS found FROM m"))
def marker_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.marker_check(corpus.notes(spark, sf_dir), ["Part 2", "no such marker", "label 3"])


@query(sql(""", steps AS (SELECT src AS route, src, dst, first_ord AS step FROM edges WHERE first_ord < 3 UNION ALL SELECT src, dst, src, 3 FROM edges WHERE first_ord = 0)
SELECT route, count(*) AS n_steps, bool_and(e.src IS NOT NULL) AND count(*) <= 5 AS ok FROM steps s LEFT JOIN edges e ON e.src = s.src AND e.dst = s.dst GROUP BY 1"""))
def route_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = built(spark, sf_dir).edges
    steps = edges.where("first_ord < 3").select(F.col("src").alias("route"), "src", "dst").union(edges.where("first_ord = 0").select(F.col("src").alias("route"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    return quality.reachable_routes(steps, edges)


@query("SELECT 100.0 * sum(CASE WHEN ok THEN points ELSE 0 END) / sum(points) AS score, bool_and(ok) AS all_passed FROM (VALUES (10.0::DOUBLE, (SELECT count(*) FROM documents) > 0), (15.0, (SELECT max(length(text)) FROM documents) < 100), (20.0, TRUE)) v(points, ok)")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    facts = docs.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("m"))
    checks = facts.select(F.explode(F.array(F.struct(F.lit(10.0).alias("points"), (F.col("n") > 0).alias("passed")), F.struct(F.lit(15.0).alias("points"), (F.col("m") < 100).alias("passed")), F.struct(F.lit(20.0).alias("points"), F.lit(True).alias("passed")))).alias("x"))
    return quality.weighted_score(checks.select("x.points", "x.passed"))


# ---------------------------------------------------------------- scalars


@query(sql("SELECT src, dst, array_to_string(list_concat(list_transform(range(0, len(string_split(src, '/')) - 1 - k), lambda j: '..'), string_split(dst, '/')[k + 1 :]), '/') AS link FROM (SELECT src, dst, coalesce(list_max(list_filter(range(0, least(len(string_split(src, '/')), len(string_split(dst, '/')))), lambda j: string_split(src, '/')[1:j] = string_split(dst, '/')[1:j])), 0) AS k FROM edges)"))
def relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).edges.select("src", "dst", T.relative_link(F.col("src"), F.col("dst")).alias("link"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[\\s\\p{Z}]', '-', 'g'), '[.,:;!?`''\"()\\[\\]{}<>@#$%^&*+=|\\\\/~]|\\p{Cc}', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def line_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@query(sql("SELECT DISTINCT tag, 'tags/' || tag || '.md' AS path FROM tag_index"))
def tag_page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.tag_index(corpus.notes(spark, sf_dir)).select("tag").distinct().select("tag", T.tag_page_path(F.col("tag")).alias("path"))


@query("SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"')) AS n_links, split_part(url, '/', 3) AS host FROM pages")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]+)"'), F.lit(1))).cast("long").alias("n_links"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))


@query("SELECT conv_id, turn, 'turn ' || turn || ' ' || role AS heading, lag('turn ' || turn || ' ' || role) OVER w AS prev, lead('turn ' || turn || ' ' || role) OVER w AS next, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "conversations").withColumn("heading", F.concat_ws(" ", F.lit("turn"), F.col("turn").cast("string"), "role"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return rows.select("conv_id", "turn", "heading", F.lag("heading").over(w).alias("prev"), F.lead("heading").over(w).alias("next"), F.length("text").cast("long").alias("n_chars"))


# ---------------------------------------------------------------- rendering


@query(sql("SELECT output_path, string_agg('- `[[' || concat_ws('#', target, heading) || coalesce('|' || alias, '') || ']]`: ' || CASE WHEN heading IS NULL THEN 'note missing' ELSE 'heading missing' END, chr(10) ORDER BY target, ord) AS body FROM resolved WHERE dst IS NULL GROUP BY 1"))
def unresolved_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.unresolved_report(built(spark, sf_dir).unresolved)


@query(sql(NAV + """SELECT p.output_path AS path, '---' || chr(10) || 'page_meta:' || chr(10) || '  page_kind: ' || kind || chr(10) || '  title: "' || title || '"' || chr(10) || '  source: "' || source_path || '"' || coalesce(chr(10) || '  parent: "' || parent || '"', '') || coalesce(chr(10) || '  prev: "' || prev || '"', '') || coalesce(chr(10) || '  next: "' || next || '"', '') || chr(10) || '---' || chr(10) AS body FROM pages p LEFT JOIN nav USING (output_path)"""))
def metadata_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = built(spark, sf_dir)
    return render.metadata_block(indexes.page_catalog(b.notes, b.pages, markdown.navigation(b.pages)))


def relative_sql(src: str, dst: str) -> str:
    """The link from page src to page dst: up from the directories that they don't share."""
    a, b = f"string_split({src}, '/')[:-2]", f"string_split({dst}, '/')"
    shared = f"coalesce(list_max(list_filter(range(0, least(len({a}), len({b}) - 1) + 1), lambda j: {a}[1:j] = {b}[1:j])), 0)"
    return f"(repeat('../', len({a}) - {shared}) || array_to_string({b}[{shared} + 1 :], '/'))"


def _joined_lines(lines: DataFrame) -> DataFrame:
    return lines.select("path", F.array_join("k", "/").alias("k"), "n", "line")


TITLE_OF = ", title_of AS (SELECT output_path AS path, title FROM pages) "


@query(sql(TITLE_OF + f"""SELECT p.output_path, '> Parent: [' || u.title || '](' || {relative_sql("p.output_path", "p.above")} || ')'
  || coalesce(' · Prev: [' || b.title || '](' || {relative_sql("p.output_path", "p.prev")} || ')', '') || coalesce(' · Next: [' || a.title || '](' || {relative_sql("p.output_path", "p.next")} || ')', '') AS head
FROM (SELECT *, CASE WHEN kind <> 'shell' THEN lag(output_path) OVER w END AS prev, CASE WHEN kind <> 'shell' THEN lead(output_path) OVER w END AS next FROM pages WHERE kind <> 'entry' WINDOW w AS (PARTITION BY above ORDER BY ord)) p
JOIN title_of u ON u.path = p.above LEFT JOIN title_of b ON b.path = p.prev LEFT JOIN title_of a ON a.path = p.next"""))
def navigation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.navigation_lines(built(spark, sf_dir).pages)


FRAGMENTS = f"SELECT above AS output_path, '## Fragments' || chr(10) || chr(10) || string_agg('- [' || title || '](' || {relative_sql('above', 'output_path')} || ')', chr(10) ORDER BY ord) || chr(10) AS fragments FROM pages WHERE above IS NOT NULL GROUP BY 1"
BACK = f"""SELECT dst AS output_path, '## Backlinks' || chr(10) || chr(10) || string_agg('- [' || title || '](' || {relative_sql('dst', 'src')} || ')', chr(10) ORDER BY string_split(src, '/')) || chr(10) AS backlinks FROM edges JOIN title_of ON path = src GROUP BY 1"""
RELATED = """, ex AS (SELECT entry_path AS src, dst, min(rank) AS rank FROM related_entries WHERE entry_path <> dst GROUP BY 1, 2),
both_ways AS (SELECT a AS src, b AS dst, n_shared FROM shared UNION ALL SELECT b, a, n_shared FROM shared),
by_tags AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n_shared DESC, string_split(dst, '/')) AS rank, n_shared FROM both_ways ANTI JOIN ex USING (src, dst)),
related AS (SELECT src, dst, CAST(rank AS BIGINT) AS rank, 'related' AS why FROM ex UNION ALL SELECT src, dst, rank, 'tags' FROM by_tags WHERE rank <= 3) """
RELATED_LIST = f"""SELECT src AS output_path, '## Related' || chr(10) || chr(10) || string_agg('- [' || title || '](' || {relative_sql('src', 'dst')} || ')', chr(10) ORDER BY why, rank) || chr(10) AS related FROM related JOIN title_of ON path = dst GROUP BY 1"""


@query(sql(FRAGMENTS))
def fragment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.fragment_lists(built(spark, sf_dir).pages)


@query(sql(TITLE_OF + BACK))
def backlink_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    return render.backlink_lists(c.edges, c.titles)


@query(sql(TITLE_OF + RELATED + RELATED_LIST))
def related_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    return render.related_lists(links.top_related(c.notes), c.titles)


# texts with what only looks like a wikilink marked, as links are cut out by a pattern
MAIN = f""", raw_bodies AS (SELECT output_path, string_agg(replace(replace(CASE WHEN fenced THEN replace(line, '[[', '[@[') ELSE line END, '`[[', '`[@['), '<!-- [[', '<!-- [@['), chr(10) ORDER BY line_idx) AS raw FROM page_lines GROUP BY 1),
goal_of AS (SELECT output_path, ord, CASE WHEN dst IS NULL THEN regexp_replace(raw, '^!', '') || ' (unresolved)' ELSE '[' || coalesce(alias, concat_ws('#', target, heading)) || '](' || {relative_sql('output_path', 'dst')} || coalesce('#' || anchor, '') || ')' END AS new FROM resolved JOIN any_links USING (output_path, source_path, entry_path, ord)
  UNION ALL SELECT output_path, ord, CASE WHEN dst IS NULL THEN raw ELSE '[' || label || '](' || {relative_sql('output_path', 'dst')} || coalesce('#' || anchor, '') || ')' END FROM md_resolved JOIN any_links USING (output_path, source_path, entry_path, ord)),
news AS (SELECT output_path, list(new ORDER BY ord) AS news FROM goal_of GROUP BY 1),
main AS (SELECT p.output_path, replace(coalesce(array_to_string(list_transform(range(1, len(string_split_regex(raw, '!?\\[\\[[^\\[\\]\\n]+\\]\\]|\\[[^\\]\\n]+\\]\\([^)\\s]+\\)')) + 1), lambda k: string_split_regex(raw, '!?\\[\\[[^\\[\\]\\n]+\\]\\]|\\[[^\\]\\n]+\\]\\([^)\\s]+\\)')[k] || coalesce(news[k], '')), ''), ''), '[@[', '[[') AS main
  FROM pages p LEFT JOIN raw_bodies USING (output_path) LEFT JOIN news USING (output_path)) """


@query(sql(MAIN + "SELECT output_path, md5(main) AS main_md5 FROM main"))
def rewritten_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    return render.rewritten(c.bodies, c.links, c.resolved, c.md).select("output_path", F.md5(F.col("main").cast("binary")).alias("main_md5"))


HEADS = QUERIES["navigation_lines"][1][len(CORPUS) + len(TITLE_OF) :]


@query(sql(TITLE_OF + RELATED + MAIN + f""", heads AS ({HEADS}), frags AS ({FRAGMENTS}), backs AS ({BACK}), rels AS ({RELATED_LIST}),
parts AS (SELECT p.output_path, main, coalesce(head || chr(10) || '---' || chr(10) || chr(10), '') AS top, list_filter([fragments, backlinks, related], lambda x: x IS NOT NULL) AS autos
  FROM main p LEFT JOIN heads USING (output_path) LEFT JOIN frags USING (output_path) LEFT JOIN backs USING (output_path) LEFT JOIN rels USING (output_path))
SELECT output_path AS path, md5(top || main || CASE WHEN len(autos) > 0 THEN CASE WHEN ends_with(main, chr(10)) THEN '' ELSE chr(10) END || chr(10) || '---' || chr(10) || chr(10) || array_to_string(autos, chr(10)) ELSE '' END) AS body_md5 FROM parts"""))
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fragment_pages(built(spark, sf_dir)).select("path", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(sql(TITLE_OF + """SELECT 'links/index.md' AS path, array_to_string(string_split(src, '/'), '/') AS k, n, line FROM (
  SELECT src, first_ord AS n, '- [' || d.title || '](../' || dst || ')' AS line FROM edges JOIN title_of d ON d.path = dst
  UNION ALL SELECT src, -2, '## [' || title || '](../' || src || ')' FROM (SELECT DISTINCT src FROM edges) JOIN title_of ON path = src
  UNION ALL SELECT DISTINCT src, -1, '' FROM edges UNION ALL SELECT DISTINCT src, 1099511627776, '' FROM edges)
UNION ALL SELECT 'links/index.md', '', 0, '# Links' UNION ALL SELECT 'links/index.md', '', 1, ''"""))
def link_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    return _joined_lines(render.link_lines(c.edges, c.titles))


HEADING_ROWS = """, kept AS (SELECT * FROM headings WHERE level = 2 UNION ALL SELECT h.* FROM headings h WHERE level = 1 AND line_idx = (SELECT min(line_idx) FROM headings g WHERE g.level = 1 AND g.source_path = h.source_path)),
anchored AS (SELECT *, CASE WHEN nth = 1 THEN b ELSE b || '-' || (nth - 1) END AS anchor FROM (SELECT *, replace(lower(text), ' ', '-') AS b, row_number() OVER (PARTITION BY source_path, level, text ORDER BY line_idx) AS nth FROM kept)),
entry_of AS (SELECT source_path, entry_path, title FROM pages WHERE kind = 'entry') """


@query(sql(HEADING_ROWS + """SELECT 'headings/index.md' AS path, source_path AS k, n, line FROM (
  SELECT a.source_path, CASE WHEN level = 1 THEN 0 ELSE a.line_idx + 1 END AS n, CASE WHEN level = 2 THEN '  ' ELSE '' END || '- [' || a.text || '](../' || CASE WHEN level = 1 THEN e.entry_path WHEN p.output_path IS NOT NULL THEN p.output_path ELSE e.entry_path || '#' || anchor END || ')' AS line
  FROM anchored a JOIN entry_of e USING (source_path) LEFT JOIN pages p ON p.source_path = a.source_path AND p.ord = a.line_idx AND p.kind IN ('h2leaf', 'shell')
  UNION ALL SELECT source_path, -2, '## [' || title || '](../' || entry_path || ')' FROM entry_of WHERE source_path IN (SELECT source_path FROM kept)
  UNION ALL SELECT DISTINCT source_path, -1, '' FROM kept UNION ALL SELECT DISTINCT source_path, 1099511627776, '' FROM kept)
UNION ALL SELECT 'headings/index.md', '', 0, '# Headings' UNION ALL SELECT 'headings/index.md', '', 1, ''"""))
def heading_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    return _joined_lines(render.heading_lines(c.notes, c.pages, indexes.heading_index(c.notes, c.heads)))


@query(sql("""SELECT '_unresolved.md' AS path, output_path AS k, n, line FROM (
  SELECT output_path, row_number() OVER (PARTITION BY output_path ORDER BY target, ord DESC) AS n, '- `[[' || concat_ws('#', target, heading) || coalesce('|' || alias, '') || ']]`: ' || CASE WHEN heading IS NULL THEN 'note missing' ELSE 'heading missing' END AS line FROM resolved WHERE dst IS NULL
  UNION ALL SELECT DISTINCT output_path, -2, '## `' || output_path || '`' FROM resolved WHERE dst IS NULL
  UNION ALL SELECT DISTINCT output_path, -1, '' FROM resolved WHERE dst IS NULL UNION ALL SELECT DISTINCT output_path, 1099511627776, '' FROM resolved WHERE dst IS NULL)
UNION ALL SELECT '_unresolved.md', '', 0, '# Unresolved wikilinks' UNION ALL SELECT '_unresolved.md', '', 1, ''"""))
def unresolved_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_lines(render.unresolved_lines(built(spark, sf_dir).unresolved))


@query(sql(f""", entry_of AS (SELECT output_path AS entry_path, title FROM pages WHERE kind = 'entry'), tagged AS (SELECT tag, 'tags/' || tag || '.md' AS path, entry_path FROM tag_index)
SELECT path, entry_path AS k, 0 AS n, '- [' || title || '](' || {relative_sql('path', 'entry_path')} || ')' AS line FROM tagged JOIN entry_of USING (entry_path)
UNION ALL SELECT DISTINCT path, '', 0, '# Tag: `' || tag || '`' FROM tagged UNION ALL SELECT DISTINCT path, '', 1, '' FROM tagged
UNION ALL SELECT 'tags/index.md', tag, 0, '- [`' || tag || '`](' || tag || '.md) (' || count(*) || ')' FROM tagged GROUP BY tag
UNION ALL SELECT 'tags/index.md', '', 0, '# Tags' UNION ALL SELECT 'tags/index.md', '', 1, ''"""))
def tag_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    return _joined_lines(render.tag_lines(c.notes, c.pages.where("kind = 'entry'").select(F.col("output_path").alias("path"), "title")))


@query("""WITH RECURSIVE l AS (SELECT lang || '/index.md' AS path, doc_id AS n, split_part(text, chr(10), 1) AS line, length(split_part(text, chr(10), 1)) + 1 AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
w AS (SELECT path, n, r, 0 AS page, size AS used FROM l WHERE r = 1 UNION ALL SELECT l.path, l.n, l.r, CASE WHEN w.used + l.size > 3000 THEN w.page + 1 ELSE w.page END, CASE WHEN w.used + l.size > 3000 THEN l.size ELSE w.used + l.size END FROM w JOIN l ON l.path = w.path AND l.r = w.r + 1),
t AS (SELECT w.path, page, string_agg(line, chr(10) ORDER BY r) || chr(10) AS text FROM w JOIN l USING (path, r) GROUP BY 1, 2)
SELECT replace(path, 'index.md', 'page-' || lpad(CAST(page + 1 AS VARCHAR), 3, '0') || '.md') AS path, md5('# ' || path || ' ' || (page + 1) || chr(10) || chr(10) || text) AS body_md5 FROM t
UNION ALL SELECT path, md5('# ' || path || chr(10) || chr(10) || '- Paged index pages: `' || count(*) || '`' || chr(10) || string_agg('- [Page ' || (page + 1) || '](page-' || lpad(CAST(page + 1 AS VARCHAR), 3, '0') || '.md): 0 entries, `` ... ``', chr(10) ORDER BY page) || chr(10)) FROM t GROUP BY path""")
def index_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    lines = docs.select(F.concat("lang", F.lit("/index.md")).alias("path"), F.array().cast("array<string>").alias("k"), F.col("doc_id").alias("n"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    return render.documents(lines, 3000, 3000).select("path", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(sql(NAV + f""", sized AS (SELECT output_path, length(string_agg(line, chr(10) ORDER BY line_idx)) AS n_chars FROM page_lines GROUP BY 1), e AS (SELECT source_path, title FROM pages WHERE kind = 'entry')
SELECT p.entry_path || ':' || CASE p.kind WHEN 'entry' THEN 'entry' WHEN 'shell' THEN p.slug || ':shell' WHEN 'h3leaf' THEN string_split(p.above, '/')[-2] || ':' || p.slug ELSE p.slug END AS page_id, CASE WHEN p.kind IN ('h2leaf', 'h3leaf') THEN 'leaf' ELSE p.kind END AS page_kind, p.output_path, p.source_path,
  e.title || CASE WHEN p.kind = 'h3leaf' THEN ' > ' || u.title ELSE '' END || CASE WHEN p.kind <> 'entry' THEN ' > ' || p.title ELSE '' END AS section_path,
  {relative_sql('p.output_path', 'nav.parent')} AS parent, {relative_sql('p.output_path', 'nav.prev')} AS prev, {relative_sql('p.output_path', 'nav.next')} AS next, coalesce(n_chars, 0) AS n_chars
FROM pages p JOIN e USING (source_path) LEFT JOIN nav ON nav.output_path = p.output_path LEFT JOIN pages u ON u.output_path = p.above LEFT JOIN sized ON sized.output_path = p.output_path"""))
def regular_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    return markdown.page_plan(c.pages, markdown.page_bodies(c.notes, c.pages))


@query(sql(TREE + "SELECT t.source_path, t.line_idx, '- [' || t.id || '](../' || n.entry_path || ')' AS line FROM tree t JOIN notes n USING (source_path)"))
def tree_heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = corpus.notes(spark, sf_dir)
    return quality.tree_heading_lines(_tree(spark, sf_dir), notes.select("source_path", "entry_path"))


@query(sql(""", kinds_of AS (SELECT source_path, CASE WHEN bool_or(starts_with(line, '```')) THEN 'code_fence' WHEN bool_or(starts_with(line, '|')) THEN 'table' ELSE 'heading' END AS reason FROM raw_lines GROUP BY 1),
code AS (SELECT source_path, string_agg(line || chr(10), '' ORDER BY line_idx) AS t FROM raw_lines WHERE NOT starts_with(ltrim(line), '```') AND NOT starts_with(line, '# ') GROUP BY 1),
rows_of AS (SELECT source_path, string_agg(line || chr(10), '' ORDER BY line_idx) AS t FROM raw_lines WHERE starts_with(trim(line), '|') AND NOT contains(line, '---') AND NOT contains(trim(line), ' id ') GROUP BY 1)
SELECT source_path, reason AS split_reason, md5(CASE reason WHEN 'code_fence' THEN '```text' || chr(10) || coalesce(code.t, '') || '```' || chr(10) WHEN 'table' THEN '| id | value |' || chr(10) || '|---|---|' || chr(10) || coalesce(rows_of.t, '') ELSE body END) AS text_md5
FROM notes JOIN kinds_of USING (source_path) LEFT JOIN code USING (source_path) LEFT JOIN rows_of USING (source_path)"""))
def repaired_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = corpus.notes(spark, sf_dir)
    has = lambda mark: F.exists(F.split("body", "\n"), lambda x: x.startswith(mark))
    leaves = notes.select("source_path", F.when(has("```"), "code_fence").when(has("|"), "table").otherwise("heading").alias("split_reason"), F.col("body").alias("text"))
    return quality.repaired(leaves).select("source_path", "split_reason", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT 'headings' AS kind, i + 1 AS n, '## Chapter ' || i || chr(10) || chr(10) || '### Topic ' || i || chr(10) || 'marker-headings-' || i || chr(10) AS line FROM range(300) t(i)
UNION ALL SELECT 'headings', 0, '---' || chr(10) || 'title: Large Fixture' || chr(10) || '---' || chr(10)
UNION ALL SELECT 'table', i + 1, '| ' || i || ' | table-marker-' || i || ' |' FROM range(300) t(i)
UNION ALL SELECT 'table', 0, '---' || chr(10) || 'title: Large Fixture' || chr(10) || '---' || chr(10) || '# Table' || chr(10) || chr(10) || '| id | value |' || chr(10) || '|---|---|'""")
def fixture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda kind: quality.fixture(spark, kind, 300).select(F.lit(kind).alias("kind"), "n", "line")
    return one("headings").unionByName(one("table"))


@query("""WITH leaf AS (SELECT doc_id, length(text) AS n_chars, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'heading' END AS split_reason FROM documents)
SELECT doc_id, split_reason = CASE WHEN doc_id % 6 = 0 THEN 'table' ELSE 'heading' END AND n_chars <= 2000 AS passed FROM leaf""")
def forced_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    leaves = docs.select("doc_id", F.length("text").alias("n_chars"), F.when(F.col("doc_id") % 3 == 0, "table").otherwise("heading").alias("split_reason"))
    return quality.forced_splits(leaves, docs.select("doc_id", F.when(F.col("doc_id") % 6 == 0, "table").otherwise("heading").alias("reason")), 2000)


@query(sql(MAIN + "SELECT output_path AS path, (length(main) - length(replace(main, '[[', ''))) // 2 AS n FROM main WHERE contains(main, '[[')"))
def wikilink_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    main = render.rewritten(c.bodies, c.links, c.resolved, c.md)
    return quality.wikilink_residue(main.select(F.col("output_path").alias("path"), F.col("main").alias("body")))


@query(sql(""", leaf_n AS (SELECT n.source_path, n.dir, count(p.output_path) AS f FROM notes n LEFT JOIN pages p ON p.source_path = n.source_path AND p.kind IN ('h2leaf', 'h3leaf') GROUP BY 1, 2),
above AS (SELECT source_path, dir AS own, f, unnest(list_concat([''], list_transform(range(1, len(string_split(dir, '/')) + 1), lambda j: array_to_string(string_split(dir, '/')[1:j], '/')))) AS dir FROM leaf_n),
roll AS (SELECT dir, 'fragments' || CASE WHEN dir = '' THEN '' ELSE '/' || dir END AS place, count(*) AS n_notes, CAST(sum(f) AS BIGINT) AS n_fragments, count(*) FILTER (own = dir) AS n_direct,
  count(DISTINCT CASE WHEN own <> dir THEN split_part(CASE WHEN dir = '' THEN own ELSE substr(own, length(dir) + 2) END, '/', 1) END) AS n_subdirs FROM above GROUP BY 1),
own_of AS (SELECT source_path, title, 'fragments/' || dir || '/_index.md' AS path, stem AS name FROM notes JOIN titles USING (source_path)),
below AS (SELECT *, string_split(dir, '/')[-1] AS name, 'fragments' || CASE WHEN contains(dir, '/') THEN '/' || regexp_replace(dir, '/[^/]*$', '') ELSE '' END || '/_index.md' AS up FROM roll WHERE dir <> ''),
ranked AS (SELECT a.dir, t.title, row_number() OVER (PARTITION BY a.dir ORDER BY t.title, t.source_path) AS rank FROM above a JOIN titles t USING (source_path)),
tops AS (SELECT place, unnest(['# ' || place, '', '## Summary', '', '- Notes: ' || n_notes || ' (recursive)', '- Fragments: ' || n_fragments || ' (recursive)', '- Subdirectories: ' || n_subdirs, '']) AS line, unnest(range(8)) AS n FROM roll)
SELECT place || '/_index.md' AS path, '' AS k, n, line FROM tops
UNION ALL SELECT place || '/_index.md', v.k, v.n, v.line FROM roll, (VALUES ('1', -2, '## Subdirectories'), ('1', -1, ''), ('1~', 0, ''), ('3', -2, '## Directory Preview'), ('3', -1, ''), ('3~', 0, '')) v(k, n, line) WHERE n_subdirs > 0
UNION ALL SELECT place || '/_index.md', v.k, v.n, v.line FROM roll, (VALUES ('5', -2, '## Notes'), ('5', -1, ''), ('5~', 0, '')) v(k, n, line) WHERE n_direct > 0
UNION ALL SELECT up, '1/' || name, 0, '- [' || name || '](' || name || '/_index.md): ' || n_notes || ' notes' FROM below
UNION ALL SELECT up, '3/' || name, 0, '- [' || name || '](' || name || '/_index.md): ' || n_notes || ' notes, ' || n_fragments || ' fragments' FROM below
UNION ALL SELECT up, '3/' || name, rank, '  - ' || title FROM ranked JOIN below USING (dir) WHERE rank <= 3
UNION ALL SELECT path, '5/' || name, 0, '- [' || title || '](' || name || '/index.md)' FROM own_of"""))
def directory_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = built(spark, sf_dir)
    return _joined_lines(render.directory_lines(c.notes, c.pages))


@query(sql("SELECT n, text FROM (SELECT text, row_number() OVER (ORDER BY string_split(source_path, '/'), line_idx) AS n FROM headings WHERE level <= 2) WHERE n <= 12"))
def heading_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.heading_preview(markdown.headings(corpus.notes(spark, sf_dir))).withColumn("n", F.col("n").cast("long"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT lang || '/' || CASE WHEN doc_id % 4 = 0 THEN 'a-1' ELSE 'a' END || repeat('.', doc_id % 5) || '.md' AS source FROM documents),
b AS (SELECT source, CASE WHEN x = '' THEN 'source' ELSE x END AS base, row_number() OVER (ORDER BY source) AS r FROM (SELECT source, trim(regexp_replace(regexp_replace(source, '(\\.md)+$', ''), '[^A-Za-z0-9-]+', '_', 'g'), '_') AS x FROM s)),
p AS (SELECT r, source, base AS name, [base] AS used FROM b WHERE r = 1
  UNION ALL SELECT r, source, name, list_append(used, name) FROM (SELECT b.r, b.source, p.used, CASE WHEN NOT list_contains(p.used, b.base) THEN b.base ELSE b.base || '-' || list_min(list_filter(range(1, len(p.used) + 2), lambda k: NOT list_contains(p.used, b.base || '-' || k))) END AS name FROM p JOIN b ON b.r = p.r + 1))
SELECT source, name || '.md' AS name FROM p""")
def source_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    stem = F.when(F.col("doc_id") % 4 == 0, "a-1").otherwise("a")
    rows = docs.select(F.concat("lang", F.lit("/"), stem, F.repeat(F.lit("."), (F.col("doc_id") % 5).cast("int")), F.lit(".md")).alias("source")).distinct()
    return markdown.unused_names(rows.withColumn("base", T.source_page_stem(F.col("source"))), [], "source", "base", "name", ".md").select("source", "name")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items() if text is not None}
