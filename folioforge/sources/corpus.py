"""The note corpus derived from the documents table, and the page tables of other sources.

The documents table has no Markdown, so notes are built from it by one rule that SQL can express too: titles, tags,
aliases and related entries by arithmetic on doc_id, and a body with a heading, links, a fence, table or list now and then,
and headings between the lines of the text. Some notes are not cut into pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source_path, entry_path, entry_dir, dir, stem, fm_title, aliases, tags, related, body, fragment)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    base = docs.join(quality, "doc_id", "left").crossJoin(n)  # one row
    i, n = F.col("doc_id"), F.col("n")
    s = lambda c: c.cast("string")
    hub = i % 10 == 3
    folder = F.concat_ws("/", "lang", "source")
    base = base.withColumns(
        {
            "dir": F.when(hub, F.concat(folder, F.lit("/h"), s(i))).otherwise(folder),
            "stem": F.when(hub, F.concat(F.lit("hub"), s(i % 7))).otherwise(F.concat(F.lit("n"), s(i))),
            "fm_title": F.when(i % 5 == 0, F.concat(F.lit("Title "), s(i % 50))),
            "aliases": F.when(i % 3 == 0, F.array(F.concat(F.lit("topic-"), s(i % 97)))).otherwise(F.array().cast("array<string>")),
            "tags": F.concat(
                F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("src/"), "source"), F.concat(F.lit("group/g"), s(i % 13))),
                F.when(F.col("quality").isNotNull(), F.array(F.concat(F.lit("quality/"), s(F.col("quality"))))).otherwise(F.array().cast("array<string>")),
            ),
            "related": F.when(i % 11 == 0, F.array(F.concat(F.lit("n"), s((i + 1) % n)))).otherwise(F.array().cast("array<string>")),
        }
    )
    see = F.concat(
        F.lit("See [[n"), s((7 * i + 3) % n), F.lit("]] and [[topic-"), s(i % 97), F.lit("|label "), s(i), F.lit("]] or [[missing-"), s(i % 17),
        F.lit("]] at [[n"), s((5 * i + 1) % n), F.lit("#Part 1]] and [file](../"), F.col("source"), F.lit("/n"), s((i + 20) % n), F.lit(".md)."),
    )
    block_of = lambda k: F.floor(k / 4)
    # what only looks like a link, and links to headings
    more = F.concat(
        F.lit("More `[[n1]]` <!-- [[n2]] --> [own](#Part 0) [far](../"), F.col("source"), F.lit("/n"), s((i + 4) % n), F.lit(".md#Part 1) [[n"), s((i + 4) % n), F.lit("#Part 1-1]]"),
    )
    # a fence, a table, a list and a blank line now and then
    kinds = F.when(i % 8 == 1, F.array(F.lit("```"), F.lit("## not a heading [[n3]]"), F.lit("```"))).when(i % 8 == 2, F.array(F.lit("| a | b |"), F.lit("|---|---|"))).when(i % 8 == 3, F.array(F.lit("- item"), F.lit(""), F.lit("1. one"))).otherwise(F.array().cast("array<string>"))

    def with_heading(line, k):
        block = block_of(k)
        # of one note in six a section has three third-level headings; of one in nine a heading takes the name of a repeated one
        title = F.when((i % 9 == 4) & (block == 0), F.lit("## Part 1-1")).otherwise(F.concat(F.lit("## Part "), s(block % 3)))
        third = F.concat(F.lit("### Sub "), s(F.when(i % 6 == 2, F.lit(0)).otherwise(block)))
        return (
            F.when(k % 4 == 0, F.array(title, line))
            .when((k % 4 == 2) | ((i % 6 == 2) & (k % 4 > 0)), F.array(third, line))
            .when((k == 1) & (i % 7 == 0), F.array(more, line))
            .otherwise(F.array(line))
        )

    lines = F.flatten(F.transform(F.split("text", "\n"), with_heading))
    body = F.array_join(F.concat(F.array(F.concat(F.lit("# Doc "), s(i)), see), kinds, lines), "\n")
    path = F.concat(F.col("dir"), F.lit("/"), F.col("stem"), F.lit(".md"))
    base = base.withColumn("source_path", path).withColumn("body", body).withColumn("fragment", F.when(i % 12 == 5, F.lit(False)))
    return base.select("doc_id", "source_path", T.entry_path(F.col("source_path")).alias("entry_path"), T.entry_dir(F.col("source_path")).alias("entry_dir"), "dir", "stem", "fm_title", "aliases", "tags", "related", "body", "fragment")
