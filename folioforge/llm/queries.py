"""The queries of this subpackage, each over the whole documents table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary, bpe, classlm, decontaminate, lengths, quality, secrets, simhash, substrings, toxicity
from .common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), decontaminate.benchmark_of(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), quality.labels_of(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), toxicity.labels_of(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op10_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_secrets": op2_secrets,
        "op3_substrings": op3_substrings,
        "op4_decontaminate": op4_decontaminate,
        "op5_token_counts": op5_token_counts,
        "op6_quality": op6_quality,
        "op7_toxicity": op7_toxicity,
        "op8_token_files": op8_token_files,
        "op9_bpe": op9_bpe,
        "op10_classlm": op10_classlm,
        "pipeline": pipeline,
    }


def _kind_sql(kind: str, rank: int, pattern: str, judged: str) -> str:
    """Matches of a kind by the pieces between them: running lengths give the places."""
    quoted = pattern.replace("'", "''")
    parts = f"regexp_extract_all(text, '{quoted}', {2 if kind == 'assign' else 0})"
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, unnest(regexp_split_to_array(text, '{quoted}')) AS gap, unnest(list_append(regexp_extract_all(text, '{quoted}'), '')) AS hit,
    unnest(list_append({parts}, '')) AS part, {judged} AS least, unnest(range(len({parts}) + 1)) AS k FROM docs WHERE regexp_matches(text, '{quoted}')"""


OP2_SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
pieces AS ({" UNION ALL ".join(_kind_sql(x.kind, i, x.pattern, str(x.least)) for i, x in enumerate(secrets.RULES))}),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY k) AS stop FROM pieces),
spans AS (SELECT r, kind, rank, stop - length(hit) AS start, kind || ':' || (stop - length(hit)) || ':' || stop AS line FROM placed WHERE hit <> '' AND length(part) >= least),
lines AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(line, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(line, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob
FROM docs LEFT JOIN lines USING (r)"""

OP3_SQL = r"""WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
windows AS (SELECT doc_id, r, k, md5(array_to_string(w[k : k + 49], ' ')) AS h FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 48)) AS k FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 50)) AS k FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": OP2_SQL, "op3_substrings": OP3_SQL}
