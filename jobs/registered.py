"""The jobs as queries: each runs its job twice on the whole tables, into a folder and checkpoint of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.plans import code_base
from effectflow.runtime import shared_dir
from jobs import comment_index, escape_report


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_comment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of all documents; the second run finds nothing new."""
    out = _new_folder(spark, "job1")
    for _ in range(2):
        found = comment_index.run(spark, f"{sf_dir}/documents.parquet", out)
    return found


def job2_escape_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, and what each file lets escape, of the code base of all suppliers."""
    out = _new_folder(spark, "job2")
    for _ in range(2):
        found = escape_report.run(spark, out, tables=sf_dir)
    # where a parser stops and how it says so is its own
    return found.withColumn("message", F.regexp_replace("message", "^(failed to analyse file).*", "$1"))


QUERIES = {"job1_comment_index": job1_comment_index, "job2_escape_report": job2_escape_report}

SQL = {
    "job1_comment_index": r"""
WITH files AS (
  SELECT coalesce(nullif(source, ''), '-') || '/' || coalesce(nullif(lang, ''), '-') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'text-' || left(sha256(coalesce(text, '')), 16)) AS path,
    coalesce(nullif(lang, ''), '-') AS lang, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (SELECT path, lang, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS content FROM files
), said AS (SELECT path, lang, line, substr(content, strpos(content, '#')) AS said FROM lines WHERE contains(content, '#')
), behind AS (SELECT *, regexp_replace(said, '^#+\s*', '') AS b FROM said)
SELECT path, lang, CAST(line AS INTEGER) AS line, lower(regexp_extract(b, '^([A-Za-z_][A-Za-z0-9_-]*)', 1)) AS tag,
  CASE WHEN regexp_matches(b, '^[A-Za-z_][^\[#]*\[[^\]]*\]') THEN regexp_extract(b, '\[([^\]]*)\]', 1) END AS listed, left(sha256(said), 16) AS hash
FROM behind""",
    "job2_escape_report": f"""WITH RECURSIVE {code_base._BASE_SQL}, {code_base._FOUND_SQL}, numbers AS (SELECT file_id, count(*) AS n FROM findings GROUP BY file_id),
  escaping AS (SELECT 's' || k || '.py' AS file_id, string_agg(DISTINCT effect, ',' ORDER BY effect) AS effects FROM opened GROUP BY k)
  SELECT 'finding' AS kind, file_id, CAST(line AS INTEGER) AS line, severity, message, NULL AS functions, NULL AS raises, NULL AS findings, NULL AS effects FROM findings
  UNION ALL SELECT 'file', file_id, NULL, NULL, NULL, CASE WHEN broken THEN 0 ELSE 3 END, CASE WHEN broken THEN 0 ELSE 4 END, coalesce(n, 0), effects
  FROM base LEFT JOIN numbers USING (file_id) LEFT JOIN escaping USING (file_id)""",
}
