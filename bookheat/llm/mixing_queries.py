"""Query and SQL check of the mix of sources."""

from pyspark.sql import DataFrame, SparkSession

from bookheat.llm.common import table
from bookheat.llm.mixing import mix
from bookheat.llm.registry import query

SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM base GROUP BY source),
ladder AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM src),
steps AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER p, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS weight
  FROM ladder
  WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT *, ratio <= rest / weight AS is_full,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos FROM steps),
stop AS (SELECT rest, weight FROM filled WHERE NOT is_full ORDER BY pos LIMIT 1),
goal AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap ELSE w * (SELECT rest FROM stop) / (SELECT weight FROM stop) END AS target
  FROM filled),
placed AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (passes * size + greatest(0, least(size, budget - passes * source_size - before)))::BIGINT AS taken
FROM cut
"""


@query("op10_mix_sources", SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
