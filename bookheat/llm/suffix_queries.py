"""Query and SQL check of the deduplication of byte strings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.llm.common import table
from bookheat.llm.registry import query
from bookheat.llm.suffix_dedup import deduplicate

SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (
  SELECT r, unnest(range(1, length(x) // 2 + 1)) AS i FROM texts),
windows AS (
  SELECT p.r, p.i, md5(substr(t.x, 2 * p.i - 1, 400)) AS w
  FROM places p JOIN texts t USING (r) WHERE 2 * p.i - 1 + 399 <= length(t.x)),
hits AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1),
heads AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hits),
spans AS (
  SELECT r, g, min(i) AS a, max(i) + 199 AS b
  FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM heads) GROUP BY r, g),
gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM spans
  UNION ALL
  SELECT t.r, coalesce(max(s.b), 0) + 1, length(any_value(t.x)) // 2 FROM texts t LEFT JOIN spans s USING (r) GROUP BY t.r),
kept AS (
  SELECT g.r, string_agg(substr(t.x, 2 * g.f - 1, 2 * (g.t - g.f + 1)), '' ORDER BY g.f) AS k
  FROM gaps g JOIN texts t USING (r) GROUP BY g.r),
sums AS (
  SELECT r, sum(b - a + 1) AS gone, count(*) AS n FROM spans GROUP BY r)
SELECT t.doc_id, (length(t.x) // 2)::BIGINT AS n_bytes, coalesce(s.gone, 0)::BIGINT AS n_removed,
       coalesce(s.n, 0)::BIGINT AS n_spans, sha256(unhex(k.k)) AS kept_sha256
FROM texts t JOIN kept k USING (r) LEFT JOIN sums s USING (r)
"""


@query("op13_suffix_dedup", SQL)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
