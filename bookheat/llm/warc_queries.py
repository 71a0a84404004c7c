"""Query and SQL check of the WARC round trip."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.llm.common import table
from bookheat.llm.registry import query
from bookheat.llm.warc import archive, read

SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM q
"""


@query("op8_warc_round_trip", SQL)
def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read(archive(table(spark, sf_dir, "pages")))
    # a payload that does not match its digest must not pass as read
    checked = F.when(F.col("intact"), F.col("payload_digest"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
