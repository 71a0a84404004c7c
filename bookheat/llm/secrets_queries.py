"""Query of the secret scan; spans by position are beyond SQL, the tests hold a plain scan against it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.llm.common import table
from bookheat.llm.registry import query
from bookheat.llm.secrets import BASE, findings, joined, of_kinds


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[F.size(of_kinds(spans, (k,))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of_kinds(spans, BASE)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
