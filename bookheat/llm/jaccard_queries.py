"""Query of the n-gram Jaccard join; all pairs are too slow in SQL on whole tables, the tests hold them against it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.llm.common import table
from bookheat.llm.jaccard import join_components
from bookheat.llm.registry import query


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_components(table(spark, sf_dir, "documents"), 3, 90, 100)
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
