"""Queries over vectors; the tests hold brute force against them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.llm import ann
from bookheat.llm.common import table
from bookheat.llm.registry import query
from bookheat.llm.vector_dups import near_duplicates


@query("op7_vector_near_dups")
def op7_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
