"""Queries of the two classifiers; learned scores are beyond SQL, the tests check held-out accuracy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.llm import quality, toxicity
from bookheat.llm.common import table
from bookheat.llm.labelled import held_out
from bookheat.llm.registry import query


def _report(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _report(quality.score(docs, model).drop("text"), quality.THRESHOLD)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _report(toxicity.score(docs, model).drop("text"), toxicity.THRESHOLD)
