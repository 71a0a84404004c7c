"""Corpus pipeline: drop toxic documents, one of each near-duplicate group, redact, mix, encode.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on all that its
predecessor kept; ``run`` writes each result as Parquet in the shared folder and reads it back.

Cases, for all stages: nulls in any column, empty texts and empty tables are processed as the operators
define; further columns of the input are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.llm import jaccard, mixing, secrets, toxicity
from bookheat.llm.bpe import decode, encode
from bookheat.llm.bpe_queries import vocabulary
from bookheat.llm.common import bound_batches, other_columns, row_of, table, unpacked
from bookheat.session import ship_package, stage

#: Near-duplicates: word n-grams of five, similarity of 80 / 100 and more.
WORDS, NUM, DEN = 5, 80, 100


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def _back(rows: DataFrame, docs: DataFrame, others: list[str]) -> DataFrame:
    """The columns of ``docs`` from ``text`` and ``others``, all its other columns packed."""
    columns = dict(zip(others, unpacked(others, "others")))
    return rows.select(*[columns.get(c, F.col("text").alias(c)) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the model learns from ``labels`` of ``sf_dir``."""
    _ready(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    others = other_columns(docs, "text")
    scored = toxicity.score(docs.select(row_of(others).alias("others"), "text"), model)
    return _back(scored.filter(F.col("score") < toxicity.THRESHOLD), docs, others)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (then text hash) of each group; rows that repeat id and text are one.

    An id that stands with different texts is as many documents. Documents without id stay.
    """
    _ready(spark)
    others = other_columns(docs, "text")
    rows = docs.select(row_of(others).alias("others"), "text", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    kept = jaccard.kept_texts(docs.select("doc_id", "text"), WORDS, NUM, DEN)
    known = rows.join(kept, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    return _back(known.unionByName(rows.filter("id is null")), docs, others)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; ``n_chars`` follows a changed text."""
    _ready(spark)
    others = other_columns(docs, "text")
    done = secrets.redact(docs.select(row_of(others).alias("others"), "text", F.length("text").alias("before")))
    size = F.when(F.col("before") != F.length("text"), F.length("text")).otherwise(F.col("others.n_chars")).cast("long")
    return _back(done.withColumn("others", F.col("others").withField("n_chars", size)), docs, others)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document once for every pass that takes it, whole even where the budget ends in it."""
    _ready(spark)
    mixed = mixing.mix(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source"))
    return mixed.withColumn("pass", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids with their number, and the digests of ids and of the decoded text."""
    _ready(spark)
    path = vocabulary()
    coded = decode(encode(docs.select("doc_id", "source", "text"), path), path)
    return coded.select(
        "doc_id",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: Learned scores and merges are beyond SQL; the tests hold a plain version against every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
