"""Query of BPE encoding and decoding; merges are beyond SQL, the tests hold the tokenizers library against it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookheat.llm.bpe import decode, encode
from bookheat.llm.common import table
from bookheat.llm.registry import query


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` with the number and digest of its ids and the digest of the decoded text."""
    coded = decode(encode(docs.select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
