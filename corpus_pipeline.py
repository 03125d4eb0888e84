"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes what its predecessor kept, written as Parquet; all but the last return the columns of
``documents``. The mix gives a document as many rows as repetitions, the last in part
only if its source would else miss its target by more than 1%.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tandemql import storage
from tandemql.llm import common, decontam, langid, mixing, neardup, tokens
from tandemql.llm.queries import MIX_WEIGHTS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return langid.keep_known(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return decontam.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX_WEIGHTS, chars_col="n_chars", whole_texts=True)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return tokens.encode_and_read(docs, public_tokenizers.path(tokens.TOKENIZER))


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token output", token_output),
]

#: Signatures, language models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage has written for itself is deleted once its result is, and so is its predecessor's result. The token
    files stay, as they are what the pipeline is for.
    """
    base = storage.fresh_path(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before = storage.mark()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        storage.release(spark, before)
        if i:
            storage.delete(spark, f"{base}/{i - 1}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
