"""A training-corpus pipeline over ``documents``: each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflux.checkpoints import ensure_checkpoint_dir, remove
from wayflux.llm import bpe, quality
from wayflux.llm.common import small_batches
from wayflux.llm.exactdup import drop_exact_copies
from wayflux.llm.mixing import mixed_rows
from wayflux.llm.neardup import drop_near_copies
from wayflux.llm.queries import quality_model, vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from sf_dir's labels, does not reject.

    A null or empty text is scored as the ordinary prose that stands beside every text; texts of any length are scored
    whole; repeated rows stay or go together; without labels of both classes all have one score. Other columns stay as
    they are, whatever their names; an empty table gives an empty one.
    """
    small_batches(spark)
    model = quality_model(spark, docs, sf_dir)
    return docs.filter(model.column(F.col("text")) >= quality.THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id.

    Null counts as empty, and empty texts are equal; of rows that repeat an id and a text one stays, a null id goes
    before any other. Whole texts are compared, however long. Other columns are those of the row that stays.
    """
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Documents without words (null texts too) are no copies and all stay; of rows that repeat an id and a text one
    stays; one id with different texts is different documents; a null id goes before any other. Texts are read whole.
    """
    small_batches(spark)
    return drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the columns of documents.

    A null source is a source of its own; a document without words has size 0 and is in none of the totals; rows that
    repeat an id are separate documents. An empty table gives an empty one.
    """
    return mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and digests of the ids and of the text they decode to.

    A null text counts as empty and has no tokens; null and repeated ids keep their rows; texts are encoded whole.
    """
    small_batches(spark)
    return bpe.encode(docs, vocabulary_path(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The stages learn, draw and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again by the next.

    What a stage read is deleted once its result is written; the last result stays.
    """
    shared = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{place}")
        docs = spark.read.parquet(f"{shared}/{place}")
        if place:
            remove(spark, f"{shared}/{place - 1}")
    return docs
