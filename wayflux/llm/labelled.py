"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayflux.llm.common import text_or_empty


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, label: documents with a 0/1 label among those rows of ``labels`` that ``learn`` (over doc_id) admits.

    At most ``bound`` label rows are used, those with the smallest hashes of their ids; so the broadcast below has at
    most ``bound`` rows of two numbers, and no text is shuffled to find the documents. Labels that are null or neither
    0 nor 1 and null ids count for nothing; a row of documents or labels that repeats an id counts as often as it does.
    Null texts are empty. Other columns are not read.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & learn)
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label")
