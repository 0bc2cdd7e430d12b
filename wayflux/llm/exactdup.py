"""Exact dedup with skew-safe combining.

Rows are combined three times, and each time rows meet only when their whole normalised texts are equal, the digest
merely routes them: within a task (map-side aggregation), within a salt of a digest, and over the salts of a digest.
A text that a third of all rows repeat thus reaches any reducer as at most one row per map task and salt. When the rows
learn their group, the rows of a digest that has 1 / HOT of all rows or more are dealt over salts, and its group is
repeated for each; all others meet under salt 0. There can be no more than HOT such digests, so their list is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint
from wayflux.llm.common import ascii_lower, text_or_empty

#: Salts per digest. A reducer of the first merge holds at most (map tasks / SALTS) rows of one text.
SALTS = 32
#: A digest with at least this part (one in so many) of all rows is hot.
HOT = 1000


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, content, keep_id, group_size: one row per distinct content of rows (row_id, digest, content)."""
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    per_salt = salted.groupBy("digest", "content", "salt").agg(F.max("row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return per_salt.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def told(rows: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """rows with the columns of groups(digest, keep_id, group_size); digests are unique in ``groups``."""
    total = groups.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    hot = groups.filter((F.col("group_size") > 1) & (F.col("group_size") * HOT >= total)).select("digest", F.lit(True).alias("hot"))
    hot = F.broadcast(hot)  # at most HOT rows, as each has one in HOT of all rows
    salted = rows.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0)).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = groups.join(hot, "digest", "left").withColumn("salt", F.explode(copies)).drop("hot")
    return salted.join(repeated, ["digest", "salt"]).drop("salt")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with the largest id
    stays. Rows that repeat both id and text are one document given twice and share the same values. A null id is
    kept only in a group without any other id. An empty table gives an empty result. Other columns are not read.
    ``digest`` may be weak: digests that more than one content shares are joined by content as well.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), ascii_lower(text_or_empty(F.col(text_col))).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    merged = winners(rows, salts)
    groups = checkpoint(merged.drop("content"))
    clashing = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    if clashing.isEmpty():
        found = told(rows.drop("content"), groups, salts)
    else:
        clashing = checkpoint(clashing)
        alone = groups.join(clashing, "digest", "left_anti")
        found = told(rows.drop("content"), alone, salts)
        clashed = merged.join(clashing, "digest", "left_semi")
        found = found.unionByName(rows.join(clashed, ["digest", "content"]).drop("content"))
    return found.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with all its columns, less the rows whose text another row with a larger id has.

    A row that repeats id and text of another one goes too.
    """
    judged = exact_dedup(docs, id_col, text_col, salts)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stay = judged.filter("kept").select(key("doc_id").alias("__key"), F.col("digest").alias("__digest"))
    marked = docs.withColumn("__key", key(id_col)).withColumn("__digest", sha256(ascii_lower(text_or_empty(F.col(text_col)))))
    # Plain equality on the same two columns: the rows of a key are together after the join, and stay there.
    return marked.join(stay, ["__key", "__digest"], "left_semi").dropDuplicates(["__key", "__digest"]).select(*docs.columns)
