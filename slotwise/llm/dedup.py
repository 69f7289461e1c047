"""Exact dedup against a persistent digest index; DataFrame functions only.

The index is a table bucketed and sorted by digest.  A batch of new rows is reduced to
one row per digest first (partly before the shuffle, so a text with very many copies is
one row per task), met with the index by a sort-merge anti-join, and what is new is
appended.  Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``.

Defined cases: a null text counts as empty; empty texts equal each other; among equal
texts of a batch the most code points, then the smallest id stay (a null id last); a
text the index already holds stays with its first keeper; rows that share an id
share its fate; an empty batch leaves the index as it is; further columns are not
read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DROPPED = " \t\n\x0b\x0c\r"
INDEX_SCHEMA = "digest binary, keep_id long, group_size long"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), DROPPED, "").cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, in a table that stays between batches.

    ``table`` names it in the session's catalogue; its files lie in the warehouse,
    which all executors share.  An existing table of that name is used as it is.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        if not spark.catalog.tableExists(table):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.sql(
                f"create table {table} ({INDEX_SCHEMA}) using parquet "
                f"clustered by (digest) sorted by (digest) into {n} buckets"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, new: DataFrame) -> None:
        """Append what of ``new`` (of INDEX_SCHEMA, one row per digest) is not there yet."""
        fresh = new.join(self.rows().hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", "group_size").write.insertInto(self.table)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")


def batch_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per digest of a batch: which row stays, and of how many."""
    return (
        docs.select(
            digest_of(F.col(text_col)).alias("digest"),
            F.struct(
                (-F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("shorter"),
                F.col(id_col).isNull().alias("nameless"),
                F.col(id_col).alias("id"),
            ).alias("rank"),
        )
        .groupBy("digest")
        .agg(F.min("rank").alias("best"), F.count("*").alias("group_size"))
        .select("digest", F.col("best.id").alias("keep_id"), "group_size")
    )


def dedup(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` added to the index; per row its digest, keeper and group size.

    ``group_size`` counts the equal texts of the batch that brought the text.  The join
    that hands the groups back to the rows reads the index's files as plain files, so
    that a hot digest's rows can be split between tasks.
    """
    spark = docs.sparkSession
    index.add(batch_groups(docs, id_col, text_col))
    location = index.rows().inputFiles()
    kept = spark.read.schema(INDEX_SCHEMA).parquet(*location) if location else index.rows()
    keyed = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
    return keyed.join(kept, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index under a name of its own."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
