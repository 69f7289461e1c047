"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.store import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); one root per component.

    Each round every root moves to its neighbour of least random rank, if that is less
    than its own; links between equal roots go.  A round takes away a fixed share of
    the roots that still have links, so the rounds follow the logarithm of their number
    and a chain takes no longer than a star.  Both tables stay distributed.
    """
    edges = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        rank = lambda column: F.xxhash64(F.col(column), F.lit(turn))  # noqa: E731, B023
        both = edges.union(edges.select("b", "a"))
        moves = written(
            both.groupBy("a")
            .agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("to"))).alias("least"))
            .filter(F.col("least.rank") < rank("a"))
            .select(F.col("a").alias("from"), "least.to"),
            "moves",
        )
        known, left = labels, edges
        labels = written(_moved(labels, moves, "root"), "labels")
        edges = written(_moved(_moved(edges, moves, "a"), moves, "b").filter("a <> b").distinct(), "links")
        forget(moves, left, *([known] if turn else []))
        turn += 1
    return labels if turn else written(labels, "labels")


def _moved(df: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    joined = df.join(moves, F.col(column) == F.col("from"), "left")
    return joined.withColumn(column, F.coalesce("to", column)).select(*df.columns)
