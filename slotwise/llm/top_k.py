"""Exact top-k inner products of integer vectors.

Each component x counts as floor(1024 * x).  Vectors are turned by the right singular
vectors of all vectors, so that the first coordinates carry most of their length, and
laid into blocks of descending length.  A query meets the blocks from the longest down.
In a block the product over the first coordinates plus the product of the remaining
lengths (Cauchy-Schwarz) bounds every score: only pairs whose bound reaches the query's
k-th best score so far are multiplied out, in whole numbers.

1. Gram matrix of all vectors (its size is the dimension's square) and its rotation.
2. Blocks: vectors of one power-of-two length band, dealt by hash into blocks of about
   ``BLOCK``.  Queries in blocks of ``QUERIES``.
3. Queries meet the seed blocks, those of greatest length, and get a first k-th score.
4. Queries meet every other block whose greatest length can still reach that score.
5. The k best of each query over all blocks, ties to the smaller id.

A task sees one block of vectors and one block of queries, whatever the input.

Defined cases: vectors that are null, or hold a null, NaN or infinite component, take no
part, nor do those with a null id, nor those of another dimension than the most frequent
one (the largest of equally frequent ones); an empty vector likewise; repeated ids are
rows of their own, and a query leaves out every row of its own id; with fewer than k
other rows all are returned; no queries, no rows; further columns are not read.  Scores
are exact as long as they fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.store import written

SCALE = 1024
BLOCK = 8192
QUERIES = 1024
HEAD = 4  # one part in so many of the coordinates comes first
PRODUCTS = 1 << 22  # scores bounded at once
OUT = "query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm): scaled to whole numbers, rows that take no part left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("x")).filter(
        F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", finite)
    )
    scaled = kept.select("vec_id", F.transform("x", lambda x: F.floor(SCALE * x).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    scaled = scaled.withColumn("norm", F.sqrt(square))
    sizes = scaled.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("d")).head()
    return scaled.filter(F.size("v") == (usual["d"] if usual else 0))


def rotation(vectors: DataFrame) -> np.ndarray:
    """Right singular vectors of all vectors, those of greatest singular value first."""

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column("v")).astype(np.float64)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "g"])

    parts = vectors.select("v").mapInArrow(run, "i long, j long, g double")
    cells = parts.groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    d = int(cells["i"].max()) + 1 if len(cells) else 0
    gram = np.zeros((d, d))
    gram[cells["i"], cells["j"]] = cells["g"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def best_in_block(items: pd.DataFrame, queries: pd.DataFrame, turn: np.ndarray, k: int) -> pd.DataFrame:
    """Of one block: for each query its k best items that can reach its score so far."""
    items = items.sort_values(["norm", "vec_id"], ascending=[False, True])
    x, q = np.stack(items["v"].to_numpy()), np.stack(queries["q"].to_numpy())
    ids, own = items["vec_id"].to_numpy(), queries["id"].to_numpy()
    head = max(1, len(turn) // HEAD)
    xr, qr = x @ turn, q @ turn
    rest = lambda a: np.sqrt((a[:, head:] ** 2).sum(axis=1))
    x_rest, q_rest = rest(xr), rest(qr)
    slack = 1 + 1e-9 * np.abs(q).sum(axis=1, dtype=np.float64) * max(1.0, float(np.abs(x).max()))
    least = queries["to_reach"].astype("float64").fillna(-np.inf).to_numpy(np.float64).copy()
    found: list[np.ndarray] = []
    best = np.full((len(q), k), -np.inf)
    step = max(1, PRODUCTS // len(q))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        bound = qr[:, :head] @ xr[part, :head].T + np.outer(q_rest, x_rest[part]) + slack[:, None]
        row, col = np.nonzero((bound >= least[:, None]) & (own[:, None] != ids[None, part]))
        if not len(row):
            continue
        col += at
        score = np.concatenate(
            [np.einsum("ij,ij->i", q[row[s : s + 65536]], x[col[s : s + 65536]]) for s in range(0, len(row), 65536)]
        )
        keep = score >= least[row]
        row, col, score = row[keep], col[keep], score[keep]
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, score, nth = (a[nth < k] for a in (row, col, score, nth))
        found.append(np.stack([own[row], ids[col], score], axis=1))
        new = np.full((len(q), k), -np.inf)
        new[row, nth] = score
        best = -np.sort(-np.concatenate([best, new], axis=1), axis=1)[:, :k]
        least = np.maximum(least, best[:, k - 1])
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
    nth = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
    return pd.DataFrame(rows[nth < k], columns=["query_id", "vec_id", "score"])


def _meet(items: DataFrame, queries: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """Blocks of items (block) with blocks of queries (block, part): the best of each."""
    turn_sent = items.sparkSession.sparkContext.broadcast(turn)
    parts = queries.select("block", "part").distinct()
    by_pair = items.join(parts, "block").groupBy("block", "part")
    own = queries.select("block", "part", "vec_id", "v", "reach").toDF("b", "p", "id", "q", "to_reach")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        return best_in_block(left, right, turn_sent.value, k)

    return by_pair.cogroup(own.groupBy("b", "p")).applyInPandas(run, OUT)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each row for which ``is_query`` of vec_id holds."""
    vectors = written(whole_vectors(rows, id_col, vector_col), "vectors")
    turn = rotation(vectors)
    banded = vectors.withColumn("band", F.floor(F.log2(F.greatest("norm", F.lit(1.0)))))
    bands = banded.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    bands = bands.withColumn("parts", F.ceil(F.col("n") / BLOCK))
    items = (
        banded.join(bands.select("band", "parts"), "band")
        .withColumn("block", F.struct("band", F.pmod(F.xxhash64("vec_id", "norm"), F.col("parts")).alias("nth")))
        .select("block", "vec_id", "v", "norm")
    )
    blocks = bands.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nth"), "band", "longest")
    blocks = blocks.select(F.struct("band", F.col("nth").cast("long").alias("nth")).alias("block"), "longest")
    count = vectors.filter(is_query).count()
    parts = F.pmod(F.xxhash64("vec_id"), F.lit(-(-count // QUERIES) or 1))
    queries = vectors.filter(is_query).withColumn("part", parts)
    # Every query meets the block; the list of blocks is a row for each BLOCK vectors.
    top = blocks.orderBy(F.desc("block")).limit(1)
    seeds = _met(queries.withColumn("reach", F.lit(None).cast("double")), top)
    first = written(_best(_meet(items, seeds, turn, k), k), "first")
    reach = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("reach"))
    others = blocks.join(top.select("block"), "block", "left_anti")
    pairs = _met(queries.join(reach.distinct(), "vec_id", "left"), others)
    able = F.col("reach").isNull() | (F.col("norm") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("reach"))
    rest = _meet(items, pairs.filter(able), turn, k)
    return _best(first.select("query_id", "vec_id", "score").union(rest), k).select("query_id", "rank", "vec_id", "score")


def _met(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Queries with every block, by a join on the number of a block in the list."""
    listed = blocks.select("block", "longest", F.row_number().over(Window.orderBy("block")).alias("at"))
    n = listed.count()
    if not n:
        return queries.withColumn("at", F.lit(0)).join(listed, "at").drop("at")
    spread = queries.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return spread.join(listed, "at").drop("at")
