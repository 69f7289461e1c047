"""Quality of whole texts: a convolutional network over their bytes, in numpy.

Bytes are embedded in ``DIMS`` learned numbers.  Filters of ``2 * HOP`` bytes move by
``HOP`` bytes; overlapping chunks of ``CHUNK`` positions, ``CHUNK_STEP`` apart, cover the
whole text, and each filter keeps its largest answer in a chunk.  A hidden layer reads a
chunk's answers, its units are averaged over the text's chunks, and a logistic layer
makes the probability of them.  Training (gradients reach the filters at the position of each largest answer,
Adam steps) takes at most ``sample_docs`` documents of label 0 and three times as many of
label 1, those of least hash; scoring is a map over all rows.

Defined cases: a null text counts as empty; an empty text gets the probability of one
empty chunk, a number from 0 to 1 like any other; without labelled rows the score is
0.5; with one label only the network learns that label; repeated rows get equal scores;
labels are the only rows joined, further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.store import in_small_batches

DIMS, HOP, FILTERS, HIDDEN = 8, 4, 32, 16
CHUNK, CHUNK_STEP = 128, 112  # positions
THRESHOLD = 0.3
PIECE = 512  # chunks answered at once
SAMPLE_MOST_CHARS = 1_000_000


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DIMS
    first: np.ndarray  # HOP * DIMS x FILTERS, over the first half of a filter
    second: np.ndarray
    bias: np.ndarray
    inner: np.ndarray  # FILTERS x HIDDEN
    inner_bias: np.ndarray
    top: np.ndarray  # HIDDEN
    offset: np.ndarray  # 1

    @staticmethod
    def start(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(size=shape).astype(np.float32)
        return Network(
            draw(256, DIMS) * 0.5,
            draw(HOP * DIMS, FILTERS) * 0.15,
            draw(HOP * DIMS, FILTERS) * 0.15,
            np.zeros(FILTERS, np.float32),
            draw(FILTERS, HIDDEN) * 0.2,
            np.zeros(HIDDEN, np.float32),
            draw(HIDDEN) * 0.3,
            np.zeros(1, np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, self.first, self.second, self.bias, self.inner, self.inner_bias, self.top, self.offset]


def padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each filled up past its last chunk; chunks per text, and where each begins, in steps.

    A text's last chunk ends before the next text begins, so that texts don't touch.
    """
    step, tail = CHUNK_STEP * HOP, (CHUNK - CHUNK_STEP + 1) * HOP
    raw = [(t or "").encode() for t in texts]
    chunks = np.array([max(1, -(-(len(r) - tail) // step)) for r in raw], np.int64)
    begins = np.cumsum(chunks + 1) - chunks - 1
    out = np.zeros(int(begins[-1] + chunks[-1] + 1) * step + tail, np.uint8)
    for r, at in zip(raw, begins):
        out[at * step : at * step + len(r)] = np.frombuffer(r, np.uint8)
    inside = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return out, chunks, np.repeat(begins, chunks) + inside


def _answers(net: Network, data: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk the answers at each position, and the embedded bytes."""
    positions = (chunks - 1) * CHUNK_STEP + CHUNK
    rows = net.embedding[data[: (positions + 1) * HOP]].reshape(positions + 1, HOP * DIMS)
    answers = rows[:-1] @ net.first
    answers += rows[1:] @ net.second
    view = np.lib.stride_tricks.sliding_window_view(answers, CHUNK, axis=0)[::CHUNK_STEP]
    return view, rows  # chunks x FILTERS x CHUNK


def chunk_maxima(net: Network, data: np.ndarray, chunks: int) -> np.ndarray:
    out = np.empty((chunks, FILTERS), np.float32)
    for at in range(0, chunks, PIECE):
        n = min(PIECE, chunks - at)
        out[at : at + n] = _answers(net, data[at * CHUNK_STEP * HOP :], n)[0].max(axis=2)
    return np.maximum(out + net.bias, 0)


def chunk_units(net: Network, maxima: np.ndarray) -> np.ndarray:
    return np.maximum(maxima @ net.inner + net.inner_bias, 0)


def mean_of_chunks(units: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    return np.add.reduceat(units, first, axis=0) / chunks[:, None].astype(np.float32)


def scores(net: Network, texts: list[str | None]) -> np.ndarray:
    data, chunks, starts = padded(texts)
    units = chunk_units(net, chunk_maxima(net, data, int(starts[-1]) + 1)[starts])
    logit = mean_of_chunks(units, chunks) @ net.top + net.offset
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def _gradients(net: Network, texts: list[str | None], labels: np.ndarray) -> list[np.ndarray]:
    data, chunks, starts = padded(texts)
    view, rows = _answers(net, data, int(starts[-1]) + 1)
    view = view[starts]
    where = view.argmax(axis=2)
    plain = np.take_along_axis(view, where[:, :, None], axis=2)[:, :, 0] + net.bias
    maxima = np.maximum(plain, 0)
    units = chunk_units(net, maxima)
    mean = mean_of_chunks(units, chunks)
    guess = 1 / (1 + np.exp(-np.clip(mean @ net.top + net.offset, -30, 30)))
    error = ((guess - labels) / len(texts)).astype(np.float32)
    owner = np.repeat(np.arange(len(texts)), chunks)
    by_unit = (error / chunks.astype(np.float32))[owner, None] * net.top * (units > 0)
    back = ((by_unit @ net.inner.T) * (plain > 0)).astype(np.float32)
    place = where + (starts * CHUNK_STEP)[:, None]
    d_first = np.einsum("cf,cfk->kf", back, rows[place])
    d_second = np.einsum("cf,cfk->kf", back, rows[place + 1])
    d_embedding = np.zeros_like(net.embedding)
    codes = data[(place * HOP)[:, :, None] + np.arange(2 * HOP)]
    weights = np.concatenate([net.first, net.second]).T.reshape(FILTERS, 2 * HOP, DIMS)
    pull = back[:, :, None, None] * weights[None]
    for d in range(DIMS):
        d_embedding[:, d] = np.bincount(codes.ravel(), pull[..., d].ravel(), 256)
    top = [maxima.T @ by_unit, by_unit.sum(axis=0), mean.T @ error, error.sum(keepdims=True)]
    return [d_embedding, d_first, d_second, back.sum(axis=0), *top]


def train(
    texts: list[str], labels: list[int], steps: int = 800, batch: int = 32, rate: float = 0.008, decay: float = 0.01
) -> Network:
    """A network for labelled texts; the same rows in the same order give the same one.

    A batch holds three texts of label 1 to one of label 0.  The result is the mean of the
    networks of the last half of the steps, each older one counting a little less.
    """
    net, rng = Network.start(), np.random.default_rng(5)
    target = np.array(labels, np.float32)
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in net.arrays()]
    pools = [pool for label in (0, 1) if len(pool := np.flatnonzero(target == label))]
    turns = [np.concatenate([rng.permutation(p) for _ in range(steps * batch // len(p) + 1)]) for p in pools]
    shares = [batch // 4, batch - batch // 4] if len(pools) == 2 else [batch]
    mean = [a.copy() for a in net.arrays()]
    for step in range(1, steps + 1):
        some = np.concatenate([turn[(step - 1) * n : step * n] for turn, n in zip(turns, shares)])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))  # the second half ever smaller
        for a, g, m in zip(net.arrays(), _gradients(net, [texts[i] for i in some], target[some]), moments):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            a -= now * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
            a *= 1 - now * decay
        keep = 0.0 if 2 * step <= steps else 0.99
        mean = [keep * old + (1 - keep) * a for old, a in zip(mean, net.arrays())]
    return Network(*mean)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 1600) -> Network | None:
    """Train on labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.filter(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = known.select("doc_id", "quality").distinct().withColumn("nth", F.row_number().over(order))
    some = some.filter(F.col("nth") <= sample_docs * (1 + 2 * F.col("quality")))  # a bounded number of rows
    rows = (
        docs.filter(F.length("text") <= SAMPLE_MOST_CHARS)
        .join(F.broadcast(some), "doc_id")
        .select("doc_id", "text", "quality")
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.text or ""))
    return train([r.text or "" for r in rows], [r.quality for r in rows]) if rows else None


def scored(docs: DataFrame, net: Network | None, carried: Sequence[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the carried columns of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [np.full(len(texts), 0.5)] if held is None else [scores(held, some) for some in _runs(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *found])), *map(batch.column, carried)],
                names=["doc_id", "score", *carried],
            )

    given = docs.select("doc_id", "text", *carried)
    schema = T.StructType.fromDDL("doc_id long, score double")
    answered = given.mapInArrow(run, T.StructType([*schema, *(given.schema[c] for c in carried)]))
    return answered.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        *carried,
    )


def _runs(texts: list[str | None], most: int = 1 << 19) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "") + CHUNK * HOP
    if held:
        yield held


def classified(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: Sequence[str] = ()
) -> DataFrame:
    """Quality of every row, learned from the labelled rows that are not held out; carried columns stay beside it."""
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carried)
    net = fit(rows.select("doc_id", "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"))
    return scored(rows, net, carried)
