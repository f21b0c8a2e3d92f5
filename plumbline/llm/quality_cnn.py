"""Quality score of a text by a convolutional network over its bytes, in numpy.

Learned filters of ``TAPS`` bytes run over overlapping chunks that cover the whole text; each filter's largest response
in a chunk is its feature there, and the means and maxima of the features over all chunks go through a logistic unit to
one probability. A filter is a table from (tap, byte) to weight, so that the response at a place is a sum of look-ups,
and its gradient falls on the bytes under the chunk's maximum alone.

The network is trained on the driver with Adam on ``TRAIN_ROWS`` labelled rows at most, whose whole texts go into it in the
same chunks as in scoring; their responses are worked out ``SLICE`` chunks at a time, however long a text is.

Edge cases: a null or empty text has no chunk and scores as the unit's bias says; without labels of both kinds the score
is the share of label 1 (a half without labels); repeated rows each get the same score; an empty table gives an empty
result; a label without a document isn't used; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import arrays
from plumbline.llm.common import small_batches, table, text_bytes

TAPS, FILTERS = 6, 16
CHUNK, STEP = 512, 448
TRAIN_ROWS, SLICE = 6000, 512
EPOCHS, BATCH, RATE, DECAY, SEED = 14, 64, 0.01, 1e-4, 7
CUT = 0.3
PIECE_BYTES = 256 << 10
Batches = Iterator[pa.RecordBatch]


@dataclass
class Network:
    filters: np.ndarray  # TAPS x 256 x FILTERS
    shift: np.ndarray  # FILTERS
    unit: np.ndarray  # 2 FILTERS, for means and maxima
    bias: float

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Responses at every place of ``data`` that has ``TAPS`` bytes."""
        n = len(data) - TAPS + 1
        out = self.filters[0][data[:n]]
        for k in range(1, TAPS):
            out += self.filters[k][data[k : k + n]]
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of every text."""
        n, size = len(offsets) - 1, np.diff(offsets)
        out = np.full(n, self.bias)
        some = np.flatnonzero(size)
        if len(some):
            # Zeros after each text, so that every byte begins a window and none reaches into the next text.
            padded = np.zeros(len(data) + n * (TAPS - 1) + 1, np.uint8)
            base = offsets[:-1] + np.arange(n) * (TAPS - 1)
            padded[arrays.expand(base, size)] = data
            response = self.responses(padded)
            number = np.maximum(1, -(-(size[some] - (CHUNK - STEP)) // STEP))
            doc = np.repeat(some, number)
            start = arrays.expand(np.zeros(len(some), np.int64), number) * STEP
            stop = np.minimum(start + CHUNK, size[doc])
            ends = np.empty(2 * len(doc), np.int64)
            ends[0::2], ends[1::2] = base[doc] + start, base[doc] + stop
            pooled = np.maximum(np.maximum.reduceat(response, ends)[0::2] + self.shift, 0)
            first = np.cumsum(number) - number
            mean = np.add.reduceat(pooled, first) / number[:, None]
            most = np.maximum.reduceat(pooled, first)
            out[some] = np.concatenate([mean, most], 1) @ self.unit + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted to texts given as lists of chunks."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net = Network(
        rng.normal(0, 0.25, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), float(np.log(share / (1 - share)))
    )
    if len(set(labels.tolist())) < 2:
        net.unit[:] = 0
        return net
    params = [net.filters, net.shift, net.unit, np.array([net.bias], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    full = [np.zeros((len(t), CHUNK + TAPS - 1), np.uint8) for t in texts]
    sizes = [np.array([max(1, len(c)) for c in t]) for t in texts]
    for block, chunks in zip(full, texts, strict=True):
        for k, c in enumerate(chunks):
            block[k, : len(c)] = np.frombuffer(c, np.uint8)
    # A weight for label 0 that makes the cut the point where both errors cost the same.
    weight = np.where(labels == 0, (1 - CUT) / CUT, 1.0)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            data, size = np.concatenate([full[i] for i in pick]), np.concatenate([sizes[i] for i in pick])
            number = np.array([len(full[i]) for i in pick])
            at, raw = np.empty((len(data), FILTERS), np.int64), np.empty((len(data), FILTERS), np.float32)
            for a in range(0, len(data), SLICE):
                some, room = data[a : a + SLICE], size[a : a + SLICE]
                response = net.responses(some.ravel())
                response = np.concatenate([response, np.zeros((TAPS - 1, FILTERS), np.float32)]).reshape(len(some), -1, FILTERS)[:, :CHUNK]
                response[np.arange(CHUNK)[None] >= room[:, None]] = -1e9
                at[a : a + SLICE] = response.argmax(1)
                raw[a : a + SLICE] = np.take_along_axis(response, at[a : a + SLICE, None], 1)[:, 0] + net.shift
            pooled = np.maximum(raw, 0)
            begin = np.cumsum(number) - number
            mean, most = np.add.reduceat(pooled, begin) / number[:, None], np.maximum.reduceat(pooled, begin)
            features = np.concatenate([mean, most], 1)
            p = 1 / (1 + np.exp(-np.clip(features @ net.unit + params[3][0], -30, 30)))
            d = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            d_features = d[:, None] * net.unit
            of = np.repeat(np.arange(len(pick)), number)
            d_pooled = d_features[of, :FILTERS] / number[of][:, None] + d_features[of, FILTERS:] * (pooled == most[of])
            d_pooled = np.where(raw > 0, d_pooled, 0).astype(np.float32)
            d_filters = np.zeros_like(net.filters)
            rows, cols = np.repeat(np.arange(len(data)), FILTERS), np.tile(np.arange(FILTERS), len(data))
            for k in range(TAPS):
                np.add.at(d_filters[k], (data[rows, at.ravel() + k], cols), d_pooled.ravel())
            grads = [d_filters + DECAY * net.filters, d_pooled.sum(0), features.T @ d + DECAY * net.unit, np.array([d.sum()])]
            step += 1
            rate = RATE * min(1.0, 2 * (1 - (epoch * len(order) + lo) / (epochs * len(order))))
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.bias = float(params[3][0])
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_chunks(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[list[list[bytes]], np.ndarray]:
    """Chunks and labels of at most ``rows`` labelled documents that aren't held out, in order of a hash of their id."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    picked = picked.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.join(F.broadcast(picked), "doc_id").select("quality", "doc_id", text_bytes(F.col("text")).alias("t"))
    number = F.greatest(F.lit(1), F.ceil((F.octet_length("t") - (CHUNK - STEP)) / STEP).cast("int"))
    cut = text.withColumn("chunks", F.transform(F.sequence(F.lit(0), number - 1), lambda k: F.substring("t", k * STEP + 1, F.lit(CHUNK))))
    # Rows that share a doc_id would exceed the bound: one of them counts.
    got = cut.where("octet_length(t) > 0").groupBy("doc_id").agg(F.max_by(F.struct("quality", "chunks"), F.md5("t")).alias("r")).orderBy("doc_id").select("r.*").collect()
    return [[bytes(c) for c in r["chunks"]] for r in got], np.array([int(r["quality"]) for r in got], np.float64)


def score_texts(net: Network) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches, most=PIECE_BYTES):
            score = net.scores(*arrays.buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(np.float64))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(score_texts(net), "doc_id long, score double")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = train(*training_chunks(docs, labels, TRAIN_ROWS))
    return score(docs, net).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
