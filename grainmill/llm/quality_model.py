"""Operator 1: quality classifier, a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import binary_text
from grainmill.llm.training import labelled_sample

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 48, 16
#: A chunk is two neighbouring blocks of so many bytes; chunks overlap by one block.
BLOCK = 128
#: The bounded training sample: whole documents of each class, their bytes in all, and the longest that trains.
SAMPLE_PER_CLASS, SAMPLE_BYTES, LONGEST_BYTES = 1200, 16 << 20, 1 << 18
EPOCHS, BATCH = 6, 32
#: Bytes that a task convolves at a time.
PART = 1 << 18


class ConvNet:
    """score = sigmoid(mean and maximum over chunks of relu(U . max-pooled relu(filters) + c) . v + d).

    Filters read WIDTH embedded bytes every STRIDE bytes; all chunks of a text take part, however long it is.
    """

    NAMES = ("table", "filters", "bias", "u", "c", "v", "d")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *shape, s: r.normal(0, s, shape).astype(np.float32)
        self.table, self.filters, self.bias = g(256, EMBED, s=0.5), g(WIDTH * EMBED, FILTERS, s=0.18), np.zeros(FILTERS, np.float32)
        self.u, self.c = g(FILTERS, HIDDEN, s=0.2), np.zeros(HIDDEN, np.float32)
        self.v, self.d = g(2 * HIDDEN, s=0.3), np.zeros(1, np.float32)

    @staticmethod
    def padded(data: np.ndarray) -> np.ndarray:
        """Whole blocks, two at least, and the last filter's reach; filled with zero bytes."""
        blocks = max(2, -(-len(data) // BLOCK))
        return np.concatenate([data, np.zeros(blocks * BLOCK + WIDTH - STRIDE - len(data), np.uint8)])

    def patches(self, data: np.ndarray) -> np.ndarray:
        """Rows of WIDTH embedded bytes, one for each position of a filter."""
        embedded = self.table[data]
        n = (len(data) - WIDTH) // STRIDE + 1
        step = embedded.strides[0]
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, (n, WIDTH * EMBED), (STRIDE * step, embedded.strides[1])))

    def block_tops(self, data: np.ndarray) -> np.ndarray:
        """Greatest response of each filter in each block of a padded text."""
        out = []
        for at in range(0, len(data) - (WIDTH - STRIDE), PART):
            part = data[at : at + PART + WIDTH - STRIDE]
            responses = self.patches(part) @ self.filters
            out.append(responses.reshape(-1, BLOCK // STRIDE, FILTERS).max(1))
        return np.concatenate(out)

    def head(self, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the chunks of one text and its logit."""
        pooled = np.maximum(np.maximum(tops[:-1], tops[1:]) + self.bias, 0)
        hidden = np.maximum(pooled @ self.u + self.c, 0)
        return hidden, np.concatenate([hidden.mean(0), hidden.max(0)]) @ self.v + self.d[0]

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probabilities; texts are convolved together up to PART bytes at a time, a block of zeros behind each, so that no filter reads two texts."""
        out, group, size, reach = np.zeros(len(texts)), [], 0, WIDTH - STRIDE
        for i, t in enumerate(texts):
            group.append((i, np.concatenate([self.padded(t), np.zeros(BLOCK - reach, np.uint8)])))
            size += len(group[-1][1])
            if size >= PART or i + 1 == len(texts):
                tops, at = self.block_tops(np.concatenate([p for _, p in group] + [np.zeros(reach, np.uint8)])), 0
                for k, p in group:
                    n = len(p) // BLOCK
                    out[k] = self.head(tops[at : at + n - 1])[1]
                    at += n
                group, size = [], 0
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss, through the places of the maxima."""
        grads = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        for text, y, w in zip(texts, labels, weights, strict=True):
            data = self.padded(text)
            rows = self.patches(data)
            responses = (rows @ self.filters).reshape(-1, BLOCK // STRIDE, FILTERS)
            where = responses.argmax(1)
            tops = np.take_along_axis(responses, where[:, None], 1)[:, 0]
            late = tops[1:] > tops[:-1]
            best = np.where(late, tops[1:], tops[:-1]) + self.bias
            pooled = np.maximum(best, 0)
            before = pooled @ self.u + self.c
            hidden = np.maximum(before, 0)
            top = hidden.argmax(0)
            doc = np.concatenate([hidden.mean(0), hidden.max(0)])
            miss = np.float32(w * (1 / (1 + np.exp(-np.clip(doc @ self.v + self.d[0], -30, 30))) - y))
            grads["v"] += miss * doc
            grads["d"] += miss
            back = np.repeat(miss * self.v[None, :HIDDEN] / len(hidden), len(hidden), 0)
            back[top, np.arange(HIDDEN)] += miss * self.v[HIDDEN:]
            back = back * (before > 0)
            grads["u"] += pooled.T @ back
            grads["c"] += back.sum(0)
            back = (back @ self.u.T) * (best > 0)
            grads["bias"] += back.sum(0)
            chunk = np.arange(len(back))[:, None] + late
            place = chunk * (BLOCK // STRIDE) + where[chunk, np.arange(FILTERS)]
            flat, each = place.ravel(), back.ravel()
            on = np.flatnonzero(each)
            if not len(on):
                continue
            picked, which = rows[flat[on]], on % FILTERS
            hot = np.zeros((len(on), FILTERS), np.float32)
            hot[np.arange(len(on)), which] = each[on]
            grads["filters"] += picked.T @ hot
            to_bytes = (self.filters.T[which] * each[on, None]).reshape(-1, EMBED)
            seen = data[(flat[on] * STRIDE)[:, None] + np.arange(WIDTH)].ravel()
            for e in range(EMBED):
                grads["table"][:, e] += np.bincount(seen, to_bytes[:, e], 256).astype(np.float32)
        return grads


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 5, rate: float = 0.004) -> ConvNet:
    """Adam over shuffled batches; every epoch sees all chunks of each text."""
    net, r = ConvNet(seed), np.random.default_rng(seed)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    mean = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    square, step = {n: np.zeros_like(v) for n, v in mean.items()}, 0
    for epoch in range(epochs):
        order, pace = r.permutation(len(data)), rate * (1 - epoch / (epochs + 1))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            grads, step = net.gradients([data[i] for i in some], labels[some], weights[some] / len(some)), step + 1
            for n, g in grads.items():
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.99 * square[n] + 0.01 * g * g
                change = pace * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-7)
                setattr(net, n, (getattr(net, n) - change).astype(np.float32))
    return net


def score(docs: DataFrame, net: ConvNet, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score: one row for each row of docs, over whole texts. Null and empty texts are two blocks of zero bytes."""
    source = binary_text(docs, *keep)
    schema = source.drop("_bytes").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(net.scores(texts), pa.float64())], names=[*b.schema.names[:-1], "score"])

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs, with a network trained on a bounded sample of the other folds.

    Only the text is an input; extra columns, whatever their names, do not matter. Unlabelled documents and null labels
    do not train; repeated rows train once and are each scored, alike. A null doc_id is in no fold (held_out is null).
    Null and empty texts are scored as blocks of zero bytes; long texts whole. An empty table gives no rows. Without
    labelled documents of both classes every score is the share of label 1 (0.5 if none).
    """
    texts, y, w = labelled_sample(docs, labels, "quality", folds, held, SAMPLE_PER_CLASS, SAMPLE_BYTES, LONGEST_BYTES)
    held_out = F.crc32(F.col("doc_id").cast("string")) % folds == held
    if len(set(y.tolist())) == 2:
        out = score(docs, train(texts, y, w))
    else:
        out = docs.select("doc_id", F.lit(float(y.mean()) if len(y) else 0.5).alias("score"))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
