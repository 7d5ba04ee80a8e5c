"""Operator 4: toxicity, subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import RollingHash, binary_text, byte_slices, lowered, word_spans
from grainmill.llm.training import labelled_sample

#: Hash buckets of subwords, their embedding, and lengths of n-grams in characters.
BUCKETS, EMBED, SHORTEST, LONGEST = 1 << 18, 8, 3, 6
#: The bounded training sample: whole documents of each class, their bytes in all, and the longest that trains.
SAMPLE_PER_CLASS, SAMPLE_BYTES, LONGEST_BYTES = 2500, 24 << 20, 1 << 20
#: Bytes that a task takes apart at a time.
TILE = 2 << 20
#: The same in training.
TRAIN_PART = 1 << 18
EPOCHS, BATCH = 10, 32
#: What a missed toxic document costs in training, in wrongly flagged ones.
MISS_COST = 3.0
#: Subwords of fewer training documents have no embedding of their own: they would only tell single documents apart.
LEAST_DOCS = 3
#: A document's mean is taken times SCALE, so that a few words in a hundred can decide; SHRINK draws embeddings to 0.
SCALE, SHRINK = 40.0, 0.002
_EDGE = np.isin(np.arange(128), np.frombuffer(b".,!?;:\"'()[]", np.uint8))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows and where each row begins among them; rows that are no UTF-8 are taken byte by byte."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return data.astype(np.uint32), offsets
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[offsets]


def words_of(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: what stands between white space, without punctuation at its ends (unless it is nothing else)."""
    start, stop, begin = word_spans(points, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    inner = np.flatnonzero(~_EDGE[np.minimum(points, 127)])
    if len(inner):
        first = np.searchsorted(inner, start)
        last = np.searchsorted(inner, stop) - 1
        some = last >= first
        start, stop = np.where(some, inner[np.minimum(first, len(inner) - 1)], start), np.where(some, inner[np.maximum(last, 0)] + 1, stop)
    return start, stop, row


def subwords(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of <word> and of each longer <word> as a whole; ASCII letters in lower case."""
    size = stop - start + 2
    edge = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    which = np.repeat(np.arange(len(size)), size)
    marked = lowered(points)[np.clip(np.repeat(start, size) + at - 1, 0, max(len(points) - 1, 0))]
    marked[edge[:-1]], marked[edge[1:] - 1] = 60, 62
    rolling, words, spans = RollingHash(marked), [], []
    for n in range(SHORTEST, LONGEST + 1):
        here = np.flatnonzero(at + n <= size[which])
        words.append(which[here])
        spans.append(rolling.spans(here, here + n))
    long = np.flatnonzero(size > LONGEST)
    words.append(long)
    spans.append(rolling.spans(edge[long], edge[long + 1]))
    return np.concatenate(words), (np.concatenate(spans) >> np.uint64(20)).astype(np.int64) % BUCKETS


def distinct_words(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and one place of each distinct word, and each word's number among them."""
    return np.unique(RollingHash(lowered(points)).spans(start, stop), return_index=True, return_inverse=True)


class Bag:
    """Document = SCALE times the mean of its words; word = mean of its subword embeddings; softmax over two classes of a linear map.

    The mean of a document is over its distinct words, by the roots of their counts, so that function words do not drown the rest.
    """

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.vectors = np.zeros((BUCKETS, EMBED), np.float32)
        self.map, self.bias = r.normal(0, 0.3, (EMBED, 2)).astype(np.float32), np.zeros(2, np.float32)

    def word_weights(self) -> np.ndarray:
        """Of each bucket: what it adds to the difference of the two logits. The model is linear in the embeddings, so a subword is one number."""
        return (self.vectors @ (self.map[:, 1] - self.map[:, 0])).astype(np.float64)


def _bag_parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, bucket and share in the document's mean, of the whole bags of some texts at a time."""
    for i, j, data, off in byte_slices(pa.array(texts, pa.large_binary()), TRAIN_PART):
        points, begin = characters(data, off)
        start, stop, row = words_of(points, begin)
        if not len(start):
            continue
        _, first, number = distinct_words(points, start, stop)
        word, bucket = subwords(points, start[first], stop[first])
        bucket, grams = bucket[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(first))
        place = np.concatenate([[0], np.cumsum(grams)])
        pair, times = np.unique(row * len(first) + number, return_counts=True)
        doc, of = np.divmod(pair, len(first))
        root = np.sqrt(times)
        share, each = root / np.bincount(doc, root, j - i)[doc] / grams[of], grams[of]
        flat = np.repeat(place[of] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        key, at = np.unique(np.repeat(doc, each) * BUCKETS + bucket[flat], return_inverse=True)
        yield (key // BUCKETS + i).astype(np.int32), (key % BUCKETS).astype(np.int32), np.bincount(at, np.repeat(share, each), len(key)).astype(np.float32)


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, the buckets of its whole bag with their shares in its mean: document, bucket, share, in order of document.

    Only buckets of at least LEAST_DOCS texts are kept (counted in a pass of its own, so that the others are never
    held); the others keep their place in the mean, with nothing to add.
    """
    seen = np.zeros(BUCKETS, np.int32)
    for _, bucket, _ in _bag_parts(texts):
        seen += np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
    kept = [(d[k], b[k], v[k]) for d, b, v in _bag_parts(texts) for k in [seen[b] >= LEAST_DOCS]]
    if not kept:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 3, rate: float = 0.1) -> Bag:
    """Adagrad over embeddings and map together, on the whole bag of each text in every epoch."""
    weights = weights * np.where(labels == 1, MISS_COST, 1)
    net, r = Bag(seed), np.random.default_rng(seed)
    doc, bucket, share = bags(texts)
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    seen, seen_map, seen_bias = np.full((BUCKETS, 1), 1e-8, np.float32), np.full((EMBED, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(epochs):
        pace, order = rate * (1 - epoch / epochs), r.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            n = edge[some + 1] - edge[some]
            flat = np.repeat(edge[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            row, place, x = np.repeat(np.arange(len(some)), n), bucket[flat], SCALE * share[flat]
            hidden = np.stack([np.bincount(row, x * net.vectors[place, e], len(some)) for e in range(EMBED)], 1).astype(np.float32)
            logits = hidden @ net.map + net.bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(len(some)), labels[some].astype(int)] -= 1
            miss = odds * weights[some][:, None] / len(some)
            g_map, g_bias, back = hidden.T @ miss, miss.sum(0), miss @ net.map.T
            used, where = np.unique(place, return_inverse=True)
            g = np.stack([np.bincount(where, x * back[row, e], len(used)) for e in range(EMBED)], 1).astype(np.float32)
            seen[used] += (g * g).mean(1, keepdims=True)
            net.vectors[used] -= pace * (g / np.sqrt(seen[used]) + SHRINK * net.vectors[used])
            seen_map += g_map**2
            seen_bias += g_bias**2
            net.map -= pace / 2 * g_map / np.sqrt(seen_map)
            net.bias -= pace / 2 * g_bias / np.sqrt(seen_bias)
    return net


def distinct_weights(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word (its hash), weight and count of each distinct word of each row."""
    points, begin = characters(data, offsets)
    start, stop, row = words_of(points, begin)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    name, first, number = distinct_words(points, start, stop)
    word, bucket = subwords(points, start[first], stop[first])
    each = np.bincount(word, weights[bucket], len(first)) / np.bincount(word, minlength=len(first))
    pair, times = np.unique(row * len(first) + number, return_counts=True)
    row, number = np.divmod(pair, len(first))
    return row, name[number], each[number], times


def mean_words(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row: the mean weight of its distinct words, by the roots of their counts; 0 without words."""
    row, _, each, times = distinct_weights(weights, data, offsets)
    root = np.sqrt(times)
    total = np.bincount(row, root, len(offsets) - 1)
    return np.bincount(row, root * each, len(offsets) - 1) / np.where(total > 0, total, 1)


def tiles(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Pieces of one text of at most `most` bytes, cut at white space, or between characters where there is none."""
    at = 0
    while len(data) - at > most:
        part = data[at : at + most]
        spaces = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        end = at + (int(spaces[-1]) + 1 if len(spaces) else most)
        while not len(spaces) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end
    yield data[at:]


def mean_of_long(weights: np.ndarray, data: np.ndarray, most: int) -> float:
    """mean_words of one long text, of whose pieces only the distinct words are kept."""
    name, each, times = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    for part in tiles(data, most):
        _, n, e, t = distinct_weights(weights, part, np.array([0, len(part)]))
        name, first, at = np.unique(np.concatenate([name, n]), return_index=True, return_inverse=True)
        each, times = np.concatenate([each, e])[first], np.bincount(at, np.concatenate([times, t])).astype(np.int64)
    root = np.sqrt(times)
    return float((root * each).sum() / root.sum()) if len(root) else 0.0


def score(docs: DataFrame, net: Bag, keep: tuple[str, ...] = ("doc_id",), tile: int = TILE) -> DataFrame:
    """keep and score: one row for each row of docs, over all words of whole texts. Null, empty and blank texts have the bias alone.

    Texts longer than a tile are taken apart piece by piece; of them a run without white space that is longer than a
    tile counts as several words. Further columns of docs do not matter.
    """
    source = binary_text(docs, *keep)
    schema = source.drop("_bytes").withColumn("score", F.lit(0.0)).schema
    weights, bias = net.word_weights(), float(net.bias[1] - net.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean = [np.zeros(0)]
            for i, j, data, off in byte_slices(b.column(b.num_columns - 1), tile):
                mean.append(np.array([mean_of_long(weights, data, tile)]) if j == i + 1 and len(data) > tile else mean_words(weights, data, off))
            odds = np.clip(bias + SCALE * np.concatenate(mean), -30, 30)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-odds)), pa.float64())], names=[*b.schema.names[:-1], "score"])

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs, with a model trained on a bounded sample of the other folds.

    Only the text is an input; extra columns, whatever their names, do not matter. Unlabelled documents and null labels
    do not train; repeated rows train once and are each scored, alike. A null doc_id is in no fold (held_out is null).
    Null and empty texts are scored as texts without words; long texts whole. An empty table gives no rows. Without
    labelled documents of both classes every score is the share of label 1 (0.5 if none).
    """
    texts, y, w = labelled_sample(docs, labels, "toxic", folds, held, SAMPLE_PER_CLASS, SAMPLE_BYTES, LONGEST_BYTES)
    held_out = F.crc32(F.col("doc_id").cast("string")) % folds == held
    if len(set(y.tolist())) == 2:
        out = score(docs, train(texts, y, w))
    else:
        out = docs.select("doc_id", F.lit(float(y.mean()) if len(y) else 0.5).alias("score"))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
