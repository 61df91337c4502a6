"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A text is the mean of learned vectors of its words, of its word bigrams, of the patterns of two or three words in a row in which
one comes back (aa, aba, aab, ...: repetition shows in words never learned, too), and of the character n-grams within and at the edges of words,
all hashed into BUCKETS rows; a softmax layer gives the class. Case and signs are kept, as they tell shouted or garbled text.

Training takes at most TRAIN_ROWS labelled rows (broadcast as doc_id and label; their texts come to the driver as counted
buckets, whole texts all the same). As the output layer is linear, a bucket's share in the logit is one number, so scoring a
text is one gather and one sum, with no shuffle.

Defined cases: a null text counts as empty; an empty text has the zero vector and so the score of the bias alone; rows
that repeat a doc_id are scored each; without labels of both kinds every score is the share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import held_out, labelled_texts, training_rows
from ._shared import alone, table
from ._text import NOT_SPACE, U, Words, buffers, mix, pieces, stream

TRAIN_ROWS, BITS, DIM, EPOCHS, RATE, GRAMS = 5_000, 17, 16, 6, 0.25, (3, 4)
BUCKETS = 1 << BITS
_mult = stream(53, 8)


def buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the features of the texts, words and bigrams first, then n-grams by size: (bucket of each feature, offsets by text)."""
    buf, off = buffers(texts)
    w = Words(buf, off, NOT_SPACE, fold=False)
    yield (w.hash >> U(64 - BITS)).astype(np.int64), w.at
    doc = w.doc()
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    h = w.hash
    yield (mix(h[second - 1] * _mult[7] + h[second]) >> U(64 - BITS)).astype(np.int64), np.searchsorted(second, w.at)
    third = np.flatnonzero(doc[2:] == doc[:-2]) + 2
    for at, pattern in ((second, (h[second] == h[second - 1]).astype(U)), (third, (h[third] == h[third - 1]) + (h[third] == h[third - 2]) * U(2) + (h[third - 1] == h[third - 2]) * U(4) + U(8))):
        some = (pattern & U(7)) > 0
        yield (mix(pattern[some] * _mult[6]) >> U(64 - BITS)).astype(np.int64), np.searchsorted(at[some], w.at)
    first = (buf & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(first)])[off]
    text = buf.tobytes().decode("utf-8", "replace").encode("utf-32-le")
    c = np.frombuffer(text, np.uint32)
    space = (c == 0x20) | ((c >= 0x09) & (c <= 0x0D))
    x = np.where(space, U(0x20), c.astype(U)) + U(1)
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
            continue
        h = x[:m] * _mult[0]
        for k in range(1, n):
            h += x[k : k + m] * _mult[k]
        ok = np.ones(m, bool)
        for k in range(1, n - 1):
            ok &= ~space[k : k + m]
        for k in range(1, n):
            e = at[1:] - k
            ok[e[(e >= 0) & (e < m)]] = False
        place = np.flatnonzero(ok)
        yield ((h[place] * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int64), np.searchsorted(place, at)


def counted(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its distinct buckets and how often each occurs."""
    parts = list(buckets(texts))
    return [np.unique(np.concatenate([f[at[i] : at[i + 1]] for f, at in parts]), return_counts=True) for i in range(len(texts))]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, "text"):
            got = counted(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([x.astype("<i4").tobytes() for x, _ in got], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in got], pa.binary())],
                ["doc_id", "y", "bucket", "n"],
            )


class Model:
    """A bucket's share in the logit of label 1, and the bias."""

    def __init__(self, share: np.ndarray | None, bias: float):
        self.share, self.bias = share, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        if self.share is not None:
            for f, at in buckets(texts):
                total += np.diff(np.concatenate([[0.0], np.cumsum(self.share[f], dtype=np.float64)])[at])
                n += np.diff(at)
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(n, 1))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5) -> Model:
    """rows: label, distinct buckets, their counts."""
    y = np.array([r[0] for r in rows])
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(None, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    order, step, steps = np.arange(len(rows)), 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            label, f, n = rows[i]
            if not len(f):
                continue
            n = n / n.sum()
            v = n @ table_[f]
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            # the gradient of a mean is thin over the many buckets of a text, so buckets learn at a higher rate than the layer above
            back = (rate * 20) * (p @ out)
            out -= rate * np.outer(p, v)
            bias -= rate * np.float32(0.1) * p
            table_[f] -= np.outer(n, back)
    return Model((table_ @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, most: int = TRAIN_ROWS) -> Model:
    """A model of labels.quality; rows with crc32(doc_id) mod modulus = rest are not learned from."""
    texts = labelled_texts(docs, training_rows(labels, "quality", modulus, rest, most))
    got = texts.mapInArrow(_counted, "doc_id long, y int, bucket binary, n binary").toArrow().sort_by([("doc_id", "ascending"), ("bucket", "ascending")])
    rows = [(y, np.frombuffer(f.as_py(), "<i4"), np.frombuffer(n.as_py(), "<f4")) for y, f, n in zip(got["y"].to_pylist(), got["bucket"], got["n"], strict=True)]
    return train(rows)


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(b.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = alone(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = quality(docs, fit(docs, alone(table(spark, sf_dir, "labels"), "doc_id", "quality")))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL: dict[str, str] = {}
