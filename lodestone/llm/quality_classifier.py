"""Quality: supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams hash into buckets, each with a learned vector; a document is the mean of
its features' vectors, and a softmax over two outputs gives the score. Trained by stochastic gradient descent in numpy on a
bounded sample of ``sample`` labelled rows, each with all its features. They reach the driver compressed and are unpacked one
at a time, so it holds a few bytes for each distinct feature of a text.
A pair of equal words has one bucket of its own, whatever the word, since repetition is what matters there.

As the outputs are linear in the mean, scoring needs one number for each bucket, the difference of its two outputs.

Defined cases: a null or empty text scores as the learned bias alone; without labels or with one class only, the bias is that
class's smoothed share; rows with the same id count each for themselves, and so do repeated texts; of an id that is labelled twice
the higher label counts; a null id is never held out and has no label; texts of any length are read whole; equal texts have equal
scores; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

BITS = 18
NGRAMS = (3, 4)
_REPEAT = np.uint64(1)


def features(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature occurrence: words, pairs, and n-grams of characters inside a row."""
    start, end, row = C.words(off, raw)
    at = C.Prefix(raw)
    h = at(start, end)
    ids, rows = [h >> np.uint64(64 - BITS)], [row]
    if len(h) > 1:
        near = row[1:] == row[:-1]
        a, b = h[:-1][near], h[1:][near]
        pair = C.mix(a * C._MULT[0] + b * C._MULT[1]) >> np.uint64(64 - BITS)
        ids.append(np.where(a == b, _REPEAT, pair))
        rows.append(row[1:][near])
    # characters begin at bytes that continue none; ends are the next characters' beginnings
    edge = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    of = np.searchsorted(off[1:], edge[:-1], side="right")
    for n in NGRAMS:
        if len(edge) > n:
            inside = np.flatnonzero(edge[n:] <= off[1:][of[: len(edge) - n]])
            ids.append(C.mix(at(edge[inside], edge[inside + n]) + np.uint64(n)) >> np.uint64(64 - BITS))
            rows.append(of[inside])
    return np.concatenate(ids).astype(np.int64), np.concatenate(rows)


def _packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending distinct buckets as differences, and their counts."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), counts]).astype("<i4").tobytes(), 1)


class Rows:
    """A sequence of (distinct buckets, counts), unpacked when asked for."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        gaps, counts = np.frombuffer(zlib.decompress(self.packed[i]), "<i4").reshape(2, -1)
        return np.cumsum(gaps), counts


class Model:
    def __init__(self, scalar: np.ndarray, bias: float):
        self.scalar, self.bias = scalar, bias

    def scores(self, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        z = np.full(n, self.bias)
        if len(raw) and len(self.scalar):
            f, r = features(off, raw)
            total = np.bincount(r, weights=self.scalar[f], minlength=n)
            z += total / np.maximum(np.bincount(r, minlength=n), 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: Rows, y: np.ndarray, dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 11) -> Model:
    """rows: (distinct buckets, counts) of each text."""
    n = len(rows)
    share = (float(y.sum()) + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Model(np.empty(0), bias)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    out_bias = np.asarray([0.0, bias], np.float32)
    total, done = epochs * n, 0
    for _ in range(epochs):
        for i in rng.permutation(n):
            ids, count = rows[i]
            lr = rate * (1 - done / total)
            done += 1
            if not len(ids):
                continue
            part = (count / count.sum()).astype(np.float32)
            v = vectors[ids]
            hidden = part @ v
            z = hidden @ out + out_bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            grad = out @ p
            out -= lr * 0.5 * np.outer(hidden, p)
            out_bias -= lr * 0.02 * p
            # vectors of a mean move by their share of it, scaled so that a feature's rate does not vanish in long texts
            vectors[ids] = v - (lr * np.sqrt(part))[:, None] * grad
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(out_bias[1] - out_bias[0]))


def _sampled(docs: DataFrame, labels: DataFrame, mod: int, rest: int, sample: int) -> tuple[Rows, np.ndarray]:
    def run(batches):
        for b in C.slices(batches):
            packed = []
            f, r = features(*C.offsets_of(b.column(1)))
            order = np.argsort(r, kind="stable")
            bounds = np.searchsorted(r[order], np.arange(b.num_rows + 1))
            for i in range(b.num_rows):
                packed.append(_packed(*np.unique(f[order[bounds[i] : bounds[i + 1]]], return_counts=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], names=["doc_id", "y", "f"])

    found = C.labelled(docs, labels, "quality", mod, rest, sample).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, f binary").toArrow()
    rows = sorted(zip(*[found.column(i).to_pylist() for i in range(3)], strict=True), key=lambda r: (r[0], r[1]))
    return Rows([r[2] for r in rows]), np.asarray([r[1] for r in rows], np.float64)


def score(docs: DataFrame, labels: DataFrame, sample: int = 3_000, mod: int = 4, rest: int = 2, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. Learns from at most ``sample`` labelled rows not held out."""
    model = fit(*_sampled(docs, labels, mod, rest, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(*C.offsets_of(batch.column(1))))], names=["doc_id", "score"])

    found = C.map_text(docs, step, "doc_id long, score double")
    return found.select("doc_id", C.held_out(mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
