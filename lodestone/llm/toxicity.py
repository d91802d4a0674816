"""Toxicity: a linear classifier that is regularised by counterfactuals.

Features are the presence of hashed words and word beginnings (lower-cased, without marks around them). For each labelled
sentence that names an identity group, copies with the term swapped for others of its set are made; besides the logistic loss
and an L1 penalty, training minimises the squared change of score between a sentence and its copies, so a group's mention
alone moves no score. Neutral mentions, which labels seldom hold, are made too: a term of the set is added to labelled
sentences and swapped likewise. Fitted by accelerated proximal gradient descent in numpy on a bounded sample
(``sample`` labelled rows); the L1 penalty leaves few weights, so long clean texts gather no score from chance words.

Defined cases: a null or empty text scores as the bias alone; without any labelled row, or with one class only, the bias is that
class's smoothed share; rows with the same id count each for themselves, and so do repeated texts; of an id that is labelled twice
the higher label counts; a null id is never held out and has no label; texts of any length are read whole; equal texts have equal
scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

BITS = 20
#: Lengths in bytes of the word beginnings that are features besides the whole word.
BEGINNINGS = (4, 5, 6)
#: Groups of interchangeable identity terms; a parameter.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "natives", "refugees", "citizens"), ("deaf", "blind", "disabled"), ("old", "young"),
    ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)

_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"'()[]{}|*#$%&<>-_/\\")] = True


def features(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, row) by row."""
    start, end, row = C.words(off, raw)
    start, end, row = C.bare(raw, _MARKS, start, end, row)
    at = C.Prefix(raw, lower=True)
    ids, rows = [at(start, end)], [row]
    for n in BEGINNINGS:
        long = end - start > n
        ids.append(C.mix(at(start[long], start[long] + n) + np.uint64(n)))
        rows.append(row[long])
    f, r = np.concatenate(ids) >> np.uint64(64 - BITS), np.concatenate(rows)
    key = np.unique((r.astype(np.uint64) << np.uint64(BITS)) | f)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64)


def _of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return features(np.asarray([0, len(raw)]), raw)[0]


def term_features(terms: Sequence[Sequence[str]]) -> list[list[np.ndarray]]:
    return [[_of(t) for t in group] for group in terms]


class Model:
    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.index, self.weight, self.bias = index, weight, bias  # features in order

    def scores(self, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        if len(self.index) and len(raw):
            f, r = features(off, raw)
            at = np.minimum(np.searchsorted(self.index, f), len(self.index) - 1)
            hit = self.index[at] == f
            z += np.bincount(r[hit], weights=self.weight[at[hit]], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _without(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The ids that the sorted row lacks."""
    if not len(row):
        return ids
    at = np.minimum(np.searchsorted(row, ids), len(row) - 1)
    return ids[row[at] != ids]


def counterfactuals(rows: list[np.ndarray], groups: list[list[np.ndarray]], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features removed, features added) of swaps: all in rows that name a term, and of terms added to every row."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    every = np.unique(np.concatenate([t for group in groups for t in group]))
    named = [k for k, x in enumerate(rows) if len(_without(every, x)) < len(every)]
    for k in named:
        for group in groups:
            for i, own in enumerate(group):
                if len(_without(own, rows[k])):
                    continue
                for j, other in enumerate(group):
                    if j != i:
                        out.append((own[~np.isin(own, other)], _without(other[~np.isin(other, own)], rows[k])))
    rng = np.random.default_rng(seed)
    for x in rows:
        group = groups[rng.integers(len(groups))]
        i, j = rng.choice(len(group), 2, replace=False)
        out.append((_without(group[i], x), _without(group[j], x)))
        out.append((np.empty(0, np.int64), _without(group[i], x)))  # a neutral mention
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, l1: float = 3e-5, swap: float = 1.0, steps: int = 200, least: int = 3, screen: float = 3.0) -> Model:
    """rows: distinct features of each text. Only features of at least ``least`` texts take part, whose share of toxic texts
    lies ``screen`` standard deviations or more from the mean, and the identity terms' own."""
    n = len(rows)
    share = (float(y.sum()) + 0.5) / (n + 1)
    if not n or y.min() == y.max():
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    flat, length = np.concatenate(rows), np.asarray([len(r) for r in rows])
    index, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    pos = y.mean()
    toxic = np.bincount(inverse, weights=np.repeat(y, length), minlength=len(index))
    common = (count >= least) & (np.abs(toxic - count * pos) >= screen * np.sqrt(count * pos * (1 - pos)))
    if terms:
        common |= (count >= least) & np.isin(index, np.concatenate([t for group in term_features(terms) for t in group]))
    column = np.cumsum(common) - 1
    use = common[inverse]
    row = np.repeat(np.arange(n), length)[use]
    col = column[inverse][use]
    index = index[common]
    m = len(index)
    width = np.bincount(row, minlength=n)
    # swaps as differences of score: minus what goes, plus what comes
    pairs = counterfactuals(rows, term_features(terms)) if terms else []
    p_row, p_col, p_sign = [], [], []
    for k, (gone, come) in enumerate(pairs):
        for ids, sign in ((gone, -1.0), (come, 1.0)):
            at = np.searchsorted(index, ids)
            ok = (at < m) & (index[np.minimum(at, m - 1)] == ids) if m else np.zeros(len(ids), bool)
            p_row += [k] * int(ok.sum())
            p_col += at[ok].tolist()
            p_sign += [sign] * int(ok.sum())
    p_row, p_col, p_sign = np.asarray(p_row, np.int64), np.asarray(p_col, np.int64), np.asarray(p_sign)
    weight = np.where(y > 0, 0.5 / pos, 0.5 / (1 - pos)) / n  # the classes count alike
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    v, vb, t = w.copy(), b, 1.0
    # a diagonal bound of curvature keeps common features from setting the step of rare ones
    reach = np.bincount(col, weights=(weight * width)[row], minlength=m) * 0.25 + 1e-12
    if len(p_row):
        size = np.bincount(p_row, minlength=len(pairs))
        reach += swap * np.bincount(p_col, weights=size[p_row], minlength=m) / len(pairs)
    step, b_step = 1 / reach, 1 / (0.25 * float((weight * (1 + width)).sum()))
    for _ in range(steps):
        z = vb + np.bincount(row, weights=v[col], minlength=n)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.bincount(col, weights=e[row], minlength=m)
        if len(p_row):
            d = np.bincount(p_row, weights=p_sign * v[p_col], minlength=len(pairs))
            g += swap * np.bincount(p_col, weights=p_sign * d[p_row], minlength=m) / len(pairs)
        w2 = v - step * g
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * l1, 0)
        b2 = vb - b_step * float(e.sum())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        if float(((v - w2) * (w2 - w)).sum()) < 0:  # restart where the momentum overshoots
            v, vb, t2 = w2.copy(), b2, 1.0
        w, b, t = w2, b2, t2
    live = w != 0
    return Model(index[live], w[live], b)


def _sampled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    def run(batches):
        for b in C.slices(batches):
            off, raw = C.offsets_of(b.column(1))
            f, r = features(off, raw)
            cut = np.searchsorted(r, np.arange(len(off)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f.astype(np.int32)))], names=["doc_id", "y", "f"])

    found = C.labelled(docs, labels, label, mod, rest, sample).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, f array<int>").toArrow()
    found = found.take(pa.compute.sort_indices(found, [("doc_id", "ascending")]))
    f = found.column("f").combine_chunks()
    f = f if isinstance(f, pa.ListArray) else pa.concat_arrays(f.chunks) if f.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat, off = f.values.to_numpy(), f.offsets.to_numpy()
    return [flat[a:b].astype(np.int64) for a, b in zip(off[:-1], off[1:], strict=True)], found.column("y").to_numpy().astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, sample: int = 4_000, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, mod: int = 5, rest: int = 0) -> Model:
    """Learns from at most ``sample`` labelled rows not held out."""
    return fit(*_sampled(docs, labels, "toxic", mod, rest, sample), terms=terms)


def score(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, threshold: float = 0.5, **training) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, mod=mod, rest=rest, **training))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(*C.offsets_of(batch.column(1))))], names=["doc_id", "score"])

    found = C.map_text(docs, step, "doc_id long, score double")
    return found.select("doc_id", C.held_out(mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **training) -> DataFrame:
    """The documents, in their columns, that score below the threshold: one narrow pass, nothing is joined. A model that has learned
    no weight (no labels, or of one class only) tells no document from another and rejects none."""
    model = train(docs, labels, **training)
    if not len(model.index):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in C.slices(batches):
            yield b.filter(pa.array(shared.value.scores(*C.offsets_of(b.column(at))) < threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
