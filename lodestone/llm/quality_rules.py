"""Quality rules with risk-controlled cutoffs, tested jointly.

Every rule is a measure of a document that is worse the larger it is, with a fixed ladder of cutoffs from loose to strict.
The labelled documents that pass the base rule fall into two halves by a hash of the id.

1. Path. On the first half, over all strata, the rules' ladders are merged into one sequence of steps, each of which makes one
   rule stricter: next comes the run of steps of a rule that has the fewest good documents for each bad one among those that it
   adds to the rejected. A run that adds no more bad than good documents is left out, with all stricter ones of its rule.
2. Test. On the second half, for each stratum (language), the path is walked from its loose end. A step is taken as long as the
   exact binomial test, at level ``error / strata``, rejects "the steps so far together reject more than ``risk`` of the good
   documents". The tests of a stratum are in a fixed order, so they need no further correction; strata are corrected by Bonferroni.

So with probability 1 - ``error`` no stratum loses more than ``risk`` of its good documents to the learned cutoffs, whichever rule
rejects them. At the defaults, a stratum of s needs log(error / s) / log(1 - risk) good documents in the second half, 144 for
four strata; one with fewer gets no cutoff, and keeps what the base rules keep.

Defined cases: a null or empty text has no words and fails the base rule; a null language is a stratum of its own;
rows with the same id count each for themselves; a label of a repeated id is the largest, and a null one is none; without labels
there are no cutoffs; of steps that are equally good the earlier rule's comes first; a document on a cutoff is not rejected by it.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"
#: Rule: (measure, cutoffs from loose to strict).
LADDERS: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "upper": ("n_upper / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "marks": ("n_marks / greatest(n_words, 1)", (3.0, 2.5, 2.0, 1.5, 1.25, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
}

_SYMBOL, _UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?")] = True
_LETTER_START = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _twice(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a hash occurred earlier in its row, and whether it occurs more than once there."""
    order = np.lexsort((np.arange(len(h)), h, row))
    a, r = h[order], row[order]
    same = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
    later, multiple = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    multiple[order[1:]] |= same
    multiple[order[:-1]] |= same
    return later, multiple


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    off, raw = C.offsets_of(batch.column(1))
    rows = len(off) - 1
    start, end, row = C.words(off, raw)
    at = C.Prefix(raw)
    n_words = np.bincount(row, minlength=rows)
    inside = ~C._SEPARATES[raw]
    # lines: from a row's begin or the byte after a newline, to the next newline or the row's end
    breaks = np.flatnonzero(raw == 10)
    line_row = np.concatenate([np.arange(rows), np.searchsorted(off[1:], breaks, side="right")])
    line_start = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    line_end = np.concatenate([line_start[1:] - 1, [0]])
    last = np.concatenate([line_row[1:] != line_row[:-1], [True]])
    line_end[last] = off[1:][line_row[last]]
    has = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_row, line_start, line_end = line_row[has], line_start[has], line_end[has]
    later, _ = _twice(at(line_start, line_end), line_row)
    # words in windows of five that the row has again
    h = at(start, end)
    m = max(0, len(h) - 4)
    window = np.zeros(m, np.uint64)
    for j in range(5):
        window += h[j : j + m] * C._MULT[j]
    good = np.flatnonzero(row[:m] == row[4:]) if m else np.empty(0, np.int64)
    _, multiple = _twice(window[good], row[good])
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, good[multiple], 1)
    np.add.at(cover, good[multiple] + 5, -1)
    covered = np.cumsum(cover[:-1]) > 0
    long = lambda x: pa.array(x.astype(np.int64))
    columns = [n_words, _per_row(inside & _LETTER_START[raw], off), _per_row(_SYMBOL[raw], off), np.bincount(line_row[later], minlength=rows), np.bincount(row[covered], minlength=rows), np.bincount(line_row, minlength=rows), _per_row(_UPPER[raw], off), _per_row(_MARK[raw], off)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(long, columns)], names=[x.split()[0] for x in MEASURES.split(", ")])


def measures(docs: DataFrame) -> DataFrame:
    """The counts of every whole text, in one pass of numpy over its bytes."""
    return C.map_text(docs, _measure, MEASURES, F.col("lang").cast("string").alias("lang"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly, as a regularized incomplete beta by its continued fraction."""
    if k >= n:
        return 1.0
    return _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for i in range(1, 1_000_000):
        for top in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return min(1.0, front * f)


def learned_path(counts: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int]]:
    """The steps (rule, number of its cutoff), from rule: for each cutoff, how many good and bad documents it rejects."""
    at, path = dict.fromkeys(counts, 0), []
    while True:
        best: tuple[Fraction, int, str] | None = None
        for rule, rejected in counts.items():
            good, bad = rejected[at[rule] - 1] if at[rule] else (0, 0)
            for i in range(at[rule], len(rejected)):
                g, b = rejected[i][0] - good, rejected[i][1] - bad
                if b > g and (best is None or Fraction(g + 1, b + 1) < best[0]):
                    best = Fraction(g + 1, b + 1), i, rule
        if best is None:
            return path
        _, to, rule = best
        path += [(rule, i) for i in range(at[rule], to + 1)]
        at[rule] = to + 1


def steps_taken(n: int, rejected: list[int], risk: float, level: float) -> int:
    """How many steps are taken, where the first t + 1 together reject rejected[t] of n good documents."""
    for t, k in enumerate(rejected):
        if not n or binomial_at_most(k, n, risk) > level:
            return t
    return len(rejected)


def _first_step(path: list[tuple[str, int]]) -> Column:
    """The number of the first step of the path that rejects a document; null if none does."""
    rejects = [F.expr(LADDERS[rule][0]) > LADDERS[rule][1][i] for rule, i in path]
    return F.coalesce(F.lit(None).cast("int"), *[F.when(c, t) for t, c in enumerate(rejects)])


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.03, error: float = 0.05, tables: C.Tables | None = None) -> DataFrame:
    """The measures of every document with ``base_failed``, ``kept`` and ``failed_rule`` (null if kept or base_failed).

    One row of counts, and for each language and step a count, reach the driver."""
    tables = tables or C.Tables(docs.sparkSession)
    found = tables.keep(measures(docs).withColumn("base_failed", base_failed()), "measures").withColumn("stratum", F.coalesce("lang", F.lit("")))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality")).filter("quality is not null")
    known = found.filter("not base_failed").join(marked, "doc_id")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    tests = [(rule, i, F.expr(expr) > cut) for rule, (expr, cuts) in LADDERS.items() for i, cut in enumerate(cuts)]
    both = [F.count_if(c & (F.col("quality") == 1 if good else F.col("quality") != 1)).alias(f"{rule}_{i}_{good}") for rule, i, c in tests for good in (0, 1)]
    seen = known.filter(half == 0).agg(*both).first()
    path = learned_path({rule: [(seen[f"{rule}_{i}_1"], seen[f"{rule}_{i}_0"]) for i in range(len(cuts))] for rule, (_, cuts) in LADDERS.items()})
    step = _first_step(path)
    counts: dict[str, dict[int | None, int]] = {}
    for r in known.filter((half == 1) & (F.col("quality") == 1)).groupBy("stratum", step.alias("step")).count().collect():
        counts.setdefault(r["stratum"], {})[r["step"]] = r["count"]
    taken = {}
    for stratum, by_step in counts.items():
        rejected = [int(k) for k in np.cumsum([by_step.get(t, 0) for t in range(len(path))])]
        taken[stratum] = steps_taken(sum(by_step.values()), rejected, risk, error / len(counts))
    allowed = docs.sparkSession.createDataFrame(list(taken.items()), "stratum string, taken int")
    names = F.array(*[F.lit(rule) for rule, _ in path]) if path else F.array().cast("array<string>")
    out = found.join(F.broadcast(allowed), "stratum", "left").withColumn("step", step)
    out = out.withColumn("failed_rule", F.when(~F.col("base_failed") & (F.col("step") < F.col("taken")), F.get(names, F.col("step"))))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("stratum", "step", "taken")
