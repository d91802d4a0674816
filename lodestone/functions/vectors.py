"""Functions of array columns: arithmetic, norms, distances, errors. All are built-in expressions, so plans stay in the JVM.

Sums are left folds in double; a wrong length raises inside the expression itself, as ``zip_with`` would pad silently.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import Metric

INF = float("inf")


def vector(values: Sequence[float]) -> Column:
    """A literal array<float>."""
    return F.array(*[F.lit(float(v)).cast("float") for v in values]) if len(values) else F.array().cast("array<float>")


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def same_size(a: Column, b: Column, then: Column, empty_ok: bool = True) -> Column:
    out = F.when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("dimension mismatch: expected "), F.size(a).cast("string"), F.lit(", found "), F.size(b).cast("string"))))
    if not empty_ok:
        out = out.when(F.size(a) == 0, F.raise_error(F.lit("vectors must not be empty")))
    return out.otherwise(then)


def add(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x + y))


def sub(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x - y))


def scale(a: Column | str, by: float) -> Column:
    return F.transform(_col(a), lambda x: x * F.lit(float(by)).cast("float"))


def clamp(a: Column | str, low: float, high: float) -> Column:
    """NaN stays as it is."""
    lo, hi = F.lit(float(low)).cast("float"), F.lit(float(high)).cast("float")
    return F.transform(_col(a), lambda x: F.when(F.isnan(x), x).when(x < lo, lo).when(x > hi, hi).otherwise(x))


def _fold(a: Column, step) -> Column:
    return F.aggregate(a, F.lit(0.0), step)


def square_sum(a: Column | str) -> Column:
    return _fold(_col(a), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(square_sum(a))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return same_size(a, b, _fold(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), lambda s, d: s + d * d), empty_ok=False)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return same_size(a, b, _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda s, x: s + x), empty_ok=False)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 for a zero vector."""
    by = F.greatest(l2_norm(a) * l2_norm(b), F.lit(1e-12))
    return F.lit(1.0) - F.greatest(F.least(dot(a, b) / by, F.lit(1.0)), F.lit(-1.0))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine_distance(a, b)


def inner_product_distance(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b) + F.lit(0.0)


def distance(metric: Metric | str | int, a: Column | str, b: Column | str) -> Column:
    """L2 is squared."""
    return {Metric.L2: l2_squared, Metric.COSINE: cosine_distance, Metric.INNER_PRODUCT: inner_product_distance}[Metric.of(metric)](a, b)


def normalized(a: Column | str) -> Column:
    """Divided by its norm if that is over 1e-12, else unchanged."""
    a = _col(a)
    n = l2_norm(a)
    return F.when(n > F.lit(1e-12), F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


# errors of a reconstruction


def _differences(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def mse(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return same_size(a, b, F.when(F.size(a) == 0, F.lit(0.0)).otherwise(_fold(_differences(a, b), lambda s, d: s + d * d) / F.size(a)))


def mae(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return same_size(a, b, F.when(F.size(a) == 0, F.lit(0.0)).otherwise(_fold(_differences(a, b), lambda s, d: s + F.abs(d)) / F.size(a)))


def max_abs_error(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.coalesce(F.array_max(F.transform(_differences(a, b), F.abs)), F.lit(0.0))


def snr_db(a: Column | str, b: Column | str) -> Column:
    """Infinite without noise, 0 without signal."""
    a, b = _col(a), _col(b)
    n = F.greatest(F.size(a), F.lit(1))
    noise, signal = _fold(_differences(a, b), lambda s, d: s + d * d) / n, square_sum(a) / n
    return same_size(a, b, F.when(noise < 1e-12, F.lit(INF)).when(signal < 1e-12, F.lit(0.0)).otherwise(10 * F.log10(signal / noise)))


def compression_ratio(original: Column, compressed: Column) -> Column:
    return F.when(compressed == 0, F.lit(INF)).otherwise(original.cast("double") / compressed)


def theoretical_max_error(span: Column | float) -> Column:
    return (span if isinstance(span, Column) else F.lit(float(span))) / F.lit(255.0)


def theoretical_mse_uniform(span: Column | float) -> Column:
    step = theoretical_max_error(span)
    return step * step / F.lit(12.0)


def align_up(pos: int, align: int) -> int:
    return pos if align == 0 else math.ceil(pos / align) * align
