"""Per-dimension affine ranges: fitting them, and coding vectors to 8 bits and back.

Fits are one pass: each task reduces its Arrow batches in numpy, and one row for each dimension and task is shuffled, whatever the
row count. Coding tables is a narrow pass over Arrow batches, a few vectorized steps for a whole batch; the same as column
expressions (``codes``, ``values``) is there for plans that combine them, and is what the passes are tested against. Arithmetic is in
32-bit floats, so codes are reproducible.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import check_dims
from lodestone.errors import DimensionMismatch, EmptyDataset, InvalidHeader, QuantizationOverflow
from lodestone.functions.vectors import finite, vector

#: Fixed values of the codes: a range below EPSILON is degenerate; a degenerate value within NEAR of the minimum is code 0.
EPSILON, NEAR, LEVELS = 1.1920929e-7, 1e-6, 255.0


def rows_of(v: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column that are not null, as a matrix."""
    flat, n = v.flatten(), len(v) - v.null_count
    lengths = v.value_lengths().drop_null().to_numpy()
    if n and (lengths != dims).any():
        raise DimensionMismatch(dims, int(lengths[lengths != dims][0]))
    return flat.to_numpy(zero_copy_only=False).reshape(n, dims)


def _lists(like: pa.Array, x: np.ndarray) -> pa.Array:
    """The matrix's rows as lists, null where ``like`` is."""
    there = np.ones(len(like), bool) if not like.null_count else like.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(there)]) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel()), mask=pa.array(~there))


def _f(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def code_of(x: Column, low: Column, high: Column, degenerate: str = "sided") -> Column:
    """The code of a value. ``degenerate``: "sided" gives 255 above a degenerate range, "zero" never does."""
    span = high - low
    flat = F.when(F.abs(x - low) < _f(NEAR), F.lit(0)).when(x < low, F.lit(0)).when(x > high, F.lit(255)).otherwise(F.lit(0)) if degenerate == "sided" else F.lit(0)
    share = F.least(F.greatest(((x - low) / span).cast("float"), _f(0)), _f(1))
    code = F.when(~finite(x), F.raise_error(F.lit("quantization overflow: value is not finite"))).when(~finite(span), F.raise_error(F.lit("quantization overflow: range is not finite")))
    return code.when(F.abs(span) < _f(EPSILON), flat).otherwise(F.floor(share * _f(LEVELS)).cast("int")).cast("short")


def value_of(code: Column, low: Column, high: Column) -> Column:
    span = high - low
    out = low + (code.cast("float") / _f(LEVELS)).cast("float") * span
    return F.when(F.abs(span) < _f(EPSILON), low).when(~finite(out), F.raise_error(F.lit("quantization overflow: decoded value is not finite"))).otherwise(out)


@dataclass(frozen=True)
class Quantizer:
    low: tuple[float, ...]
    high: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.low) != len(self.high):
            raise DimensionMismatch(len(self.low), len(self.high))
        check_dims(len(self.low))
        for i, (a, b) in enumerate(zip(self.low, self.high, strict=True)):
            if not (math.isfinite(a) and math.isfinite(b)):
                raise QuantizationOverflow(f"bounds of dimension {i} are not finite: {a}, {b}")
            if b < a:
                raise InvalidHeader(f"maximum below minimum in dimension {i}")

    @property
    def dims(self) -> int:
        return len(self.low)

    def bounds(self, spark) -> DataFrame:
        """Long form: (dim, low, high)."""
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(self.low, self.high, strict=True))], "dim int, low float, high float")

    def _bounds(self) -> tuple[Column, Column]:
        return vector(self.low), vector(self.high)

    def _checked(self, v: Column, then: Column) -> Column:
        return F.when(F.size(v) != self.dims, F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {self.dims}, found "), F.size(v).cast("string")))).otherwise(then)

    def codes(self, v: Column | str, degenerate: str = "sided", bounds: tuple[Column, Column] | None = None) -> Column:
        v = F.col(v) if isinstance(v, str) else v
        low, high = bounds or self._bounds()
        return self._checked(v, F.transform(v, lambda x, i: code_of(x, F.get(low, i), F.get(high, i), degenerate)))

    def values(self, codes: Column | str, bounds: tuple[Column, Column] | None = None) -> Column:
        codes = F.col(codes) if isinstance(codes, str) else codes
        low, high = bounds or self._bounds()
        return self._checked(codes, F.transform(codes, lambda q, i: value_of(q, F.get(low, i), F.get(high, i))))

    def code_rows(self, x: np.ndarray, degenerate: str = "sided") -> np.ndarray:
        """Codes of a matrix of vectors."""
        low, high = np.asarray(self.low, np.float32), np.asarray(self.high, np.float32)
        if not np.isfinite(x).all():
            raise QuantizationOverflow("value is not finite")
        span = high - low
        if not np.isfinite(span).all():
            raise QuantizationOverflow("range is not finite")
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.floor(np.clip((x - low) / span, np.float32(0), np.float32(1)) * np.float32(LEVELS))
        flat = np.abs(span) < np.float32(EPSILON)
        if flat.any():
            far = (x[:, flat] > high[flat]) & (np.abs(x[:, flat] - low[flat]) >= np.float32(NEAR)) if degenerate == "sided" else False
            out[:, flat] = np.where(far, np.float32(LEVELS), np.float32(0))
        return out.astype(np.int16)

    def value_rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of a matrix of codes."""
        low, span = np.asarray(self.low, np.float32), np.asarray(self.high, np.float32) - np.asarray(self.low, np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            out = low + codes.astype(np.float32) / np.float32(LEVELS) * span
        out = np.where(np.abs(span) < np.float32(EPSILON), low, out)
        if not np.isfinite(out).all():
            raise QuantizationOverflow("decoded value is not finite")
        return out

    def _pass(self, df: DataFrame, column: str, to: str, kind: str, solve: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """``df`` with a column ``to`` that ``solve`` makes of ``column``, in Arrow batches."""
        at, dims = df.columns.index(column), self.dims
        keep = [i for i, c in enumerate(df.columns) if c != to]
        names = [*(df.columns[i] for i in keep), to]
        schema = df.drop(to).withColumn(to, F.lit(None).cast(kind)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(at)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), _lists(v, solve(rows_of(v, dims)))], names=names)

        return df.mapInArrow(run, schema)

    def quantize(self, df: DataFrame, column: str = "embedding", to: str = "codes", degenerate: str = "sided") -> DataFrame:
        return self._pass(df, column, to, "array<short>", lambda x: self.code_rows(np.asarray(x, np.float32), degenerate))

    def dequantize(self, df: DataFrame, column: str = "codes", to: str = "decoded") -> DataFrame:
        return self._pass(df, column, to, "array<float>", self.value_rows)

    def decoded(self, df: DataFrame, column: str = "embedding", to: str = "decoded") -> DataFrame:
        """What is left of vectors after coding, in one pass."""
        return self._pass(df, column, to, "array<float>", lambda x: self.value_rows(self.code_rows(np.asarray(x, np.float32))))

    def round_trip(self, v: Column | str) -> Column:
        return self.values(self.codes(v))

    def round_trip_local(self, v: Sequence[float]) -> list[float]:
        """The same for one vector on the driver."""
        if len(v) != self.dims:
            raise DimensionMismatch(self.dims, len(v))
        return self.value_rows(self.code_rows(np.asarray([v], np.float32)))[0].tolist()


def exploded(df: DataFrame, column: str = "embedding", *keep: str) -> DataFrame:
    """Long form: (*keep, dim, v)."""
    return df.select(*keep, F.posexplode(column).alias("dim", "v"))


_MEASURED = "dim int, low float, high float, n long, least int, most int, bad boolean"


def _measured(df: DataFrame, column: str, skip_nan: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, minima, maxima) in one pass; checks that rows are there, of one length and finite (without ``skip_nan``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sizes, bad, low, high = 0, set(), False, None, None
        for b in batches:
            v = b.column(0)
            n += len(v)
            sizes |= set(np.unique(v.value_lengths().drop_null().to_numpy()).tolist())
            if len(sizes) != 1 or len(v) == v.null_count:
                continue
            x = rows_of(v, *sizes)
            bad = bad or not np.isfinite(x).all()
            least, most = np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0)
            low, high = (least, most) if low is None else (np.fmin(low, least), np.fmax(high, most))
        dims = 0 if low is None or len(sizes) != 1 else len(low)
        bounds = [pa.array([None, *(() if not dims else (None if np.isnan(x) else x for x in side.tolist()))], pa.float32()) for side in (low, high)]
        about = [pa.array([x] + [None] * dims, t) for x, t in ((n, pa.int64()), (min(sizes, default=None), pa.int32()), (max(sizes, default=None), pa.int32()), (bool(bad), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims), pa.int32()), *bounds, *about], names=[x.split()[0] for x in _MEASURED.split(", ")])

    found = df.select(column).mapInArrow(run, _MEASURED)
    rows = sorted(found.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.bool_or("bad").alias("bad")).collect())  # a row for each dimension
    if not rows or not rows[0]["n"] or rows[0]["least"] is None:
        raise EmptyDataset("no vectors to calibrate")
    if rows[0]["least"] != rows[0]["most"]:
        raise DimensionMismatch(rows[0]["least"], rows[0]["most"])
    if rows[0]["bad"] and not skip_nan:
        raise QuantizationOverflow("a value is not finite")
    check_dims(rows[0]["least"])
    low, high = (np.asarray([np.nan if r[c] is None else r[c] for r in rows[1:]]) for c in ("low", "high"))
    return rows[0]["n"], low, high


def bounds_by_dimension(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, low, high): partial minima and maxima are what is shuffled."""
    return exploded(df, column).groupBy("dim").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def _collect(bounds: DataFrame) -> Quantizer:
    rows = sorted(bounds.collect())  # a row for each dimension, 65,535 at most
    return Quantizer(tuple(r["low"] for r in rows), tuple(r["high"] for r in rows))


def calibrate(df: DataFrame, column: str = "embedding", skip_nan: bool = False) -> Quantizer:
    """Minimum and maximum of each dimension. ``skip_nan`` leaves NaN out instead of raising."""
    _, low, high = _measured(df, column, skip_nan)
    return Quantizer(tuple(low.tolist()), tuple(high.tolist()))


def calibrate_global(df: DataFrame, column: str = "embedding") -> Quantizer:
    """One minimum and maximum over all elements, for every dimension."""
    _, low, high = _measured(df, column)
    return Quantizer((float(low.min()),) * len(low), (float(high.max()),) * len(low))


def percentile_ranks(n: int, low: float, high: float) -> tuple[int, int]:
    """Nearest ranks, from 0, in 32-bit arithmetic."""
    if not 0 <= low < high <= 100:
        raise InvalidHeader("percentiles must satisfy 0 <= low < high <= 100")
    last = np.float32(n - 1)
    return int(np.floor(np.float32(low) / np.float32(100) * last)), min(n - 1, int(np.ceil(np.float32(high) / np.float32(100) * last)))


#: Bits of a value's rank key that the first pass tells apart; the second tells the other ones.
_HALF = np.uint32(16)


def _ordered(x: np.ndarray) -> np.ndarray:
    """32-bit floats as unsigned numbers in the same order."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))


def _histogram(df: DataFrame, column: str, dims: int, halves: list[np.ndarray] | None) -> DataFrame:
    """(dim, which, bucket, upto, n): running counts. Without ``halves`` of values by their upper half; with them, for each rank's
    upper half by dimension, of the values that have it by their lower half. A task counts in numpy, so what is shuffled is at
    most 65,536 rows for each dimension and task, and no value is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _ordered(rows_of(b.column(0), dims))
            upper, dim = key >> _HALF, np.broadcast_to(np.arange(dims, dtype=np.uint64), key.shape)
            for which, of in enumerate(halves or [None]):
                mine = np.ones(key.shape, bool) if of is None else upper == of
                bucket = upper if of is None else key & np.uint32(0xFFFF)
                found, n = np.unique((dim[mine] << np.uint64(16)) | bucket[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(16)).astype(np.int32)), pa.array(np.full(len(found), which, np.int32)), pa.array((found & np.uint64(0xFFFF)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["dim", "which", "bucket", "n"])

    counts = df.select(column).filter(F.col(column).isNotNull()).mapInArrow(run, "dim int, which int, bucket int, n long").groupBy("dim", "which", "bucket").agg(F.sum("n").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy("dim", "which").orderBy("bucket")))


def bounds_by_percentile(df: DataFrame, low: float, high: float, column: str = "embedding") -> Quantizer:
    """Bounds at exact nearest ranks, or the extremes where these fall together: a radix selection in two passes."""
    n, least, most = _measured(df, column)
    ranks, dims = percentile_ranks(n, low, high), len(least)

    def located(counts: DataFrame, of: list[tuple[int, Column]]) -> list[dict]:
        """For each rank, by dimension, its bucket and the count before it: a row for each dimension reaches the driver."""
        out = []
        for which, rank in of:
            hit = counts.filter((F.col("which") == which) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
            out.append({r["dim"]: (r["bucket"], r["before"]) for r in hit.select("dim", "bucket", (F.col("upto") - F.col("n")).alias("before")).collect()})
        return out

    upper = located(_histogram(df, column, dims, None), [(0, F.lit(r)) for r in ranks])
    halves = [np.asarray([u[d][0] for d in range(dims)], np.uint32) for u in upper]
    left = [F.element_at(F.array(*[F.lit(int(r - u[d][1])) for d in range(dims)]), F.col("dim") + 1) for r, u in zip(ranks, upper, strict=True)]
    lower = located(_histogram(df, column, dims, halves), list(enumerate(left)))
    found = []
    for half, rest in zip(halves, lower, strict=True):
        key = (half << _HALF) | np.asarray([rest[d][0] for d in range(dims)], np.uint32)
        found.append((key ^ np.where(key >> np.uint32(31), np.uint32(0x80000000), np.uint32(0xFFFFFFFF))).view(np.float32))
    near = np.abs(found[1] - found[0]) < np.float32(NEAR)
    return Quantizer(tuple(np.where(near, least, found[0]).tolist()), tuple(np.where(near, most, found[1]).tolist()))


def calibrate_percentile(df: DataFrame, low: float, high: float, column: str = "embedding") -> Quantizer:
    percentile_ranks(1, low, high)
    return bounds_by_percentile(df, low, high, column)


def calibrate_percentile_approx(df: DataFrame, low: float, high: float, column: str = "embedding", accuracy: int = 10_000) -> Quantizer:
    """Approximate ranks in one mergeable pass, for tables where an exact sort for each dimension costs too much."""
    percentile_ranks(1, low, high)
    _measured(df, column)
    return _collect(exploded(df, column).groupBy("dim").agg(F.percentile_approx("v", low / 100, accuracy).alias("low"), F.percentile_approx("v", high / 100, accuracy).alias("high")))
