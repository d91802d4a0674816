"""Fitted vector transforms as functions from column to column; a chain of them is one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import DimensionMismatch, EmptyDataset
from lodestone.functions.vectors import l2_norm, vector
from lodestone.operators.quantizer import Quantizer, exploded

#: The least divisor of a standard deviation, and of a norm.
LEAST_STD, LEAST_NORM = 1e-6, 1e-12


@dataclass(frozen=True)
class Transform:
    dims: int
    make: Callable[[Column], Column]
    state: dict = field(default_factory=dict)

    def __call__(self, v: Column | str) -> Column:
        v = F.col(v) if isinstance(v, str) else v
        bad = F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {self.dims}, found "), F.size(v).cast("string")))
        return F.when(F.size(v) != self.dims, bad).otherwise(self.make(v))

    def then(self, other: Transform) -> Transform:
        return chain(self, other)


def identity(dims: int) -> Transform:
    return Transform(dims, lambda v: v)


def normalizer(dims: int, epsilon: float = LEAST_NORM) -> Transform:
    def make(v: Column) -> Column:
        n = F.greatest(l2_norm(v), F.lit(float(epsilon)))
        return F.transform(v, lambda x: (x / n).cast("float"))

    return Transform(dims, make)


def mean_by_dimension(df: DataFrame, column: str = "embedding") -> DataFrame:
    return exploded(df, column).groupBy("dim").agg(F.avg("v").alias("mean"))


def variance_by_dimension(df: DataFrame, mean: DataFrame | None = None, column: str = "embedding") -> DataFrame:
    """Population variance about given means (dim, mean), or about the data's own."""
    if mean is None:
        return exploded(df, column).groupBy("dim").agg(F.var_pop("v").alias("variance"))
    return exploded(df, column).join(F.broadcast(mean), "dim").groupBy("dim").agg(F.avg((F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("variance"))  # a row for each dimension


def moments(df: DataFrame, column: str = "embedding") -> tuple[list[float], list[float]]:
    """Means and population standard deviations, from one pass."""
    rows = sorted(exploded(df, column).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n")).collect())
    if not rows:
        raise EmptyDataset("no vectors to fit")
    if len({r["n"] for r in rows}) > 1:
        raise DimensionMismatch(len(rows), -1)
    return [r["m"] for r in rows], [r["s"] for r in rows]


def centering(mean: list[float]) -> Transform:
    if not mean:
        raise EmptyDataset("a mean must not be empty")
    return Transform(len(mean), lambda v: F.zip_with(v, vector(mean), lambda x, m: x - m), {"mean": mean})


def fit_centering(df: DataFrame, column: str = "embedding") -> Transform:
    return centering(moments(df, column)[0])


def standardizer(mean: list[float], std: list[float]) -> Transform:
    std = [max(s, LEAST_STD) for s in std]
    return Transform(len(mean), lambda v: F.zip_with(F.zip_with(v, vector(mean), lambda x, m: x - m), vector(std), lambda x, s: (x / s).cast("float")), {"mean": mean, "std": std})


def fit_standardizer(df: DataFrame, column: str = "embedding") -> Transform:
    return standardizer(*moments(df, column))


def chain(a: Transform, b: Transform) -> Transform:
    if a.dims != b.dims:
        raise DimensionMismatch(a.dims, b.dims)
    return Transform(a.dims, lambda v: b.make(a.make(v)), {"first": a.state, "second": b.state})


def apply(df: DataFrame, transform: Transform, column: str = "embedding", to: str | None = None) -> DataFrame:
    return df.withColumn(to or column, transform(column))


@dataclass
class Pipeline:
    """Transforms in order, then a quantizer's round trip if there is one; the result is floats."""

    transforms: list[Transform] = field(default_factory=list)
    quantizer: Quantizer | None = None

    def add(self, transform: Transform) -> Pipeline:
        self.transforms.append(transform)
        return self

    def column(self, v: Column | str) -> Column:
        v = F.col(v) if isinstance(v, str) else v
        for t in self.transforms:
            v = t(v)
        return self.quantizer.round_trip(v) if self.quantizer else v

    def run(self, df: DataFrame, column: str = "embedding", to: str | None = None) -> DataFrame:
        # a column for each step: Catalyst evaluates a vector once for each step, not once for each use
        to = to or column
        for i, t in enumerate(self.transforms):
            df = df.withColumn(to, t(column if i == 0 else to))
            column = to
        return df.withColumn(to, self.quantizer.round_trip(column)) if self.quantizer else df.withColumn(to, F.col(column))
