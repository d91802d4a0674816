"""Vector tables from generators and text, and to text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import CorruptedData, DimensionMismatch, EmptyDataset
from lodestone.functions.text import fixed, parse_vectors

_MASK = (1 << 64) - 1
#: Fixed values of the generators: shifts of the 64-bit xorshift, the seed's multiplier for noise, its steps.
_SHIFTS, _SPREAD_SEED, _NOISE_STEPS = (13, 7, 17), 0x9E3779B97F4A7C15, 2000


def _states(seed: int) -> Iterator[int]:
    a, b, c = _SHIFTS
    x = seed
    while True:
        x ^= (x << a) & _MASK
        x ^= x >> b
        x ^= (x << c) & _MASK
        yield x


def uniform_rows(count: int, dims: int, low: float, high: float, seed: int) -> np.ndarray:
    """Sequential by definition; the upper bound may be reached by rounding."""
    states = _states(max(seed, 1) & _MASK)
    u = np.asarray([np.float32(next(states) / float(_MASK)) for _ in range(count * dims)], np.float32)
    return (np.float32(low) + u * (np.float32(high) - np.float32(low))).reshape(count, dims)


def clustered_rows(count: int, dims: int, clusters: int, spread: float, seed: int) -> np.ndarray:
    """Row i lies around center i mod clusters, with even noise."""
    if clusters < 1:
        raise ValueError("clusters must be at least 1")
    centers = uniform_rows(clusters, dims, -1.0, 1.0, seed)
    states = _states((seed * _SPREAD_SEED) & _MASK)
    noise = np.asarray([np.float32(next(states) % _NOISE_STEPS) / np.float32(_NOISE_STEPS // 2) - np.float32(1) for _ in range(count * dims)], np.float32)
    return centers[np.arange(count) % clusters] + noise.reshape(count, dims) * np.float32(spread)


def from_rows(spark: SparkSession, rows: np.ndarray | list) -> DataFrame:
    """(vec_id, embedding), ids by place; checks that rows are there and of one length."""
    sizes = {len(r) for r in rows}
    if not len(rows) or sizes == {0}:
        raise EmptyDataset("a dataset needs vectors of at least one dimension")
    if len(sizes) > 1:
        raise DimensionMismatch(*sorted(sizes)[:2])
    flat = np.asarray(rows, np.float32)
    table = pa.table({"vec_id": pa.array(np.arange(len(flat))), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))})
    return spark.createDataFrame(table)


def synthetic_uniform(spark: SparkSession, count: int, dims: int, low: float = -1.0, high: float = 1.0, seed: int = 42) -> DataFrame:
    return from_rows(spark, uniform_rows(count, dims, low, high, seed))


def synthetic_clustered(spark: SparkSession, count: int, dims: int, clusters: int = 3, spread: float = 0.2, seed: int = 42) -> DataFrame:
    return from_rows(spark, clustered_rows(count, dims, clusters, spread, seed))


def uniform_at_scale(spark: SparkSession, count: int, dims: int, low: float = -1.0, high: float = 1.0, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Like it in distribution only, made on the executors."""
    u = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: (F.lit(low) + (F.pmod(F.xxhash64("id", d, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)) * (high - low)).cast("float"))
    return spark.range(0, count, 1, partitions).select(F.col("id").alias("vec_id"), u.alias("embedding"))


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """``[[...], ...]`` strictly."""
    parsed = spark.createDataFrame([(text,)], "s string").select(parse_vectors("s").alias("v")).first()["v"]
    if parsed is None or any(r is None or any(x is None for x in r) for r in parsed):
        raise CorruptedData("not a JSON array of arrays of numbers")
    return from_rows(spark, parsed)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n by id, not a random sample."""
    return df.orderBy("vec_id").limit(n)


def export_csv(df: DataFrame, path: str, column: str = "embedding") -> None:
    """Rows by id without header or ids, six decimals; part files in order."""
    line = fixed(column, 6, ",")
    df.orderBy("vec_id").select(line.alias("value")).write.mode("overwrite").text(path)


def export_json_lines(df: DataFrame, path: str, column: str = "embedding") -> None:
    """An array on each line, by id: splittable, for large tables."""
    line = F.concat(F.lit("["), fixed(column, 6, ", "), F.lit("]"))
    df.orderBy("vec_id").select(line.alias("value")).write.mode("overwrite").text(path)


def export_json(df: DataFrame, path: str, column: str = "embedding") -> None:
    """One file with an array of arrays, streamed through the driver a partition at a time."""
    line = F.concat(F.lit("["), fixed(column, 6, ", "), F.lit("]"))
    with open(path, "w") as out:
        out.write("[\n")
        for i, row in enumerate(df.orderBy("vec_id").select(line.alias("s")).toLocalIterator()):
            out.write(f"{',' + chr(10) if i else ''}  {row['s']}")
        out.write("\n]\n")
