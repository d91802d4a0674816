"""Exact top-k search. One query: a projection and Spark's own top-k. Many queries: vectors meet the queries' matrix in numpy, in
Arrow batches; each batch keeps k hits a query, so what is shuffled is batches * queries * k rows, not queries * rows.

Ties go to the lower id; hits whose distance is not finite are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import Metric
from lodestone.errors import DimensionMismatch
from lodestone.functions.vectors import distance as metric_distance
from lodestone.functions.vectors import finite, vector
from lodestone.operators.quantizer import Quantizer

#: Queries that are broadcast at once; more are searched in blocks of this many.
QUERY_BLOCK = 4096


def distances(df: DataFrame, query: Sequence[float] | Column, metric: Metric | str | int = "l2", column: str = "embedding", function: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    q = query if isinstance(query, Column) else vector(query)
    return df.withColumn("distance", function(q, F.col(column)) if function else metric_distance(metric, q, column))


def top_k(df: DataFrame, query: Sequence[float] | Column, k: int, metric: Metric | str | int = "l2", column: str = "embedding", function: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(vec_id, distance), nearest first. ``function`` replaces the metric by any column expression of (query, vector)."""
    # as a lambda's variable a distance is computed once; a filter before the limit would compute it again at the scan
    found = distances(df, query, metric, column, function).select("vec_id", "distance")
    found = found.withColumn("distance", F.get(F.transform(F.array("distance"), lambda d: F.when(finite(d), d)), F.lit(0)))
    return found.orderBy(F.col("distance").asc_nulls_last(), "vec_id").limit(max(k, 0)).filter(F.col("distance").isNotNull())


def top_k_quantized(df: DataFrame, quantizer: Quantizer, query: Sequence[float], k: int, metric: Metric | str | int = "l2", codes: str = "codes") -> DataFrame:
    """Over codes, with the query coded and decoded as well."""
    return top_k(quantizer.dequantize(df, codes, "_decoded"), quantizer.round_trip_local(query), k, metric, "_decoded")


def top_k_by_query(df: DataFrame, queries: DataFrame, k: int, metric: Metric | str | int = "l2", column: str = "embedding", function: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The same for many queries (query_id, query) as expressions only: the definition that the numpy form is held against."""
    found = df.crossJoin(F.broadcast(queries))  # the caller bounds the queries
    found = found.withColumn("distance", function(F.col("query"), F.col(column)) if function else metric_distance(metric, "query", column)).filter(finite(F.col("distance")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.select("query_id", "vec_id", "distance", rank.alias("rank")).filter(F.col("rank") <= k)


def _numpy_distances(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows) in double."""
    if metric == Metric.L2:  # by differences: the expanded square loses digits
        out = np.empty((len(q), len(x)))
        for i, row in enumerate(q):
            d = x - row
            out[i] = np.einsum("ij,ij->i", d, d)
        return out
    dot = q @ x.T
    if metric == Metric.INNER_PRODUCT:
        return 0.0 - dot
    by = np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None], 1e-12)
    return 1.0 - np.clip(dot / by, -1.0, 1.0)


def batch_top_k(df: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, metric: Metric | str | int = "l2", column: str = "embedding") -> DataFrame:
    """(query_id, vec_id, distance, rank) of every query of a list."""
    m = Metric.of(metric)
    spark = df.sparkSession
    out_schema = "query_id long, vec_id long, distance double"
    dims = {len(v) for _, v in queries}
    if len(dims) > 1:
        raise DimensionMismatch(*sorted(dims)[:2])
    if not queries or k <= 0:
        return spark.createDataFrame([], out_schema + ", rank int")
    parts = []
    for at in range(0, len(queries), QUERY_BLOCK):
        block = queries[at : at + QUERY_BLOCK]
        shared = spark.sparkContext.broadcast((np.asarray([i for i, _ in block], np.int64), np.asarray([v for _, v in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_d, best_i = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
            for b in batches:
                v = b.column(1)
                flat = np.asarray(v.flatten(), np.float64)
                if not b.num_rows:
                    continue
                if len(flat) != b.num_rows * q.shape[1] or v.null_count:
                    raise DimensionMismatch(q.shape[1], len(flat) // b.num_rows)
                d = np.concatenate([best_d, _numpy_distances(m, q, flat.reshape(b.num_rows, -1))], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(np.asarray(b.column(0)), (len(q), b.num_rows))], axis=1)
                d[~np.isfinite(d)] = np.inf
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            good = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(axis=1))), pa.array(best_i[good]), pa.array(best_d[good])], names=["query_id", "vec_id", "distance"])

        parts.append(df.select("vec_id", column).mapInArrow(run, out_schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def scan(df: DataFrame) -> Iterator:
    """Rows by ascending id, a partition at a time on the driver."""
    return df.orderBy("vec_id").toLocalIterator()
