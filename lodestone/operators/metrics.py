"""Search quality: recall, precision and reciprocal rank of predicted ids against true ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Metric
from lodestone.operators.quantizer import Quantizer
from lodestone.operators.search import batch_top_k


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recall_precision_at_k(truth: Column | str, predicted: Column | str, k: int) -> Column:
    """Recall and precision are one number here: hits among the first k' = min(k, predictions, max(truths, 1)) over k'.
    0 if k is 0; NaN without predictions; a repeated prediction counts each time."""
    truth, predicted = _col(truth), _col(predicted)
    if k <= 0:
        return F.lit(0.0)
    n = F.least(F.lit(k), F.size(predicted), F.greatest(F.size(truth), F.lit(1)))
    first = lambda a: F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))
    hits = F.size(F.filter(first(predicted), lambda x: F.array_contains(first(truth), x)))
    return F.when(n <= 0, F.lit(float("nan"))).otherwise(hits / F.greatest(n, F.lit(1)))


def reciprocal_rank(first_truth: Column | str, predicted: Column | str) -> Column:
    at = F.array_position(_col(predicted), _col(first_truth))
    return F.when(at > 0, F.lit(1.0) / F.greatest(at, F.lit(1))).otherwise(F.lit(0.0))


def evaluate_search(df: DataFrame, quantizer: Quantizer, queries: Sequence[tuple[int, Sequence[float]]], k: int, metric: Metric | str | int = "l2", column: str = "embedding", itself: bool = False) -> DataFrame:
    """One row: mean recall, precision and reciprocal rank of search over codes against exact search, 0 without queries.
    ``itself`` compares the search over codes with itself, which is always 1."""
    coded = quantizer.decoded(df.select("vec_id", column), column, "_decoded")

    def ids(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r["vec_id"]).alias(name))  # k ids each

    predicted = ids(batch_top_k(coded, queries, k, metric, "_decoded"), "predicted")
    truth = predicted.withColumnRenamed("predicted", "truth") if itself else ids(batch_top_k(df, queries, k, metric, column), "truth")
    both = truth.join(predicted, "query_id")
    recall = recall_precision_at_k("truth", "predicted", k)
    out = both.agg(F.avg(recall).alias("r"), F.avg(reciprocal_rank(F.get("truth", F.lit(0)), "predicted")).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(zero(F.col("r")).alias("recall_at_k"), zero(F.col("r")).alias("precision_at_k"), zero(F.col("m")).alias("mrr"))
