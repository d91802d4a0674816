"""What quantization costs: errors over a table, by dimension, and sizes. One pass in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import INF
from lodestone.operators.quantizer import Quantizer


def _errors(df: DataFrame, quantizer: Quantizer, column: str) -> DataFrame:
    coded = quantizer.decoded(df.select(column), column, "_decoded")
    pairs = coded.select(F.posexplode(F.arrays_zip(F.col(column).alias("v"), F.col("_decoded").alias("r"))).alias("dim", "p"))
    return pairs.select("dim", F.col("p.v").alias("v"), F.col("p.r").alias("r"), (F.col("p.v").cast("double") - F.col("p.r").cast("double")).alias("d"))


def by_dimension(df: DataFrame, quantizer: Quantizer, column: str = "embedding") -> DataFrame:
    """(dim, n, sums of squares, absolutes and signal, largest error)."""
    d = F.col("d")
    return _errors(df, quantizer, column).groupBy("dim").agg(F.count("*").alias("n"), F.sum(d * d).alias("square"), F.sum(F.abs(d)).alias("absolute"), F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("signal"), F.max(F.abs(F.col("v") - F.col("r"))).alias("largest"))


def evaluate(df: DataFrame, quantizer: Quantizer, column: str = "embedding") -> DataFrame:
    """One row: the report. An empty table gives zeros and an infinite ratio of signal to noise."""
    dims = by_dimension(df, quantizer, column)
    total = dims.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("num_vectors"), F.coalesce(F.sum("n"), F.lit(0)).alias("elements"), F.coalesce(F.sum("square"), F.lit(0.0)).alias("noise"), F.coalesce(F.sum("absolute"), F.lit(0.0)).alias("absolute"),
        F.coalesce(F.sum("signal"), F.lit(0.0)).alias("signal"), F.coalesce(F.max("largest"), F.lit(0.0)).cast("float").alias("max_abs_error"), F.sort_array(F.collect_list(F.struct("dim", (F.col("square") / F.col("n")).alias("mse")))).alias("by_dim"),
    )
    ranges = F.array(*[F.lit(float(b) - float(a)).cast("float") for a, b in zip(quantizer.low, quantizer.high, strict=True)])
    n = F.greatest("elements", F.lit(1))
    size = F.col("num_vectors") * quantizer.dims
    return total.select(
        F.lit(quantizer.dims).alias("dims"), "num_vectors", (F.col("noise") / n).alias("mse"), (F.col("absolute") / n).alias("mae"), "max_abs_error",
        F.when(F.col("noise") < 1e-12, F.lit(INF)).otherwise(10 * F.log10(F.greatest("signal", F.lit(1e-300)) / F.greatest("noise", F.lit(1e-300)))).alias("snr_db"),
        F.transform("by_dim", lambda x: x["mse"]).alias("per_dim_mse"), ranges.alias("per_dim_range"), F.when(size == 0, F.lit(0.0)).otherwise(F.lit(4.0)).alias("compression_ratio"), (size * 4).alias("original_bytes"), size.alias("compressed_bytes"),
    )


def summary(report: DataFrame) -> DataFrame:
    return report.select(F.format_string("dims=%d vectors=%d mse=%.6f mae=%.6f max=%.6f snr=%.2f dB ratio=%.2fx", "dims", "num_vectors", "mse", "mae", F.col("max_abs_error").cast("double"), "snr_db", "compression_ratio").alias("summary"))


def sizes(df: DataFrame, dims: int) -> DataFrame:
    """One row: payload bytes before and after."""
    n = df.agg((F.count("*") * dims).alias("data_bytes"))
    return n.select("data_bytes", (F.col("data_bytes") * 4).alias("original_bytes"), F.when(F.col("data_bytes") == 0, F.lit(0.0)).otherwise(F.lit(4.0)).alias("ratio"))
