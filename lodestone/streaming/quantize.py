"""Coding on streams. A fitted quantizer is stateless, so the batch projection runs on a streaming DataFrame unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestone.operators.quantizer import Quantizer


def quantize_stream(stream: DataFrame, quantizer: Quantizer, column: str = "embedding", to: str = "codes") -> DataFrame:
    return quantizer.quantize(stream, column, to)


def append_codes(stream: DataFrame, quantizer: Quantizer, path: str, checkpoint: str, column: str = "embedding") -> DataStreamWriter:
    """A writer that appends (vec_id, codes) to Parquet, once for each row."""
    return quantize_stream(stream, quantizer, column).select("vec_id", "codes").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def drift(stream: DataFrame, quantizer: Quantizer, time: str, window: str = "5 minutes", late: str = "10 minutes", column: str = "embedding") -> DataFrame:
    """By event-time window: rows, and the share of elements outside the fitted ranges, a sign that bounds need refitting."""
    low, high = quantizer._bounds()
    outside = F.aggregate(F.transform(column, lambda x, i: ((x < F.get(low, i)) | (x > F.get(high, i))).cast("int")), F.lit(0), lambda s, x: s + x)
    out = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window")).agg(F.count("*").alias("n"), F.sum(outside).alias("outside"), F.sum(F.size(column)).alias("elements"))
    return out.select("window", "n", (F.col("outside") / F.greatest("elements", F.lit(1))).alias("share_outside"))
