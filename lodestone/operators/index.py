"""Inverted postings of codes: (dimension, code) to ids. Long form is the index; arrays of ids are only made on lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that a block of a posting list covers.
BLOCK = 1 << 16


def build(df: DataFrame, codes: str = "codes") -> DataFrame:
    """(dim, code, vec_id). Write it partitioned or sorted by (dim, code) to make lookups prune."""
    return df.select("vec_id", F.posexplode(codes).alias("dim", "code"))


def postings(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """(dim, code, block, ids): ids ascending; a block holds the ids from ``block`` * its number on, so no list is longer than it."""
    at = F.floor(F.col("vec_id") / block).cast("long").alias("block")
    return index.groupBy("dim", "code", at).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def counts(index: DataFrame) -> DataFrame:
    """(dim, code, n, first_id, last_id): what the lists hold, without making them."""
    return index.groupBy("dim", "code").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


def lookup(df: DataFrame, dim: int, code: int, codes: str = "codes") -> DataFrame:
    """Ids whose code in a dimension is ``code``, straight from the codes; none for a dimension out of range."""
    return df.filter(F.get(codes, F.lit(dim)) == code).select("vec_id") if dim >= 0 else df.select("vec_id").limit(0)


def stats(index: DataFrame) -> DataFrame:
    """One row: postings, and postings for each dimension."""
    r = index.agg(F.count("*").alias("total"), F.countDistinct("dim").alias("dims"))
    return r.select("dims", "total", F.when(F.col("dims") == 0, F.lit(0.0)).otherwise(F.col("total") / F.greatest("dims", F.lit(1))).alias("avg_per_dim"))
