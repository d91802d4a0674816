"""Connected components by alternating stars, in DataFrame operations only.

Each round, every node links its larger neighbours to its smallest neighbour (large star), then its smaller ones and itself
likewise (small star); edges never grow in number and components become stars in about log(n) rounds. Minima are aggregated
before they are shuffled, and the joins back are plain equi-joins, whose hot keys the adaptive planner splits. Each round is
written to the shared folder, so neither lineage nor lost executors make it repeat earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        ways = edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    else:
        ways = edges
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = ways.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, tables: C.Tables, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v longs): the smallest node reachable. Nulls and loops are ignored."""
    marks = (F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("y"))
    edges, seen = tables.observed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", *marks)
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        before, last = edges, seen
        edges, seen = tables.observed(_star(_star(edges, True), False), "star", *marks)
        tables.drop(before)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
