"""Point lookups, ordered batches, pages and chunks of rows by id, and a least-recently-used cache for single reads."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import IndexOutOfBounds, LodestoneError

#: Fixed value: rows that a page holds at most.
PAGE = 100


def get(df: DataFrame, vec_id: int) -> DataFrame:
    """The filter reaches the scan: a row group's statistics, or a seek in a binary file."""
    return df.filter(F.col("vec_id") == vec_id)


def get_batch(df: DataFrame, ids: Sequence[int], strict: bool = True) -> DataFrame:
    """(pos, vec_id, ...) in the order of ``ids``, repeats included. A missing id raises when the rows are read."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, vec_id long")
    found = wanted.join(df.filter(F.col("vec_id").isin(sorted(set(ids)))).withColumn("_there", F.lit(True)), "vec_id", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("index is out of bounds: "), F.col("vec_id").cast("string")))
        found = found.withColumn("vec_id", F.when(F.col("_there").isNull(), missing).otherwise(F.col("vec_id")))
    return found.drop("_there").orderBy("pos")


def page(df: DataFrame, start: int, count: int) -> DataFrame:
    if count > PAGE:
        raise LodestoneError(f"count {count} exceeds {PAGE}")
    return df.filter((F.col("vec_id") >= start) & (F.col("vec_id") < start + count)).orderBy("vec_id")


def chunks(df: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """(chunk, vectors): arrays of at most ``size`` vectors by id; the last may be shorter."""
    size = max(size, 1)
    rows = df.groupBy(F.floor(F.col("vec_id") / size).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("vec_id", column))).alias("rows"))
    return rows.select("chunk", F.transform("rows", lambda r: r[column]).alias("vectors"))


class CachedReader:
    """Single reads with a least-recently-used cache on the driver; whole scans should use ``persist``."""

    def __init__(self, df: DataFrame, capacity: int, column: str = "embedding"):
        self.df, self.column, self.capacity = df, column, max(capacity, 1)
        self.rows: OrderedDict[int, list[float]] = OrderedDict()
        self.hits = self.total = 0

    def get(self, vec_id: int) -> list[float]:
        self.total += 1
        if vec_id in self.rows:
            self.hits += 1
            self.rows.move_to_end(vec_id)
            return self.rows[vec_id]
        row = get(self.df, vec_id).select(self.column).first()
        if row is None:
            raise IndexOutOfBounds(vec_id, self.df.count())
        self.put(vec_id, row[0])
        return row[0]

    def put(self, vec_id: int, value: list[float]) -> None:
        self.rows[vec_id] = value
        self.rows.move_to_end(vec_id)
        while len(self.rows) > self.capacity:
            self.rows.popitem(last=False)

    def get_batch(self, ids: Sequence[int]) -> list[list[float]]:
        return [self.get(i) for i in ids]

    @property
    def hit_rate(self) -> float:
        return self.hits / self.total if self.total else 0.0

    def clear(self) -> None:
        self.rows.clear()
