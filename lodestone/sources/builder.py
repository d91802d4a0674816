"""A vector file that grows by vectors and by tables, and is written when it is finished.

Coded rows are staged as Parquet beside the file, so neither the driver nor a task holds them; only pushed vectors wait in the driver,
``threshold`` of them at a time.
"""

from __future__ import annotations

import shutil

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.config import FileConfig
from lodestone.errors import DimensionMismatch
from lodestone.functions.vectors import align_up
from lodestone.operators.quantizer import Quantizer
from lodestone.sources import btcp, datasets


class FileBuilder:
    """Rows keep the order in which they came; those of a table go by its vec_id. Not for several threads at once."""

    def __init__(self, spark: SparkSession, path: str, quantizer: Quantizer, config: FileConfig | None = None, threshold: int = 10_000):
        self.spark, self.path, self.quantizer, self.threshold = spark, path, quantizer, max(threshold, 1)
        self.config = config or FileConfig(quantizer.dims)
        if self.config.dims != quantizer.dims:
            raise DimensionMismatch(quantizer.dims, self.config.dims)
        self.staged, self.waiting, self.rows, self.next_id = f"{path}-rows", [], 0, 0
        self.finished = False

    def _check_open(self) -> None:
        if self.finished:
            raise ValueError("the file is finished")

    @property
    def dims(self) -> int:
        return self.quantizer.dims

    def __len__(self) -> int:
        return self.rows + len(self.waiting)

    @property
    def data_bytes(self) -> int:
        return len(self) * self.dims

    @property
    def estimated_size(self) -> int:
        plain = btcp.estimated_size(self.dims, len(self))
        data = btcp.HEADER.size + 8 * self.dims + self.data_bytes
        return plain - data + align_up(data, btcp.BLOCK) if self.config.align_blocks else plain

    def should_flush(self) -> bool:
        return len(self.waiting) >= self.threshold

    def push(self, vector: list[float]) -> None:
        if len(vector) != self.dims:
            raise DimensionMismatch(self.dims, len(vector))
        self.waiting.append(np.asarray(vector, np.float32))
        if self.should_flush():
            self.flush()

    def append(self, df: DataFrame, column: str = "embedding") -> None:
        """The rows (vec_id, vector) of a table, after all that came before."""
        self.flush()
        self._stage(df, column)

    def flush(self) -> None:
        """Stages what waits; nothing happens if nothing does."""
        if self.waiting:
            self._stage(datasets.from_rows(self.spark, self.waiting), "embedding")
            self.waiting = []

    def _stage(self, df: DataFrame, column: str) -> None:
        self._check_open()
        seen = Observation()
        coded = self.quantizer.quantize(df.select("vec_id", column), column, "codes").select("vec_id", "codes")
        coded = coded.observe(seen, F.count(F.lit(1)).alias("n"), F.max("vec_id").alias("most"))
        own = F.when(F.col("vec_id") >= 0, F.col("vec_id") + self.next_id).otherwise(F.raise_error(F.lit("vec_id must be there and not negative")).cast("long"))
        coded.select(own.alias("vec_id"), "codes").write.mode("append").parquet(self.staged)  # all of the table or nothing
        about = seen.get
        if about["n"]:
            self.rows, self.next_id = self.rows + about["n"], self.next_id + about["most"] + 1

    def finish(self) -> btcp.Metadata:
        """Writes the file, removes the staged rows; nothing can be added any more."""
        self.flush()
        self._check_open()
        schema = "vec_id long, codes array<smallint>"
        rows = self.spark.read.parquet(self.staged) if self.rows else self.spark.createDataFrame([], schema)
        btcp.write(rows, self.path, self.quantizer, codes="codes", **self.config.writer_options())
        shutil.rmtree(btcp._local(self.staged), ignore_errors=True)
        self.finished = True
        return btcp.open_file(self.path)
