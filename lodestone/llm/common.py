"""What the corpus operators share: shared-folder tables, Arrow batches of text, and hashing of words in numpy."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a step handles at once; the scratch arrays are a few dozen times as large.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of this machine is taken
    if the driver is the only executor (master ``local``); on a cluster that is an error."""
    sc = spark.sparkContext
    if not (where := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


class Tables:
    """Intermediate tables as Parquet files in the shared folder; a lost executor costs no recomputation beyond its tasks."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/lodestone-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove, spark, self.root)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self._keep(df, name)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        schema = df.schema
        df.write.option("maxRecordsPerFile", 0).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def observed(self, df: DataFrame, name: str, *figures: Column) -> tuple[DataFrame, dict]:
        """The kept table, and figures (its count as ``n``, and other aggregates) taken while it is written."""
        seen = Observation()
        kept = self._keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *figures), name)
        return kept, seen.get

    def drop(self, *consumed: DataFrame) -> None:
        """Removes tables that nothing reads any more, and the shuffle files of plans that are done."""
        for df in consumed:
            for f in df.inputFiles()[:1]:
                _remove(self.spark, f.rsplit("/", 1)[0])
        self.tidy()

    def tidy(self) -> None:
        """Spark removes a plan's shuffle files once the driver's garbage collector has found the plan unused."""
        gc.collect()
        pa.default_memory_pool().release_unused()
        self.spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with a prefix that makes them clash with no column."""
    taken, prefix = {c.lower() for c in df.columns}, "own_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        size = np.diff(offsets_of(col)[0])
        end, start = np.cumsum(size), 0
        while start < b.num_rows:
            base = end[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(end, base + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def offsets_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
    return off - off[0], raw


_rng = np.random.default_rng(20240607)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
#: Words are runs of bytes other than space and \t\n\v\f\r.
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[32, *range(9, 14)]] = True
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, i < n."""
    global _powers
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()

        def run(b: int) -> np.ndarray:
            x = np.full(m, np.uint64(b))
            x[0] = 1
            return np.multiply.accumulate(x)

        _powers = run(_BASE), run(_INVERSE)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of any byte ranges of a buffer, by prefix sums of a polynomial modulo 2**64 over random byte values."""

    def __init__(self, raw: np.ndarray, lower: bool = False):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _ODD)


def words(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross rows."""
    n = len(raw)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z
    w = ~_SEPARATES[raw]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = w[:-1]
    after[:-1] = w[1:]
    inner = off[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(off[1:], start, side="right")


def bare(raw: np.ndarray, marks: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words without marks around them; words of marks only go."""
    plain = ~marks[raw]
    inner = np.concatenate([[0], np.cumsum(plain)])
    keep = inner[end] > inner[start]
    start, end, row = start[keep], end[keep], row[keep]
    if len(start):
        at = np.flatnonzero(plain)
        start, end = at[inner[start]], at[inner[end] - 1] + 1
    return start, end, row


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words; a row of fewer words has them all as one."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    m = max(0, len(h) - k + 1)
    total = np.zeros(m, np.uint64)
    for j in range(k):
        total += h[j : j + m] * _MULT[j]
    good = row[:m] == row[k - 1 : k - 1 + m] if m else np.empty(0, bool)
    out, at = mix(total[good]), row[:m][good]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        mine = np.isin(row, few, kind="table") if len(row) else np.empty(0, bool)
        where = np.flatnonzero(mine)
        part = h[where] * _MULT[where - first[row[where]]]
        sums = np.add.reduceat(part, np.concatenate([[0], np.cumsum(count[few])[:-1]]))
        out, at = np.concatenate([out, mix(sums + count[few].astype(np.uint64) * _ODD)]), np.concatenate([at, few])
    return out, at


def unique_in_rows(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), by row then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if not len(h):
        return h, row
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[new], row[new]


class Recent(dict):
    """Remembers what ``find`` gave for at least the last ``most / 2`` different keys that were asked for, and ``most`` at most."""

    def __init__(self, find: Callable, most: int):
        super().__init__()
        self.find, self.half, self.older = find, most // 2, {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.find(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def id_and_text(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns that the operators read, whatever else the table has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def without(docs: DataFrame, ids: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """The documents, in their columns, whose id is not among ``ids`` (doc_id); rows without an id stay. Up to ``most_broadcast``
    ids, which are counted, are broadcast, so that no text is shuffled."""
    (gone,) = unused(docs, "gone")
    ids = ids.select(F.col("doc_id").cast("long").alias(gone)).filter(F.col(gone).isNotNull()).distinct()
    few = ids.limit(most_broadcast + 1).count() <= most_broadcast
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def map_text(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, *more: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``step`` on slices of (doc_id, text, *more), in Arrow batches, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=limit):
            yield step(b)

    return id_and_text(df, *more).mapInArrow(run, schema)


def held_out(mod: int, rest: int):
    """Rows set aside by crc32 of the id as text; never true for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled rows not set aside, taken by a hash of the id.
    The ids are bounded by ``limit``, so they are broadcast and the texts never shuffled."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(mod, rest))
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return id_and_text(docs).join(F.broadcast(ids), "doc_id")
