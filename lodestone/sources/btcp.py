"""The compact vector file: one immutable, checksummed file of 8-bit codes, as a Spark data source.

``spark.read.format("btcp").load(path)`` splits by id ranges; each task seeks to its rows. Filters on ``vec_id`` reach the reader
(``spark.sql.python.filterPushdown.enabled``). Writing sorts by ``vec_id``; tasks write parts beside the target, and the commit joins
them while hashing, since the checksum covers the data in order. The path must be one that driver and tasks both open.
Large tables are better kept as Parquet codes; this is the exchange format.
"""

from __future__ import annotations

import glob
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from lodestone.config import Metric, QuantType, check_dims
from lodestone.errors import ChecksumMismatch, CorruptedFooter, InvalidHeader, InvalidMagic
from lodestone.functions.vectors import align_up
from lodestone.operators.quantizer import Quantizer

#: Fixed values of the layout (all big-endian): magic, header (magic, major, minor, dims, quantization tag, metric tag,
#: reserved, count, footer offset), block size, size of the SHA-256 of the data, chunk of a streamed hash.
MAGIC = b"BTCP"
HEADER = struct.Struct(">4sHHHHHHQQ")
BLOCK, DIGEST, CHUNK = 4096, 32, 65_536
SCHEMA = "vec_id long, codes array<short>"


@dataclass(frozen=True)
class Header:
    major: int
    minor: int
    dims: int
    quant_type: QuantType
    metric: Metric
    vector_count: int
    footer_offset: int

    def to_bytes(self) -> bytes:
        return HEADER.pack(MAGIC, self.major, self.minor, self.dims, int(self.quant_type), int(self.metric), 0, self.vector_count, self.footer_offset)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Header:
        if len(raw) < HEADER.size:
            raise InvalidHeader("file is shorter than a header")
        magic, major, minor, dims, quant, metric, _, count, footer = HEADER.unpack(raw[: HEADER.size])
        if magic != MAGIC:
            raise InvalidMagic(f"bad magic bytes {magic!r}")
        if not dims:
            raise InvalidHeader("dims must be positive")
        if count >= 1 << 63 or footer >= 1 << 63:
            raise InvalidHeader("count or offset out of range")
        return cls(major, minor, dims, QuantType.of(quant), Metric.of(metric), count, footer)

    @property
    def data_start(self) -> int:
        return HEADER.size + 8 * self.dims

    @property
    def data_len(self) -> int:
        return self.vector_count * self.dims

    def check_footer(self, file_len: int) -> None:
        if self.footer_offset < self.data_start + self.data_len:
            raise CorruptedFooter(f"footer offset {self.footer_offset} lies before the data's end")
        if self.footer_offset + 8 * self.vector_count + DIGEST > file_len:
            raise CorruptedFooter("file is too short for its footer")


def estimated_size(dims: int, count: int) -> int:
    return HEADER.size + 8 * dims + count * dims + 8 * count + DIGEST


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def read_header(path: str) -> Header:
    with open(_local(path), "rb") as f:
        return Header.from_bytes(f.read(HEADER.size))


def _hash_data(f, header: Header) -> bytes:
    f.seek(header.data_start)
    h, left = hashlib.sha256(), header.data_len
    while left:
        part = f.read(min(CHUNK, left))
        if not part:
            raise CorruptedFooter("file ends inside its data")
        h.update(part)
        left -= len(part)
    return h.digest()


@dataclass(frozen=True)
class Metadata:
    header: Header
    quantizer: Quantizer
    row_ids: np.ndarray
    checksum: bytes
    file_size: int

    @property
    def preview(self) -> str:
        return self.checksum[:8].hex() + "…"


def open_file(path: str, verify: bool = True) -> Metadata:
    """Metadata, after the checks: footer and checksum only if ``verify``."""
    path = _local(path)
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        header = Header.from_bytes(f.read(HEADER.size))
        if verify:
            header.check_footer(size)
        bounds = np.frombuffer(f.read(8 * header.dims), ">f4")
        if len(bounds) < 2 * header.dims:
            raise CorruptedFooter("file ends inside its bounds")
        quantizer = Quantizer(tuple(bounds[: header.dims].tolist()), tuple(bounds[header.dims :].tolist()))
        f.seek(header.footer_offset)
        ids, digest = f.read(8 * header.vector_count), f.read(DIGEST)
        if len(ids) < 8 * header.vector_count or len(digest) < DIGEST:
            raise CorruptedFooter("file ends inside its footer")
        if verify and _hash_data(f, header) != digest:
            raise ChecksumMismatch("checksum of the data does not match")
    return Metadata(header, quantizer, np.frombuffer(ids, ">u8"), digest, size)


def validate(path: str) -> dict:
    """The integrity report; ``is_valid`` needs everything right and no warning. A bad header raises."""
    path = _local(path)
    header, size, warnings = read_header(path), os.path.getsize(path), []
    out = {"path": path, "dims": header.dims, "count": header.vector_count, "footer_offset": header.footer_offset, "file_size": size, "checksum_valid": False, "row_ids_monotonic": False, "metadata_finite": False, "footer_size_ok": True}
    try:
        header.check_footer(size)
    except CorruptedFooter as e:
        out["footer_size_ok"] = False
        warnings.append(str(e))
    with open(path, "rb") as f:
        f.seek(HEADER.size)
        bounds = np.frombuffer(f.read(8 * header.dims), ">f4")
        low, high = bounds[: header.dims], bounds[header.dims :]
        out["metadata_finite"] = bool(len(bounds) == 2 * header.dims and np.isfinite(bounds).all() and (high >= low).all())
        if not out["metadata_finite"]:
            warnings.append("bounds are not finite or not in order")
        if out["footer_size_ok"]:
            f.seek(header.footer_offset)
            ids = np.frombuffer(f.read(8 * header.vector_count), ">u8").astype(np.uint64)
            digest = f.read(DIGEST)
            out["row_ids_monotonic"] = bool((ids[1:] > ids[:-1]).all())
            if not out["row_ids_monotonic"]:
                warnings.append("row ids do not ascend")
            elif not (ids == np.arange(len(ids), dtype=np.uint64)).all():
                warnings.append("row ids are not 0, 1, 2, ...")
            out["checksum_valid"] = _hash_data(f, header) == digest
            if not out["checksum_valid"]:
                warnings.append("checksum does not match")
    out["warnings"] = warnings
    out["is_valid"] = not warnings and all(out[k] for k in ("checksum_valid", "row_ids_monotonic", "metadata_finite", "footer_size_ok"))
    return out


def quick_check(path: str) -> bool:
    try:
        read_header(path).check_footer(os.path.getsize(_local(path)))
    except (OSError, ValueError):
        return False
    return True


def validate_many(spark: SparkSession, pattern: str) -> DataFrame:
    """A report for each file of a local pattern, one task each."""
    import pandas as pd

    fields = "path string, dims int, count long, footer_offset long, file_size long, checksum_valid boolean, row_ids_monotonic boolean, metadata_finite boolean, footer_size_ok boolean, warnings array<string>, is_valid boolean"
    paths = sorted(glob.glob(_local(pattern)))
    return spark.createDataFrame([(p,) for p in paths], "p string").repartition(max(1, len(paths))).mapInPandas(lambda frames: (pd.DataFrame([validate(p) for p in f["p"]]) for f in frames if len(f)), fields)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(None)
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, verify: bool, rows: int):
        self.path, self.rows = _local(path), rows
        self.header = open_file(path, verify).header
        self.first, self.last = 0, self.header.vector_count

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("vec_id",):
                if isinstance(f, EqualTo):
                    self.first, self.last = max(self.first, f.value), min(self.last, f.value + 1)
                elif isinstance(f, In) and f.value:
                    self.first, self.last = max(self.first, min(f.value)), min(self.last, max(f.value) + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.first = max(self.first, f.value)
                elif isinstance(f, GreaterThan):
                    self.first = max(self.first, f.value + 1)
                elif isinstance(f, LessThanOrEqual):
                    self.last = min(self.last, f.value + 1)
                elif isinstance(f, LessThan):
                    self.last = min(self.last, f.value)
            yield f  # ranges narrow the scan; Spark still applies the filter

    def partitions(self) -> list[InputPartition]:
        return [_Range(a, min(a + self.rows, self.last)) for a in range(self.first, self.last, self.rows)] or [_Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        h, step = self.header, max(1, (1 << 22) // self.header.dims)
        with open(self.path, "rb") as f:
            f.seek(h.data_start + partition.first * h.dims)
            for a in range(partition.first, partition.last, step):
                n = min(step, partition.last - a)
                codes = np.frombuffer(f.read(n * h.dims), np.uint8).astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h.dims, pa.int32()), pa.array(codes))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), lists], names=["vec_id", "codes"])


@dataclass
class _Part(WriterCommitMessage):
    path: str
    first: int
    count: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict[str, str]):
        self.path = _local(path)
        low, high = ([float(x) for x in options[k].split(",")] for k in ("low", "high"))
        self.quantizer = Quantizer(tuple(low), tuple(high))
        self.major, self.minor = int(options.get("major", 1)), int(options.get("minor", 0))
        self.quant_type, self.metric = QuantType.of(int(options.get("quant_type", 1))), Metric.of(options.get("metric", "l2"))
        self.pad = str(options.get("pad", "false")).lower() == "true"
        self.stem = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        path, first, last, count, dims = f"{self.stem}.{uuid.uuid4().hex}.part", -1, -1, 0, self.quantizer.dims
        with open(path, "wb") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                ids, codes = b.column("vec_id").to_numpy(), b.column("codes")
                lengths = codes.value_lengths().to_numpy(zero_copy_only=False)
                if (lengths != dims).any():
                    raise InvalidHeader(f"dimension mismatch: expected {dims}, found {lengths[lengths != dims][0]}")
                if ids[0] <= last or (ids[1:] <= ids[:-1]).any():
                    raise InvalidHeader("rows must ascend by vec_id")
                first, last, count = first if count else int(ids[0]), int(ids[-1]), count + b.num_rows
                f.write(codes.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
        return _Part(path, first, count)

    def commit(self, messages: list[_Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.count), key=lambda m: m.first)
        dims, count, h = self.quantizer.dims, sum(m.count for m in parts), hashlib.sha256()
        try:
            with open(f"{self.stem}.new", "wb") as out:
                out.write(b"\0" * HEADER.size)
                for bounds in (self.quantizer.low, self.quantizer.high):
                    out.write(np.asarray(bounds, ">f4").tobytes())
                for m in parts:
                    with open(m.path, "rb") as f:
                        while part := f.read(1 << 20):
                            h.update(part)
                            out.write(part)
                end = HEADER.size + 8 * dims + count * dims
                footer = align_up(end, BLOCK) if self.pad else end
                out.write(b"\0" * (footer - end))
                for a in range(0, count, 1 << 16):
                    out.write(np.arange(a, min(count, a + (1 << 16)), dtype=">u8").tobytes())
                out.write(h.digest())
                out.seek(0)
                out.write(Header(self.major, self.minor, dims, self.quant_type, self.metric, count, footer).to_bytes())
                out.flush()
                os.fsync(out.fileno())
            os.replace(f"{self.stem}.new", self.path)
        finally:
            self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        for p in glob.glob(glob.escape(self.stem) + ".*"):
            os.unlink(p)


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "btcp"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], str(self.options.get("verify", "true")).lower() != "false", int(self.options.get("rows_per_partition", 1 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorFile)


def write(df: DataFrame, path: str, quantizer: Quantizer, metric: Metric | str = "l2", column: str = "embedding", codes: str | None = None, pad: bool = False, **options: str) -> None:
    """Writes (vec_id, vector) rows by id; ids become 0, 1, 2, ... in that order. ``codes``: a column that is coded already."""
    register(df.sparkSession)
    check_dims(quantizer.dims)
    coded = df.select("vec_id", codes) if codes else quantizer.quantize(df.select("vec_id", column), column, "codes").select("vec_id", "codes")
    floats = lambda xs: ",".join(repr(float(x)) for x in xs)
    coded.toDF("vec_id", "codes").orderBy("vec_id").write.format("btcp").mode("overwrite").options(low=floats(quantizer.low), high=floats(quantizer.high), metric=Metric.of(metric).name, pad=str(pad).lower(), **options).save(path)


def read(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, Metadata]:
    """(vec_id, codes), and the metadata with the quantizer and the metric."""
    register(spark)
    return spark.read.format("btcp").option("verify", str(verify).lower()).load(path), open_file(path, verify)
