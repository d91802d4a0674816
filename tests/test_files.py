import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli, errors
from lodestone.config import Metric, QuantType
from lodestone.functions import text as T
from lodestone.operators import quantizer as Q
from lodestone.sources import btcp, builder, datasets
from lodestone.streaming import quantize as SQ


@pytest.fixture
def table(spark):
    return datasets.from_rows(spark, np.asarray([[0, 1, 2], [3, 4, 5], [-1, 0.5, 10]], np.float32))


def test_layout(spark, table, tmp_path):
    path, q = str(tmp_path / "a.btcp"), Q.calibrate(table)
    btcp.write(table, path, q, "cosine")
    raw = open(path, "rb").read()
    codes = np.asarray([r["codes"] for r in q.quantize(table).orderBy("vec_id").collect()], np.uint8).tobytes()
    want = struct.pack(">4sHHHHHHQQ", b"BTCP", 1, 0, 3, 1, 1, 0, 3, 32 + 24 + 9) + np.asarray(q.low + q.high, ">f4").tobytes() + codes + np.arange(3, dtype=">u8").tobytes() + hashlib.sha256(codes).digest()
    assert raw == want and len(raw) == btcp.estimated_size(3, 3)
    assert [f for f in os.listdir(tmp_path)] == ["a.btcp"]
    assert btcp.Header.from_bytes(raw) == btcp.Header(1, 0, 3, QuantType.SQ8, Metric.COSINE, 3, 65)


def test_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "a.btcp")
    btcp.write(table, path, Q.calibrate(table), "l2")
    back, meta = btcp.read(spark, path)
    got = {r["vec_id"]: r["decoded"] for r in meta.quantizer.dequantize(back).collect()}
    for r in table.collect():
        assert got[r["vec_id"]] == pytest.approx(r["embedding"], abs=0.05)
    assert meta.header.vector_count == 3 and meta.preview.endswith("…") and btcp.validate(path)["is_valid"]
    one = spark.read.format("btcp").option("rows_per_partition", "1").load(path)
    assert one.rdd.getNumPartitions() == 3 and [r["vec_id"] for r in one.filter("vec_id >= 1 and vec_id < 2").collect()] == [1]
    assert one.filter(F.col("vec_id").isin(0, 2)).count() == 2


def test_padding_and_coded_rows(spark, tmp_path):
    df = datasets.from_rows(spark, np.asarray([[1, 2]] * 5, np.float32))
    path, q = str(tmp_path / "p.btcp"), Q.calibrate(df)
    btcp.write(q.quantize(df), path, q, "cosine", codes="codes", pad=True, major="1", minor="2")
    h = btcp.read_header(path)
    assert h.footer_offset % 4096 == 0 and h.minor == 2 and btcp.validate(path)["is_valid"]
    assert meta_values(spark, path) == [[1, 2]] * 5


def test_file_that_grows(spark, table, tmp_path):
    path, q = str(tmp_path / "g.btcp"), Q.calibrate(table)
    b = builder.FileBuilder(spark, path, q, threshold=2)
    assert len(b) == 0 and b.dims == 3 and builder.FileBuilder(spark, path, q).finish().header.vector_count == 0
    b.push([1, 1, 5])
    b.append(table.filter("vec_id <> 1"))
    for v in ([2, 2, 6], [0, 4, 2], [3, 1, 9]):
        b.push(v)
    assert len(b) == 6 and len(b.waiting) == 1 and not b.should_flush() and b.data_bytes == 18
    b.append(table.limit(0))
    with pytest.raises(errors.DimensionMismatch):
        b.push([1, 2])
    with pytest.raises(Exception, match="not negative"):
        b.append(table.select((F.col("vec_id") - 1).alias("vec_id"), "embedding"))
    meta = b.finish()
    assert meta.file_size == b.estimated_size and os.listdir(tmp_path) == ["g.btcp"] and btcp.validate(path)["is_valid"]
    want = [[1, 1, 5], [0, 1, 2], [-1, 0.5, 10], [2, 2, 6], [0, 4, 2], [3, 1, 9]]
    for got, expected in zip(meta_values(spark, path), want, strict=True):
        assert got == pytest.approx(expected, abs=0.05)
    with pytest.raises(ValueError):
        b.append(table)


def meta_values(spark, path):
    back, meta = btcp.read(spark, path)
    return [r["decoded"] for r in meta.quantizer.dequantize(back).orderBy("vec_id").collect()]


def test_damage(spark, table, tmp_path):
    path = str(tmp_path / "a.btcp")
    btcp.write(table, path, Q.calibrate(table))
    raw = bytearray(open(path, "rb").read())

    def put(data):
        open(path, "wb").write(data)

    flipped = bytearray(raw)
    flipped[58] ^= 1
    put(flipped)
    with pytest.raises(errors.ChecksumMismatch):
        btcp.open_file(path)
    assert not btcp.validate(path)["checksum_valid"] and btcp.open_file(path, verify=False).header.dims == 3 and btcp.quick_check(path)
    put(raw[:-8])
    with pytest.raises(errors.CorruptedFooter):
        btcp.open_file(path)
    assert not btcp.validate(path)["is_valid"] and not btcp.quick_check(path)
    ids = bytearray(raw)
    ids[65:73] = struct.pack(">Q", 9)
    put(ids)
    assert not btcp.validate(path)["row_ids_monotonic"]
    unfinished = bytearray(raw)
    unfinished[24:32] = bytes(8)
    put(unfinished)
    with pytest.raises(errors.CorruptedFooter):
        btcp.open_file(path)
    put(bytes(32))
    with pytest.raises(errors.InvalidMagic, match="magic"):
        btcp.open_file(path)
    assert not btcp.quick_check(path)


def test_empty_file_and_cli(spark, table, tmp_path, capsys):
    path = str(tmp_path / "c.btcp")
    assert cli.main(["create", path, "--dims", "4"]) == 0 and btcp.open_file(path).header.vector_count == 0
    full = str(tmp_path / "d.btcp")
    btcp.write(table, full, Q.calibrate(table))
    assert cli.main(["info", full]) == 0 and cli.main(["validate", full]) == 0 and cli.main(["stats", full]) == 0
    assert cli.main(["search", full, "0,1,2", "-k", "1"]) == 0 and "id=0" in capsys.readouterr().out
    assert cli.main(["get", full, "1"]) == 0 and cli.main(["get", full, "7"]) == 1 and cli.main(["search", full, "1,2"]) == 1


def test_exports(spark, table, tmp_path):
    datasets.export_csv(table, str(tmp_path / "csv"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()][0] == "0.000000,1.000000,2.000000"
    datasets.export_json(table, str(tmp_path / "a.json"))
    assert datasets.from_json(spark, open(tmp_path / "a.json").read()).count() == 3
    datasets.export_json_lines(table, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3


def test_stream(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "in"))
    q = Q.calibrate(table)
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    SQ.append_codes(stream, q, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
    got = {r["vec_id"]: r["codes"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["vec_id"]: r["codes"] for r in q.quantize(table).collect()}


def test_drift(spark, table):
    q = Q.Quantizer((0.0,) * 3, (4.0,) * 3)
    out = SQ.drift(table.withColumn("ts", F.timestamp_seconds(F.col("vec_id") * 600)), q, "ts").orderBy("window").collect()
    assert [round(r["share_outside"], 3) for r in out] == [0.0, 0.333, 0.667]


def test_exports_round_ties_to_even(spark, tmp_path):
    """Against SQL: ties are m / 128, which a formatter that takes them up writes one higher; large numbers have all their digits."""
    import duckdb

    rows = [[m / 128, -m / 128, 1e-9] for m in range(1, 64, 2)] + [[float("inf"), float("-inf"), float("nan")], [3e38, 16777216.0, -1e-9]]
    df = spark.createDataFrame([*enumerate(rows), (99, [0.5, None, 1.5])], "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "t"))
    sql = "SELECT array_to_string(list_transform(embedding, lambda x: printf('%.{}f', CAST(x AS DOUBLE))), ', ') AS s FROM read_parquet('{}/t/*.parquet') ORDER BY vec_id"
    want = [r[0] for r in duckdb.connect().execute(sql.format(6, tmp_path)).fetchall()]
    datasets.export_csv(df, str(tmp_path / "csv"))
    datasets.export_json_lines(df, str(tmp_path / "lines"))
    datasets.export_json(df, str(tmp_path / "a.json"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()) == sorted(s.replace(", ", ",") for s in want)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == sorted(f"[{s}]" for s in want)
    assert [x.strip().rstrip(",") for x in open(tmp_path / "a.json").read().splitlines()[1:-1]] == [f"[{s}]" for s in want]
    four = spark.createDataFrame([(0, [1 / 32, 3 / 32, 5 / 32])], "vec_id long, embedding array<float>").select(T.format_vector("embedding", 3).alias("s"))
    assert four.first()["s"] == "0.0312, 0.0938, 0.1562"
