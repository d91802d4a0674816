import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.config import FileConfig, Metric
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import index, lookup, metrics, search, stats, transforms
from lodestone.operators import quantizer as Q
from lodestone.sources import datasets


def rows(spark, vectors):
    return datasets.from_rows(spark, np.asarray(vectors, np.float32))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


v = V.vector


def _numpy_round_trip(x, low, high):
    x, low, high = (np.asarray(y, np.float32) for y in (x, low, high))
    code = np.floor(np.clip((x - low) / (high - low), np.float32(0), np.float32(1)) * np.float32(255))
    return code.astype(int).tolist(), (low + code / np.float32(255) * (high - low)).astype(np.float32).tolist()


def test_known_codes(spark):
    q, x = Q.Quantizer((-3.0, 10.0, 0.25), (5.0, 11.5, 0.75)), [[-1.7, 10.9, 0.3], [7.0, 9.0, 0.74], [5.0, 10.0, 0.25]]
    codes, values = _numpy_round_trip(x, q.low, q.high)
    got = q.dequantize(q.quantize(rows(spark, x))).orderBy("vec_id").collect()
    assert [r["codes"] for r in got] == codes and [r["decoded"] for r in got] == values
    assert codes[1][:2] == [255, 0] and codes[2] == [255, 0, 0]


def test_passes_equal_expressions(spark):
    x = np.random.default_rng(4).normal(size=(100, 5)).astype(np.float32)
    x[:, 2] = np.float32(1.5)  # a degenerate range
    df = rows(spark, x)
    q = Q.Quantizer((-1.0, -2.0, 1.0, -0.5, 0.0), (1.0, 2.0, 1.0, 0.5, 3.0))
    for kind in ("sided", "zero"):
        both = q.quantize(df, degenerate=kind).withColumn("e", q.codes("embedding", kind))
        assert both.filter("codes <> e").count() == 0
    both = q.decoded(df).withColumn("e", q.round_trip("embedding"))
    assert both.filter("decoded <> e").count() == 0 and both.columns == ["vec_id", "embedding", "decoded", "e"]
    null = spark.createDataFrame([(0, None, "a"), (1, [0.0] * 5, "b")], "vec_id long, embedding array<float>, codes string")
    got = {r["vec_id"]: r["codes"] for r in q.quantize(null).collect()}  # a column of that name is replaced
    assert got[0] is None and len(got[1]) == 5


@pytest.mark.parametrize(("x", "sided", "zero"), [(5.0, 0, 0), (6.0, 255, 0), (4.0, 0, 0), (5.0000005, 0, 0)])
def test_degenerate_range(spark, x, sided, zero):
    q = Q.Quantizer((5.0,), (5.0,))
    df = rows(spark, [[x]])
    assert q.quantize(df).first()["codes"] == [sided] and q.quantize(df, degenerate="zero").first()["codes"] == [zero]
    assert q.dequantize(q.quantize(rows(spark, [[5.0]]))).first()["decoded"] == [5.0]


def test_codes_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 7)).astype(np.float32)
    q = Q.calibrate(rows(spark, x))
    low, high = x.min(0), x.max(0)
    assert q.low == tuple(low.tolist()) and q.high == tuple(high.tolist())
    got = [r["codes"] for r in q.quantize(rows(spark, x)).orderBy("vec_id").collect()]
    assert got == np.floor(np.clip((x - low) / (high - low), np.float32(0), np.float32(1)) * np.float32(255)).astype(int).tolist()
    assert q.round_trip_local(x[3].tolist()) == q.dequantize(q.quantize(rows(spark, x))).filter("vec_id = 3").first()["decoded"]


def test_calibration_variants(spark):
    x = np.asarray([[4, -7.5], [2.5, 30], [-6, 0.125], [-0.0, 8]], np.float32)
    df = rows(spark, x)
    assert Q.calibrate(df) == Q.Quantizer(tuple(x.min(0).tolist()), tuple(x.max(0).tolist()))
    assert Q.calibrate_global(df) == Q.Quantizer((-7.5, -7.5), (30.0, 30.0))
    line = rows(spark, [[i, 2 * i] for i in range(101)])
    assert Q.calibrate_percentile(line, 5, 95) == Q.Quantizer((5.0, 10.0), (95.0, 190.0))
    flat = rows(spark, [[1.0]] * 98 + [[0.0], [2.0]])
    assert Q.calibrate_percentile(flat, 5, 95) == Q.Quantizer((0.0,), (2.0,))
    approx = Q.calibrate_percentile_approx(line, 5, 95)
    assert abs(approx.low[0] - 5) <= 1 and abs(approx.high[0] - 95) <= 1


@pytest.mark.parametrize(("low", "high"), [(5, 95), (0, 100), (50, 50.5), (33.3, 66.6)])
def test_percentiles_equal_sorting(spark, low, high):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.integers(-3, 3, (200, 3)), rng.normal(size=(37, 3)) * 1e-6, rng.normal(size=(40, 3)) * 1e30]).astype(np.float32)
    got, ordered = Q.calibrate_percentile(rows(spark, x).repartition(5), low, high), np.sort(x, axis=0)
    a, b = Q.percentile_ranks(len(x), low, high)
    near = np.abs(ordered[b] - ordered[a]) < np.float32(Q.NEAR)
    assert got == Q.Quantizer(tuple(np.where(near, ordered[0], ordered[a]).tolist()), tuple(np.where(near, ordered[-1], ordered[b]).tolist()))


def test_clusters_follow_their_definition():
    x = datasets.clustered_rows(20, 8, 3, 0.1, 123)
    centers = datasets.uniform_rows(3, 8, -1.0, 1.0, 123)
    assert x.shape == (20, 8) and np.abs(x - centers[np.arange(20) % 3]).max() <= np.float32(0.1) + 1e-6
    state, noise = (123 * 0x9E3779B97F4A7C15) % 2**64, []
    for _ in range(160):
        state ^= (state << 13) % 2**64
        state ^= state >> 7
        state ^= (state << 17) % 2**64
        noise.append((state % 2000) / 1000 - 1)
    assert np.allclose(x - centers[np.arange(20) % 3], 0.1 * np.asarray(noise).reshape(20, 8), atol=1e-6)


def test_calibration_errors(spark):
    with pytest.raises(errors.EmptyDataset):
        Q.calibrate(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    with pytest.raises(errors.DimensionMismatch):
        Q.calibrate(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    nan = spark.createDataFrame([(0, [1.0]), (1, [math.nan]), (2, [3.0])], "vec_id long, embedding array<float>")
    with pytest.raises(errors.QuantizationOverflow):
        Q.calibrate(nan)
    assert Q.calibrate(nan, skip_nan=True) == Q.Quantizer((1.0,), (3.0,))
    with pytest.raises(errors.InvalidHeader):
        Q.calibrate_percentile(nan, 95, 5)
    with pytest.raises(Exception, match="not finite"):
        Q.Quantizer((0.0,), (1.0,)).quantize(nan).collect()
    for bad in (lambda: Q.Quantizer((1.0,), (0.0,)), lambda: Q.Quantizer((), ()), lambda: Q.Quantizer((math.inf,), (math.inf,))):
        with pytest.raises(errors.LodestoneError):
            bad()


def test_distances(spark):
    assert one(spark, V.l2_squared(v([0, 0]), v([3, 4]))) == 25 and one(spark, V.l2(v([0, 0]), v([3, 4]))) == 5
    assert one(spark, V.dot(v([1, 2, 3]), v([4, 5, 6]))) == 32
    assert one(spark, V.cosine_distance(v([1, 0]), v([1, 0]))) == 0 and one(spark, V.cosine_distance(v([1, 0]), v([-1, 0]))) == 2
    assert one(spark, V.cosine_distance(v([0, 0]), v([1, 0]))) == 1 and one(spark, V.cosine_similarity(v([1, 0]), v([1, 0]))) == 1
    assert one(spark, V.distance("ip", v([1, 2]), v([1, 2]))) == -5 and one(spark, V.distance(Metric.L2, v([1, 2]), v([1, 2]))) == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        one(spark, V.l2(v([1, 2]), v([1])))
    with pytest.raises(errors.InvalidTag):
        V.distance("nearest", v([1]), v([1]))


def test_arithmetic(spark):
    assert one(spark, V.add(v([1, 2]), v([3, 4]))) == [4, 6] and one(spark, V.sub(v([3, 4]), v([1, 2]))) == [2, 2]
    assert one(spark, V.scale(v([1, 2]), 3)) == [3, 6] and one(spark, V.l2_norm(v([3, 4]))) == 5
    out = one(spark, V.clamp(v([-2, math.nan, 2]), -1, 1))
    assert out[0] == -1 and math.isnan(out[1]) and out[2] == 1
    assert one(spark, V.normalized(v([3, 4]))) == pytest.approx([0.6, 0.8]) and one(spark, V.normalized(v([0, 0]))) == [0, 0]


def test_errors_of_reconstruction(spark):
    a, b = v([1, 2, 3]), v([1, 2, 3])
    assert one(spark, V.mse(a, b)) == 0 and one(spark, V.snr_db(a, b)) == math.inf
    assert one(spark, V.mae(v([0, 0]), v([1, 1]))) == 1 and one(spark, V.max_abs_error(v([0, 0]), v([1, -3]))) == 3
    assert one(spark, V.snr_db(v([0, 0]), v([1, 1]))) == 0
    assert one(spark, V.compression_ratio(F.lit(400), F.lit(100))) == 4 and one(spark, V.compression_ratio(F.lit(4), F.lit(0))) == math.inf


def test_report(spark):
    df = rows(spark, [[0, 0], [1, 1], [0.5, 0.5]])
    r = stats.evaluate(df, Q.calibrate(df)).first()
    assert r["mse"] < 0.01 and r["snr_db"] > 20 and r["compression_ratio"] == 4 and r["num_vectors"] == 3 and r["dims"] == 2
    assert r["original_bytes"] == 24 and r["compressed_bytes"] == 6 and len(r["per_dim_mse"]) == 2 and r["per_dim_range"] == [1, 1]
    assert "ratio=4.00x" in stats.summary(stats.evaluate(df, Q.calibrate(df))).first()["summary"]
    empty = stats.evaluate(df.limit(0), Q.calibrate(df)).first()
    assert empty["snr_db"] == math.inf and empty["mse"] == 0 and empty["compression_ratio"] == 0


def test_search(spark):
    df = rows(spark, [[0, 0], [1, 0], [0, 1], [10, 10]])
    hits = search.top_k(df, [0.1, 0.1], 2).collect()
    assert [h["vec_id"] for h in hits] == [0, 1]  # a tie at the second place goes to the lower id
    assert search.top_k(df, [0.1, 0.1], 0).count() == 0 and search.top_k(df, [0.1, 0.1], 99).count() == 4
    assert search.top_k(df, [math.nan, 0.0], 3).count() == 0
    for metric in ("l2", "cosine", "ip"):
        queries = [(i, [0.1 * i, 0.3]) for i in range(3)]
        got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["distance"], 9)) for r in search.batch_top_k(df, queries, 3, metric).collect()}
        for i, q in queries:
            want = [(r["vec_id"], round(r["distance"], 9)) for r in search.top_k(df, q, 3, metric).collect()]
            assert [got[i, k + 1][0] for k in range(3)] == [w[0] for w in want]
            assert [got[i, k + 1][1] for k in range(3)] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert search.batch_top_k(df, [], 3).count() == 0
    coded = Q.calibrate(df).quantize(df)
    assert search.top_k_quantized(coded, Q.calibrate(df), [0.1, 0.1], 1).first()["vec_id"] == 0
    assert [r["vec_id"] for r in search.scan(df)] == [0, 1, 2, 3]


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    df = rows(spark, [[i, i / 2] for i in range(20)])
    got = search.batch_top_k(df, [(i, [i, i / 2]) for i in range(5)], 1).collect()
    assert {r["query_id"]: r["vec_id"] for r in got} == {i: i for i in range(5)}


def test_lookups(spark):
    df = rows(spark, [[i, i] for i in range(5)])
    assert [r["vec_id"] for r in lookup.get_batch(df, [3, 0, 3]).collect()] == [3, 0, 3]
    with pytest.raises(Exception, match="out of bounds"):
        lookup.get_batch(df, [9]).collect()
    assert lookup.page(df, 3, 10).count() == 2
    with pytest.raises(errors.LodestoneError):
        lookup.page(df, 0, 101)
    assert [len(r["vectors"]) for r in lookup.chunks(df, 2).orderBy("chunk").collect()] == [2, 2, 1]
    cache = lookup.CachedReader(df, 2)
    assert cache.get(1) == [1, 1] and cache.get(1) == [1, 1] and cache.hit_rate == 0.5
    cache.get(2), cache.get(1), cache.get(3)
    assert list(cache.rows) == [1, 3]
    with pytest.raises(errors.IndexOutOfBounds):
        cache.get(7)


def test_transforms(spark):
    df = rows(spark, [[0, 10], [2, 20]])
    center = transforms.fit_centering(df)
    assert center.state["mean"] == [1, 15] and one(spark, center(v([1, 15]))) == [0, 0]
    std = transforms.fit_standardizer(rows(spark, [[0], [2], [4]]))
    assert one(spark, std(v([2]))) == [0]
    assert one(spark, transforms.normalizer(2)(v([3, 4]))) == pytest.approx([0.6, 0.8]) and one(spark, transforms.normalizer(2)(v([0, 0]))) == [0, 0]
    assert one(spark, transforms.chain(transforms.normalizer(2), transforms.identity(2))(v([3, 4])))[0] == pytest.approx(0.6)
    with pytest.raises(errors.DimensionMismatch):
        transforms.chain(transforms.identity(2), transforms.identity(3))
    out = transforms.Pipeline().add(transforms.normalizer(2)).run(rows(spark, [[3, 4]])).first()["embedding"]
    assert out == pytest.approx([0.6, 0.8])
    mean = transforms.mean_by_dimension(df)
    assert {r["dim"]: r["variance"] for r in transforms.variance_by_dimension(df, mean).collect()} == {0: 1, 1: 25}


def test_metrics(spark):
    a = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")
    assert one(spark, metrics.recall_precision_at_k(a([1, 2, 3]), a([2, 3, 4]), 3)) == pytest.approx(2 / 3)
    assert math.isnan(one(spark, metrics.recall_precision_at_k(a([1]), a([]), 3))) and one(spark, metrics.recall_precision_at_k(a([1]), a([1]), 0)) == 0
    assert one(spark, metrics.reciprocal_rank(F.lit(2), a([1, 2, 3]))) == 0.5 and one(spark, metrics.reciprocal_rank(F.lit(5), a([1, 2, 3]))) == 0
    df = rows(spark, np.random.default_rng(0).normal(size=(50, 4)))
    queries = [(0, [0.1, 0.2, 0.3, 0.4])]
    r = metrics.evaluate_search(df, Q.calibrate(df), queries, 5).first()
    assert 0.6 <= r["recall_at_k"] <= 1 and metrics.evaluate_search(df, Q.calibrate(df), queries, 5, itself=True).first()["mrr"] == 1


def test_postings(spark):
    df = rows(spark, [[0, 0], [1, 1], [0.5, 0.5]])
    coded = Q.calibrate(df).quantize(df)
    p = {(r["dim"], r["code"]): r["ids"] for r in index.postings(index.build(coded)).collect()}
    assert p[0, 0] == [0] and p[1, 127] == [2]
    long = spark.createDataFrame([(i, [i % 2]) for i in range(10)], "vec_id long, codes array<short>")
    p = {(r["code"], r["block"]): r["ids"] for r in index.postings(index.build(long), 4).collect()}
    assert p[0, 0] == [0, 2] and p[1, 1] == [5, 7] and p[0, 2] == [8] and max(map(len, p.values())) == 2
    assert {r["code"]: (r["n"], r["first_id"], r["last_id"]) for r in index.counts(index.build(long)).collect()} == {0: (5, 0, 8), 1: (5, 1, 9)}
    assert [r["vec_id"] for r in index.lookup(coded, 0, 255).collect()] == [1] and index.lookup(coded, 9, 0).count() == 0
    assert index.stats(index.build(coded)).first().asDict() == {"dims": 2, "total": 6, "avg_per_dim": 3.0}


def test_text(spark):
    assert one(spark, T.parse_vector(F.lit("1, 2.5"))) == [1, 2.5] and one(spark, T.parse_vector(F.lit("1,x,2"), lenient=True)) == [1, 2]
    with pytest.raises(Exception):
        one(spark, T.parse_vector(F.lit("1,x")))
    assert one(spark, T.format_vector(v([1, 2, 3]), 2)) == "1.0000, 2.0000"
    assert one(spark, T.url_query(F.lit("a=1&b=x%20y+z&a=2&c"))) == {"a": "2", "b": "x y z", "c": ""}
    assert one(spark, T.json_escape(F.lit('a"b\\c\n'))) == 'a\\"b\\\\c\\n'
    assert one(spark, T.hex_preview(F.unhex(F.lit("00ff" * 8)))) == "00ff00ff00ff00ff…"


def test_generators(spark):
    u = datasets.uniform_rows(10, 4, -1, 1, 42)
    assert u.shape == (10, 4) and (u >= -1).all() and (u <= 1).all()
    x, out = 42, []
    for _ in range(3):
        x ^= (x << 13) % 2**64
        x ^= x >> 7
        x ^= (x << 17) % 2**64
        out.append(-1 + 2 * (x / (2**64 - 1)))
    assert u.ravel()[:3] == pytest.approx(out, abs=1e-6)
    assert datasets.clustered_rows(20, 8, 3, 0.1, 123).shape == (20, 8)
    with pytest.raises(ValueError):
        datasets.clustered_rows(2, 2, 0, 0.1, 1)
    assert datasets.from_json(spark, "[[0, 1, 2], [3,4,5]]").count() == 2
    with pytest.raises(errors.LodestoneError):
        datasets.from_json(spark, "[[0, 1], [2")
    assert datasets.uniform_at_scale(spark, 100, 3).filter(F.size("embedding") == 3).count() == 100


def test_config():
    assert FileConfig(128).with_(align_blocks=True).writer_options()["pad"] == "true"
    for dims, text in ((0, "dims"), (70_000, "u16")):
        with pytest.raises(errors.InvalidHeader, match=text):
            FileConfig(dims)
    assert Metric.of("EUCLIDEAN") is Metric.L2 and V.align_up(5, 4) == 8 and V.align_up(5, 0) == 5
