"""The queries of the vector operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import index as I
from lodestone.operators import lookup as L
from lodestone.operators import metrics as M
from lodestone.operators import quantizer as Q
from lodestone.operators import search as S
from lodestone.operators import stats as ST
from lodestone.operators import transforms as TR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 10
IDS = [7, 3, 3, 499, 0]


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def _vector(df: DataFrame, vec_id: int) -> list[float]:
    return df.filter(F.col("vec_id") == vec_id).first()["embedding"]


#: The stated query set of the searches: every fiftieth id.
EACH = 50


def _queries(df: DataFrame) -> list[tuple[int, list[float]]]:
    return [(r["vec_id"], r["embedding"]) for r in df.filter(F.col("vec_id") % EACH == 0).toLocalIterator()]


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def _long(df: DataFrame, column: str, name: str = "value", digits: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("dim", "x")).select("vec_id", "dim", _r(F.col("x"), digits).alias(name))


def _query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# parts of the SQL
_E = "e AS (SELECT vec_id, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings)"
_B = "b AS (SELECT dim, min(v) AS mn, max(v) AS mx FROM e GROUP BY dim)"
_CODE = "CASE WHEN abs(mx - mn) < CAST(1.1920929e-7 AS FLOAT) THEN 0 ELSE CAST(floor(least(greatest((v - mn) / (mx - mn), CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) * CAST(255 AS FLOAT)) AS INTEGER) END"
_C = f"c AS (SELECT e.vec_id, e.dim, v, mn, mx, {_CODE} AS code FROM e JOIN b USING (dim))"
_D = "d AS (SELECT *, CASE WHEN abs(mx - mn) < CAST(1.1920929e-7 AS FLOAT) THEN mn ELSE mn + CAST(code AS FLOAT) / CAST(255 AS FLOAT) * (mx - mn) END AS r FROM c)"
_CODED = f"WITH {_E}, {_B}, {_C}, {_D}"


def _fold(expr: str, n: str = "embedding") -> str:
    """A sum over i of a vector's elements, in order and in double."""
    return f"list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, len({n}) + 1), lambda i: {expr})), lambda s, x: s + x)"


_A, _Q = "CAST(embedding[i] AS DOUBLE)", "CAST(q[i] AS DOUBLE)"
_L2S, _DOT, _NA, _NQ = _fold(f"({_A} - {_Q}) * ({_A} - {_Q})"), _fold(f"{_A} * {_Q}"), f"sqrt({_fold(f'{_A} * {_A}')})", f"sqrt({_fold(f'{_Q} * {_Q}')})"
_COS = f"1.0 - greatest(least({_DOT} / greatest({_NA} * {_NQ}, 1e-12), 1.0), -1.0)"
_FROM_Q = "FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _distance_sql(expr: str) -> str:
    return f"SELECT vec_id, round({expr}, 6) + 0.0 AS distance {_FROM_Q}"


def _top_sql(expr: str) -> str:
    return f"SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {expr} AS d {_FROM_Q}) ORDER BY d, vec_id LIMIT {K}"


# fitting and coding


def _calibrated(q: Q.Quantizer, spark: SparkSession) -> DataFrame:
    return q.bounds(spark).select("dim", _r(F.col("low")).alias("low"), _r(F.col("high")).alias("high"))


@_query(f"WITH {_E}, {_B} SELECT dim, round(CAST(mn AS DOUBLE), 6) AS low, round(CAST(mx AS DOUBLE), 6) AS high FROM b")
def calibrate_minmax(spark, sf_dir):
    return _calibrated(Q.calibrate(_embeddings(spark, sf_dir)), spark)


@_query(f"WITH {_E}, g AS (SELECT min(v) AS mn, max(v) AS mx FROM e) SELECT DISTINCT dim, round(CAST(mn AS DOUBLE), 6) AS low, round(CAST(mx AS DOUBLE), 6) AS high FROM e, g")
def calibrate_global(spark, sf_dir):
    return _calibrated(Q.calibrate_global(_embeddings(spark, sf_dir)), spark)


@_query(
    f"WITH {_E}, n AS (SELECT count(*) AS n FROM embeddings), o AS (SELECT dim, v, row_number() OVER (PARTITION BY dim ORDER BY v) - 1 AS r FROM e) "
    "SELECT dim, round(CAST(max(CASE WHEN r = CAST(floor(CAST(0.05 AS FLOAT) * (n - 1)) AS BIGINT) THEN v END) AS DOUBLE), 6) AS low, round(CAST(max(CASE WHEN r = CAST(ceil(CAST(0.95 AS FLOAT) * (n - 1)) AS BIGINT) THEN v END) AS DOUBLE), 6) AS high FROM o, n GROUP BY dim"
)
def calibrate_percentile_5_95(spark, sf_dir):
    return _calibrated(Q.calibrate_percentile(_embeddings(spark, sf_dir), 5, 95), spark)


@_query(f"WITH {_E}, {_B} SELECT dim, round(CAST(mn AS DOUBLE), 6) AS low, round(CAST(mx AS DOUBLE), 6) AS high FROM b")
def calibrate_skip_nan(spark, sf_dir):
    return _calibrated(Q.calibrate(_embeddings(spark, sf_dir), skip_nan=True), spark)


def _coded(df: DataFrame) -> tuple[DataFrame, Q.Quantizer]:
    q = Q.calibrate(df)
    return q.quantize(df), q


@_query(f"{_CODED} SELECT vec_id, dim, code FROM c")
def quantize_codes(spark, sf_dir):
    return I.build(_coded(_embeddings(spark, sf_dir))[0]).select("vec_id", "dim", F.col("code").cast("int").alias("code"))


@_query(f"{_CODED} SELECT vec_id, dim, round(CAST(r AS DOUBLE), 6) AS value FROM d")
def dequantize_values(spark, sf_dir):
    df, q = _coded(_embeddings(spark, sf_dir))
    return _long(q.dequantize(df), "decoded")


@_query(f"WITH {_E}, {_B} SELECT vec_id, dim, CASE WHEN v > CAST(0.5 AS FLOAT) * mx THEN 255 ELSE CAST(floor(least(greatest((v - mn * CAST(0.5 AS FLOAT)) / (mx * CAST(0.5 AS FLOAT) - mn * CAST(0.5 AS FLOAT)), CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) * CAST(255 AS FLOAT)) AS INTEGER) END AS code FROM e JOIN b USING (dim)")
def quantize_clipped(spark, sf_dir):
    """Bounds of half the range, so values outside are clipped."""
    df = _embeddings(spark, sf_dir)
    q = Q.calibrate(df)
    half = Q.Quantizer(tuple(x / 2 for x in q.low), tuple(x / 2 for x in q.high))
    return I.build(half.quantize(df, degenerate="zero")).select("vec_id", "dim", F.col("code").cast("int").alias("code"))


# distances


def _distance(metric):
    def f(spark, sf_dir):
        df = _embeddings(spark, sf_dir)
        return df.select("vec_id", _r(metric(V.vector(_vector(df, 0)), F.col("embedding"))).alias("distance"))

    return f


for _name, _metric, _expr in (
    ("dist_l2_squared", V.l2_squared, _L2S), ("dist_l2", V.l2, f"sqrt({_L2S})"), ("dist_dot", V.dot, _DOT), ("dist_cosine", V.cosine_distance, _COS),
    ("cosine_similarity", V.cosine_similarity, f"1.0 - ({_COS})"), ("dist_inner_product", V.inner_product_distance, f"0.0 - {_DOT}"),
):
    QUERIES[_name], ORACLES[_name] = _distance(_metric), _distance_sql(_expr)


@_query(f"SELECT vec_id, round({_NA}, 6) AS norm FROM embeddings")
def norm_l2(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", _r(V.l2_norm("embedding")).alias("norm"))


def _each_sql(expr: str, more: str = "") -> str:
    return f"WITH n AS (SELECT vec_id, embedding, {_NA} AS norm FROM embeddings), x AS (SELECT vec_id, norm, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM n){more} SELECT vec_id, dim, round(CAST({expr} AS DOUBLE), 6) + 0.0 AS value FROM x"


@_query(_each_sql("CASE WHEN norm > 1e-12 THEN CAST(v / norm AS FLOAT) ELSE v END"))
def normalize_vectors(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return _long(df.withColumn("n", V.normalized("embedding")), "n")


# arithmetic

_PAIR = "p AS (SELECT a.vec_id, a.dim, a.v AS v, q.v AS w FROM e a JOIN e q ON a.dim = q.dim AND q.vec_id = 0)"


def _arithmetic(make):
    def f(spark, sf_dir):
        df = _embeddings(spark, sf_dir)
        return _long(df.withColumn("o", make(F.col("embedding"), V.vector(_vector(df, 0)))), "o")

    return f


for _name, _make, _expr in (
    ("vec_add", V.add, "v + w"), ("vec_sub", V.sub, "v - w"), ("vec_scale", lambda a, _: V.scale(a, 2.5), "v * CAST(2.5 AS FLOAT)"),
    ("vec_clamp", lambda a, _: V.clamp(a, -0.1, 0.1), "CASE WHEN v < CAST(-0.1 AS FLOAT) THEN CAST(-0.1 AS FLOAT) WHEN v > CAST(0.1 AS FLOAT) THEN CAST(0.1 AS FLOAT) ELSE v END"),
):
    QUERIES[_name] = _arithmetic(_make)
    ORACLES[_name] = f"WITH {_E}, {_PAIR} SELECT vec_id, dim, round(CAST({_expr} AS DOUBLE), 6) + 0.0 AS value FROM p"


# search


def _top(metric):
    def f(spark, sf_dir):
        df = _embeddings(spark, sf_dir)
        return S.top_k(df, _vector(df, 0), K, metric).select("vec_id", _r(F.col("distance")).alias("distance"))

    return f


for _name, _metric, _expr in (("topk_exact_l2", "l2", _L2S), ("topk_exact_cosine", "cosine", _COS), ("topk_exact_ip", "ip", f"0.0 - {_DOT}")):
    QUERIES[_name], ORACLES[_name] = _top(_metric), _top_sql(_expr)


@_query(_top_sql(_fold(f"abs({_A} - {_Q})")))
def topk_custom_function(spark, sf_dir):
    """Any function of two columns: here the sum of absolute differences."""
    df = _embeddings(spark, sf_dir)
    manhattan = lambda q, v: F.aggregate(F.zip_with(q, v, lambda x, y: F.abs(y.cast("double") - x.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return S.top_k(df, _vector(df, 0), K, function=manhattan).select("vec_id", _r(F.col("distance")).alias("distance"))


def _quantized_sql(query: str) -> str:
    return f"{_CODED}, q AS (SELECT dim, {query} AS w FROM d WHERE vec_id = 0), t AS (SELECT d.vec_id, sum((CAST(r AS DOUBLE) - CAST(w AS DOUBLE)) * (CAST(r AS DOUBLE) - CAST(w AS DOUBLE))) AS x FROM d JOIN q USING (dim) GROUP BY d.vec_id) SELECT vec_id, round(x, 6) + 0.0 AS distance FROM t ORDER BY x, vec_id LIMIT {K}"


@_query(_quantized_sql("v"))
def topk_quantized_l2(spark, sf_dir):
    """The flagship: fit, code, decode, distance, nearest."""
    df = _embeddings(spark, sf_dir)
    q = Q.calibrate(df)
    return S.top_k(q.decoded(df), _vector(df, 0), K, "l2", "decoded").select("vec_id", _r(F.col("distance")).alias("distance"))


@_query(_quantized_sql("r"))
def topk_query_quantized(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    coded, q = _coded(df)
    return S.top_k_quantized(coded, q, _vector(df, 0), K).select("vec_id", _r(F.col("distance")).alias("distance"))


_BATCH = (
    "WITH t AS (SELECT query_id, vec_id, {d} AS d FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)), "
    f"o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM t) SELECT query_id, vec_id, rank, round(d, 6) + 0.0 AS distance FROM o WHERE rank <= {K}"
)


@_query(_BATCH.replace("{d}", _L2S))
def batch_topk(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return S.batch_top_k(df, _queries(df), K).select("query_id", "vec_id", "rank", _r(F.col("distance")).alias("distance"))


@_query(_BATCH.replace("{d}", _COS))
def batch_topk_expressions(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    queries = df.filter(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return S.top_k_by_query(df, queries, K, "cosine").select("query_id", "vec_id", "rank", _r(F.col("distance")).alias("distance"))


# lookups

_IDS = ", ".join(f"({i}, {v})" for i, v in enumerate(IDS))


@_query(f"SELECT CAST(pos AS INTEGER) AS pos, vec_id, dim, round(CAST(v AS DOUBLE), 6) AS value FROM (SELECT p AS pos, embeddings.vec_id, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM (VALUES {_IDS}) AS w(p, i) JOIN embeddings ON embeddings.vec_id = i)")
def get_batch_lookup(spark, sf_dir):
    found = L.get_batch(_embeddings(spark, sf_dir), IDS)
    return found.select("pos", "vec_id", F.posexplode("embedding").alias("dim", "x")).select("pos", "vec_id", "dim", _r(F.col("x")).alias("value"))


@_query(f"WITH {_E} SELECT vec_id, dim, round(CAST(v AS DOUBLE), 6) AS value FROM e WHERE vec_id = 42")
def get_vector(spark, sf_dir):
    return _long(L.get(_embeddings(spark, sf_dir), 42), "embedding")


@_query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE vec_id >= 20 AND vec_id < 70")
def page_range(spark, sf_dir):
    return L.page(_embeddings(spark, sf_dir), 20, 50).select("vec_id", F.size("embedding").alias("dims"))


@_query("SELECT CAST(floor(vec_id / 64) AS BIGINT) AS chunk, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) + 0.0 AS total FROM embeddings GROUP BY 1")
def chunked_read(spark, sf_dir):
    c = L.chunks(_embeddings(spark, sf_dir), 64)
    return c.select("chunk", F.size("vectors").cast("long").alias("n"), _r(F.aggregate(F.flatten("vectors"), F.lit(0.0), lambda s, v: s + v.cast("double")), 4).alias("total"))


# errors

_ERR = "CAST(v AS DOUBLE) - CAST(r AS DOUBLE)"


@_query(
    f"{_CODED} SELECT 64 AS dims, count(DISTINCT vec_id) AS num_vectors, round(sum(({_ERR}) * ({_ERR})) / count(*) * 1e6, 4) AS mse_e6, round(sum(abs({_ERR})) / count(*), 6) AS mae, round(CAST(max(abs(v - r)) AS DOUBLE), 6) AS max_abs_error, "
    f"round(10 * log10(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) / sum(({_ERR}) * ({_ERR}))), 4) AS snr_db, CAST(4.0 AS DOUBLE) AS compression_ratio, count(*) * 4 AS original_bytes, count(*) AS compressed_bytes FROM d"
)
def quant_report(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    r = ST.evaluate(df, Q.calibrate(df))
    return r.select("dims", "num_vectors", F.round(F.col("mse") * 1e6, 4).alias("mse_e6"), _r(F.col("mae")).alias("mae"), _r(F.col("max_abs_error")).alias("max_abs_error"), F.round("snr_db", 4).alias("snr_db"), "compression_ratio", "original_bytes", "compressed_bytes")


@_query(f"{_CODED} SELECT dim, round(sum(({_ERR}) * ({_ERR})) / count(*) * 1e6, 4) AS mse_e6, round(CAST(max(mx) - max(mn) AS DOUBLE), 6) AS range FROM d GROUP BY dim")
def quant_per_dim_mse(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    q = Q.calibrate(df)
    spans = q.bounds(spark).select("dim", _r(F.col("high") - F.col("low")).alias("range"))
    return ST.by_dimension(df, q).select("dim", F.round(F.col("square") / F.col("n") * 1e6, 4).alias("mse_e6")).join(spans, "dim")


@_query(f"{_CODED} SELECT vec_id, round(sum(({_ERR}) * ({_ERR})) / count(*) * 1e6, 4) AS mse_e6, round(sum(abs({_ERR})) / count(*), 6) AS mae, round(max(abs({_ERR})), 6) AS max_abs_error, round(10 * log10(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) / sum(({_ERR}) * ({_ERR}))), 4) AS snr_db FROM d GROUP BY vec_id")
def quant_row_error(spark, sf_dir):
    df, q = _coded(_embeddings(spark, sf_dir))
    d = q.dequantize(df)
    a, b = "embedding", "decoded"
    return d.select("vec_id", F.round(V.mse(a, b) * 1e6, 4).alias("mse_e6"), _r(V.mae(a, b)).alias("mae"), _r(V.max_abs_error(a, b)).alias("max_abs_error"), F.round(V.snr_db(a, b), 4).alias("snr_db"))


@_query(f"WITH {_E}, {_B} SELECT dim, round(CAST(mx - mn AS DOUBLE) / 255.0, 8) AS max_error, round(CAST(mx - mn AS DOUBLE) / 255.0 * (CAST(mx - mn AS DOUBLE) / 255.0) / 12.0 * 1e6, 6) AS mse_e6 FROM b")
def theoretical_error(spark, sf_dir):
    span = (F.col("high") - F.col("low")).cast("double")
    b = Q.calibrate(_embeddings(spark, sf_dir)).bounds(spark)
    return b.select("dim", F.round(V.theoretical_max_error(span), 8).alias("max_error"), F.round(V.theoretical_mse_uniform(span) * 1e6, 6).alias("mse_e6"))


@_query("SELECT sum(len(embedding)) AS data_bytes, sum(len(embedding)) * 4 AS original_bytes, CAST(4.0 AS DOUBLE) AS ratio FROM embeddings".replace("sum(len(embedding))", "CAST(sum(len(embedding)) AS BIGINT)"))
def payload_sizes(spark, sf_dir):
    return ST.sizes(_embeddings(spark, sf_dir), 64)


# transforms


@_query(f"WITH {_E} SELECT dim, round(avg(CAST(v AS DOUBLE)), 6) + 0.0 AS mean FROM e GROUP BY dim")
def mean_vector(spark, sf_dir):
    return TR.mean_by_dimension(_embeddings(spark, sf_dir)).select("dim", _r(F.col("mean")).alias("mean"))


@_query(f"WITH {_E} SELECT dim, round(var_pop(CAST(v AS DOUBLE)), 6) AS variance FROM e GROUP BY dim")
def variance_vector(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return TR.variance_by_dimension(df, TR.mean_by_dimension(df)).select("dim", _r(F.col("variance")).alias("variance"))


_M = "m AS (SELECT dim, avg(CAST(v AS DOUBLE)) AS m, greatest(stddev_pop(CAST(v AS DOUBLE)), 1e-6) AS s FROM e GROUP BY dim)"


@_query(f"WITH {_E}, {_M} SELECT vec_id, dim, round(CAST(v - CAST(m AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM e JOIN m USING (dim)")
def center_vectors(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return _long(TR.apply(df, TR.fit_centering(df)), "embedding", digits=5)


@_query(f"WITH {_E}, {_M} SELECT vec_id, dim, round(CAST((v - CAST(m AS FLOAT)) / CAST(s AS FLOAT) AS DOUBLE), 3) + 0.0 AS value FROM e JOIN m USING (dim)")
def standardize_vectors(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return _long(TR.apply(df, TR.fit_standardizer(df)), "embedding", digits=3)


@_query(f"WITH {_E}, {_M}, c AS (SELECT vec_id, dim, v - CAST(m AS FLOAT) AS c FROM e JOIN m USING (dim)), n AS (SELECT vec_id, sqrt(sum(CAST(c AS DOUBLE) * CAST(c AS DOUBLE))) AS n FROM c GROUP BY vec_id) SELECT vec_id, dim, round(CAST(CAST(c / greatest(n, 1e-12) AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM c JOIN n USING (vec_id)")
def chain_center_normalize(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    t = TR.chain(TR.fit_centering(df), TR.normalizer(64))
    return _long(TR.apply(df, t), "embedding", digits=4)


@_query(f"{_CODED} SELECT vec_id, dim, round(CAST(r AS DOUBLE), 6) AS value FROM d")
def pipeline_roundtrip(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    p = TR.Pipeline([TR.identity(64)], Q.calibrate(df))
    return _long(p.run(df), "embedding")


# postings and search quality


@_query(f"{_CODED} SELECT dim, code, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM c GROUP BY dim, code")
def index_postings_count(spark, sf_dir):
    return I.counts(I.build(_coded(_embeddings(spark, sf_dir))[0])).withColumn("code", F.col("code").cast("int"))


@_query(f"{_CODED} SELECT dim, code, CAST(vec_id // 256 AS BIGINT) AS block, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids FROM c GROUP BY ALL")
def index_postings(spark, sf_dir):
    p = I.postings(I.build(_coded(_embeddings(spark, sf_dir))[0]), 256)
    return p.select("dim", F.col("code").cast("int").alias("code"), "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@_query(f"{_CODED} SELECT vec_id FROM c WHERE dim = 3 AND code = 128")
def index_lookup(spark, sf_dir):
    return I.lookup(_coded(_embeddings(spark, sf_dir))[0], 3, 128)


@_query("SELECT CAST(64 AS BIGINT) AS dims, CAST(sum(len(embedding)) AS BIGINT) AS total, CAST(sum(len(embedding)) AS DOUBLE) / 64 AS avg_per_dim FROM embeddings")
def index_stats(spark, sf_dir):
    return I.stats(I.build(_coded(_embeddings(spark, sf_dir))[0]))


_HITS = (
    f"{_CODED}, q AS (SELECT vec_id AS query_id, dim, v AS w FROM d WHERE vec_id % 50 = 0), "
    "t AS (SELECT query_id, vec_id, sum((CAST(v AS DOUBLE) - CAST(w AS DOUBLE)) * (CAST(v AS DOUBLE) - CAST(w AS DOUBLE))) AS exact, sum((CAST(r AS DOUBLE) - CAST(w AS DOUBLE)) * (CAST(r AS DOUBLE) - CAST(w AS DOUBLE))) AS coded FROM d JOIN q USING (dim) GROUP BY query_id, vec_id), "
    "o AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY coded, vec_id) AS b FROM t) "
)


@_query(f"{_HITS} SELECT round(avg(h) / {K}, 6) AS recall_at_k, round(avg(h) / {K}, 6) AS precision_at_k FROM (SELECT query_id, count(*) FILTER (WHERE a <= {K} AND b <= {K}) AS h FROM o GROUP BY query_id)")
def recall_at_k(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    r = M.evaluate_search(df, Q.calibrate(df), _queries(df), K)
    return r.select(_r(F.col("recall_at_k")).alias("recall_at_k"), _r(F.col("precision_at_k")).alias("precision_at_k"))


@_query(f"{_HITS} SELECT round(avg(m), 6) AS mrr FROM (SELECT query_id, max(CASE WHEN a = 1 AND b <= {K} THEN 1.0 / b ELSE 0 END) AS m FROM o GROUP BY query_id)".replace("1.0 / b", "CAST(1 AS DOUBLE) / b"))
def mrr(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return M.evaluate_search(df, Q.calibrate(df), _queries(df), K).select(_r(F.col("mrr")).alias("mrr"))


# text


@_query("SELECT vec_id, printf('%.4f, %.4f, %.4f', CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)) AS shown FROM embeddings")
def format_vector(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", T.format_vector(F.transform("embedding", lambda x: x.cast("double")), 3).alias("shown"))


@_query("SELECT CAST(p - 1 AS BIGINT) AS vec_id, CAST(d - 1 AS INTEGER) AS dim, CAST(3 * (p - 1) + d - 1 AS DOUBLE) AS value FROM range(1, 3) AS a(p), range(1, 4) AS b(d)")
def parse_json_vectors(spark, sf_dir):
    from lodestone.sources import datasets

    return _long(datasets.from_json(spark, "[[0, 1, 2], [3,4,5]]"), "embedding")


@_query(f"WITH {_E} SELECT vec_id, dim, round(CAST(CAST(printf('%.6f', CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS value FROM e")
def parse_text_vectors(spark, sf_dir):
    line = T.fixed("embedding", 6, ", ")
    return _long(_embeddings(spark, sf_dir).select("vec_id", T.parse_vector(line).alias("v")), "v")


@_query(f"WITH {_E} SELECT vec_id, dim, round(CAST(CAST(printf('%.6f', CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS value FROM e")
def parse_json_rows(spark, sf_dir):
    line = F.concat(F.lit("[["), T.fixed("embedding", 6, ", "), F.lit("]]"))
    return _long(_embeddings(spark, sf_dir).select("vec_id", F.get(T.parse_vectors(line), F.lit(0)).alias("v")), "v")


@_query("SELECT url, 'id' || CAST(page_id AS VARCHAR) AS first, 'b c' AS second, CAST(2 AS INTEGER) AS n FROM pages")
def query_string(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    m = T.url_query(F.concat(F.lit("a=x&a=id"), F.col("page_id").cast("string"), F.lit("&&key=b%20c")))
    return pages.select("url", m.alias("m")).select("url", F.col("m")["a"].alias("first"), F.col("m")["key"].alias("second"), F.size("m").alias("n"))


@_query("SELECT item_id, lower(substr(hex(encode(text)), 1, 16)) || '…' AS preview FROM benchmark")
def hex_previews(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", T.hex_preview(F.encode("text", "utf-8")).alias("preview"))


@_query("SELECT conv_id, turn, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') AS escaped FROM conversations")
def json_escaped(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.json_escape("text").alias("escaped"))


@_query(f"{_CODED} SELECT vec_id, dim, code FROM c WHERE vec_id = 42")
def get_codes(spark, sf_dir):
    """The codes of one vector, as the file holds them."""
    path, _ = _written(spark, sf_dir)
    found = L.get(_read(spark, path)[0], 42)
    return found.select("vec_id", F.posexplode("codes").alias("dim", "code")).select("vec_id", "dim", F.col("code").cast("int").alias("code"))


@_query(f"{_CODED} SELECT CAST(pos AS INTEGER) AS pos, vec_id, dim, code FROM (SELECT p AS pos, c.* FROM (VALUES {_IDS}) AS w(p, i) JOIN c ON c.vec_id = i)")
def get_batch_codes(spark, sf_dir):
    path, _ = _written(spark, sf_dir)
    found = L.get_batch(_read(spark, path)[0], IDS)
    return found.select("pos", "vec_id", F.posexplode("codes").alias("dim", "code")).select("pos", "vec_id", "dim", F.col("code").cast("int").alias("code"))


@_query(f"WITH {_E} SELECT vec_id, dim, round(CAST(v AS DOUBLE), 6) AS value FROM e WHERE vec_id IN ({', '.join(map(str, sorted(set(IDS))))})")
def cached_reads(spark, sf_dir):
    from lodestone.sources import datasets

    df = _embeddings(spark, sf_dir)
    reader = L.CachedReader(df, 2)
    ids = sorted(set(IDS))
    rows = dict(zip(ids, reader.get_batch(ids), strict=True))
    made = datasets.from_rows(spark, list(rows.values())).withColumn("vec_id", F.element_at(F.array(*map(F.lit, ids)), (F.col("vec_id") + 1).cast("int")).cast("long"))
    return _long(made, "embedding")


@_query(f"SELECT vec_id, dim, round(CAST(v AS DOUBLE), 6) AS value FROM (SELECT vec_id, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT {K}))")
def first_vectors(spark, sf_dir):
    from lodestone.sources import datasets

    return _long(datasets.first_rows(_embeddings(spark, sf_dir), K), "embedding")


_ONE_LINE = "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), '{sep}') AS s FROM embeddings"


@_query(_ONE_LINE.replace("{sep}", ",").replace("SELECT vec_id, ", "SELECT ").replace(" AS s", " AS line"))
def export_csv_lines(spark, sf_dir):
    from lodestone.sources import datasets

    path = _file(spark, "csv")
    datasets.export_csv(_embeddings(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@_query("SELECT '[' || s || ']' AS line FROM (" + _ONE_LINE.replace("{sep}", ", ") + ")")
def export_json_lines(spark, sf_dir):
    from lodestone.sources import datasets

    path = _file(spark, "json")
    datasets.export_json_lines(_embeddings(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


#: Fixed values of the generators' recurrence in SQL: shifts of the 64-bit xorshift; states are unsigned.
_STATES = "s(i, x) AS (SELECT 0, CAST({seed} AS UBIGINT) UNION ALL SELECT i + 1, xor(c, CAST((CAST(c AS UHUGEINT) * 131072) % 18446744073709551616 AS UBIGINT)) FROM (SELECT i, xor(b, b >> 7) AS c FROM (SELECT i, xor(x, CAST((CAST(x AS UHUGEINT) * 8192) % 18446744073709551616 AS UBIGINT)) AS b FROM s WHERE i < {n})))"


@_query(f"WITH RECURSIVE {_STATES.format(seed=42, n=40)} SELECT CAST((i - 1) // 4 AS BIGINT) AS vec_id, CAST((i - 1) % 4 AS INTEGER) AS dim, round(CAST(CAST(-1 AS FLOAT) + CAST(CAST(x AS DOUBLE) / 18446744073709551615.0 AS FLOAT) * CAST(2 AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM s WHERE i > 0")
def uniform_vectors(spark, sf_dir):
    """A generator: it reads no table."""
    from lodestone.sources import datasets

    return _long(datasets.synthetic_uniform(spark, 10, 4), "embedding", digits=5)


def clustered_vectors(spark, sf_dir):
    """A generator: it reads no table, and tests hold it against its definition."""
    from lodestone.sources import datasets

    return _long(datasets.synthetic_clustered(spark, 20, 8, 3, 0.1, 123), "embedding", digits=5)


QUERIES["clustered_vectors"] = clustered_vectors


@_query(
    f"{_CODED}, t AS (SELECT count(DISTINCT vec_id) AS n, sum(({_ERR}) * ({_ERR})) / count(*) AS mse, sum(abs({_ERR})) / count(*) AS mae, CAST(max(abs(v - r)) AS DOUBLE) AS far, 10 * log10(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) / sum(({_ERR}) * ({_ERR}))) AS snr FROM d) "
    "SELECT printf('dims=%d vectors=%d mse=%.6f mae=%.6f max=%.6f snr=%.2f dB ratio=%.2fx', 64, n, mse, mae, far, snr, CAST(4 AS DOUBLE)) AS summary FROM t"
)
def report_summary(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    return ST.summary(ST.evaluate(df, Q.calibrate(df)))


#: Ranks lie within a share 1 / accuracy of the rows; the test holds them against exact ranks.
def calibrate_percentile_approx(spark, sf_dir):
    return _calibrated(Q.calibrate_percentile_approx(_embeddings(spark, sf_dir), 5, 95), spark)


QUERIES["calibrate_percentile_approx"] = calibrate_percentile_approx


# files: what is read back from a written file; rows only


@_query(f"{_CODED} SELECT vec_id, dim, round(CAST(r AS DOUBLE), 6) AS value FROM d")
def btcp_roundtrip(spark, sf_dir):
    from lodestone.sources import btcp

    df = _embeddings(spark, sf_dir)
    path = _file(spark)
    btcp.write(df, path, Q.calibrate(df), "l2")
    back, meta = btcp.read(spark, path)
    return _long(meta.quantizer.dequantize(back), "decoded")


@_query("SELECT CAST(64 AS INTEGER) AS dims, count(*) AS n, true AS checksum_valid, true AS row_ids_monotonic, true AS metadata_finite, true AS footer_size_ok, true AS is_valid FROM embeddings")
def validate_report(spark, sf_dir):
    from lodestone.sources import btcp

    df = _embeddings(spark, sf_dir)
    path = _file(spark)
    btcp.write(df, path, Q.calibrate(df), "cosine", pad=True)
    r = btcp.validate_many(spark, path)
    return r.select("dims", F.col("count").alias("n"), "checksum_valid", "row_ids_monotonic", "metadata_finite", "footer_size_ok", "is_valid")


@_query(f"{_CODED} SELECT vec_id, dim, round(CAST(r AS DOUBLE), 6) AS value FROM d")
def btcp_unverified(spark, sf_dir):
    """Opened without the checksum, by a configuration."""
    path, _ = _written(spark, sf_dir, C.FileConfig(64, metric=C.Metric.COSINE, align_blocks=True))
    back, meta = _read(spark, path, verify=False)
    return _long(meta.quantizer.dequantize(back), "decoded")


@_query(f"{_CODED} SELECT vec_id, dim, code FROM c")
def btcp_append_codes(spark, sf_dir):
    """Rows that are coded already."""
    from lodestone.sources import btcp

    df, q = _coded(_embeddings(spark, sf_dir))
    path = _file(spark)
    btcp.write(df.select("vec_id", "codes"), path, q, codes="codes")
    back, _ = btcp.read(spark, path)
    return back.select("vec_id", F.posexplode("codes").alias("dim", "code")).select("vec_id", "dim", F.col("code").cast("int").alias("code"))


@_query("SELECT CAST(1 AS INTEGER) AS major, CAST(2 AS INTEGER) AS minor, CAST(64 AS INTEGER) AS dims, CAST(1 AS INTEGER) AS metric, count(*) AS n, CAST(ceil((32 + 8 * 64 + count(*) * 64) / 4096.0) * 4096 AS BIGINT) AS footer_offset, true AS quick FROM embeddings")
def btcp_header(spark, sf_dir):
    from lodestone.sources import btcp

    path, _ = _written(spark, sf_dir, C.FileConfig(64, minor=2, metric=C.Metric.COSINE, align_blocks=True))
    h = btcp.read_header(path)
    return spark.createDataFrame([(h.major, h.minor, h.dims, int(h.metric), h.vector_count, h.footer_offset, btcp.quick_check(path))], "major int, minor int, dims int, metric int, n long, footer_offset long, quick boolean")


@_query("SELECT count(*) AS n, false AS checksum_valid, false AS is_valid, true AS refused FROM embeddings")
def btcp_damaged(spark, sf_dir):
    """One byte of the codes is flipped."""
    from lodestone.errors import LodestoneError
    from lodestone.sources import btcp

    path, _ = _written(spark, sf_dir)
    with open(path, "r+b") as f:
        f.seek(32 + 8 * 64)
        byte = f.read(1)[0]
        f.seek(32 + 8 * 64)
        f.write(bytes([byte ^ 1]))
    try:
        btcp.open_file(path)
        refused = False
    except LodestoneError:
        refused = True
    return btcp.validate_many(spark, path).select(F.col("count").alias("n"), "checksum_valid", "is_valid", F.lit(refused).alias("refused"))


@_query("SELECT CAST(1 AS INTEGER) AS waiting, count(*) + 3 AS n, (count(*) + 3) * 64 AS data_bytes, true AS size_foretold, true AS is_valid FROM embeddings")
def btcp_grown(spark, sf_dir):
    """A table and three single vectors, of which two are staged at once."""
    from lodestone.sources import btcp, builder

    df, path = _embeddings(spark, sf_dir), _file(spark)
    b = builder.FileBuilder(spark, path, Q.calibrate(df), C.FileConfig(64, align_blocks=True), threshold=2)
    b.append(df)
    for x in (-1.0, 0.0, 1.0):
        b.push([x] * 64)
    waiting, foretold = len(b.waiting), b.estimated_size
    size = b.finish().file_size
    return btcp.validate_many(spark, path).select(F.lit(waiting).alias("waiting"), F.col("count").alias("n"), F.lit(b.data_bytes).cast("long").alias("data_bytes"), F.lit(size == foretold).alias("size_foretold"), "is_valid")


def _written(spark: SparkSession, sf_dir: str, config: C.FileConfig | None = None) -> tuple[str, Q.Quantizer]:
    from lodestone.sources import btcp

    df, path = _embeddings(spark, sf_dir), _file(spark)
    q = Q.calibrate(df)
    btcp.write(df, path, q, **(config or C.FileConfig(64)).writer_options())
    return path, q


def _read(spark: SparkSession, path: str, verify: bool = True):
    from lodestone.sources import btcp

    return btcp.read(spark, path, verify)


def _file(spark: SparkSession, kind: str = "btcp") -> str:
    """A place in the shared folder, which must be a plain one, as the format is read with seeks; without one, a temporary folder if
    the driver is the only executor."""
    import os
    import re
    import tempfile
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    if not shared and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        shared = tempfile.gettempdir()
    if not shared.startswith(("/", "file:/")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors open as files")
    where = re.sub("^file:/+", "/", shared)
    os.makedirs(where, exist_ok=True)
    return f"{where}/lodestone-{uuid.uuid4().hex}.{kind}"
