"""Registered queries of the engine's operators, with SQL that gives the same rows where SQL can.

Values are rounded on both sides, as two engines sum in different orders. Fixed factors come from small formulas.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import Loss, column
from ..functions.rng import held_out
from ..operators import assess as A
from ..operators import cluster as C
from ..operators import dispersion as D
from ..operators import graph as G
from ..operators import guide, linalg, simulate
from ..operators.models import NMF
from ..operators.neighbours import knn
from ..operators.nmf import Config, Fit, auto_rank, nmf, nnls_fit, project, project_named
from ..operators.svd import pca, svd
from ..sources import store
from ..sources.matrix import MatrixFrame
from ..streaming import projection
from . import unrolled as U
from .data import SCALE, activity, fixed_h, fixed_w, h_frame, supply, table, vectors, w_frame, with_regions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

A_SQL = "a AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), dims AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n FROM a)"
W_SQL = "w AS (SELECT i, 1.0::DOUBLE + (i * 7) % 5 AS w0, 1.0::DOUBLE + (i * 7 + 3) % 5 AS w1, 1.0::DOUBLE + (i * 7 + 6) % 5 AS w2 FROM (SELECT unnest(range(m)) AS i FROM dims))"
H_SQL = "h AS (SELECT j, 1.0::DOUBLE + (j * 5) % 7 AS h0, 1.0::DOUBLE + (j * 5 + 2) % 7 AS h1, 1.0::DOUBLE + (j * 5 + 4) % 7 AS h2 FROM (SELECT unnest(range(n)) AS j FROM dims))"
FIT_SQL = "fit AS (SELECT a.i, a.j, v, 0.1 * w0 * h0 + 0.2 * w1 * h1 + 0.3 * w2 * h2 AS mu FROM a JOIN w USING (i) JOIN h USING (j))"
ACT_SQL = "a AS (SELECT t AS i, user_id AS j, CAST(count(*) AS DOUBLE) AS v FROM (SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS t, user_id FROM events) GROUP BY 1, 2), dims AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n FROM a)"
VEC_SQL = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------- sources, slices, metadata


@query(f"WITH {A_SQL} SELECT i, j, v FROM a")
def matrix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).entries


@query(f"WITH {A_SQL} SELECT m AS \"rows\", n AS cols, (SELECT count(*) FROM a) AS nnz, round(100.0 * (SELECT count(*) FROM a) / (m * n), 6) AS density_pct FROM dims")
def matrix_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = supply(spark, sf_dir).info()
    return spark.createDataFrame([(i["rows"], i["cols"], i["nnz"], i["density_pct"])], "rows long, cols long, nnz long, density_pct double").withColumn("density_pct", r("density_pct"))


_STATS = "SELECT {k}, coalesce(nnz, 0) AS nnz, {of} - coalesce(nnz, 0) AS zeros, coalesce(t, 0) AS total, round(coalesce(t, 0) / {of}, 6) AS mean, round(sqrt(greatest(coalesce(q, 0) / {of} - power(coalesce(t, 0) / {of}, 2), 0)), 6) AS sd FROM (SELECT unnest(range({size})) AS {k} FROM dims) LEFT JOIN (SELECT {k}, count(*) FILTER (v <> 0) AS nnz, sum(v) AS t, sum(v * v) AS q FROM a GROUP BY {k}) USING ({k}), dims"


@query(f"WITH {A_SQL} " + _STATS.format(k="j", of="m", size="n"))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).column_stats().withColumns({"mean": r("mean"), "sd": r("sd")})


@query(f"WITH {A_SQL} " + _STATS.format(k="i", of="n", size="m"))
def row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).row_stats().withColumns({"mean": r("mean"), "sd": r("sd")})


@query(f"WITH {A_SQL} SELECT count(*) AS nnz, count(*) FILTER (v IS NULL OR isnan(v)) AS missing, count(*) FILTER (v < 0) AS negative FROM a")
def validate_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = supply(spark, sf_dir).validate()
    return spark.createDataFrame([tuple(v.values())], "nnz long, missing long, negative long")


@query(f"WITH {A_SQL}, o AS (SELECT s_suppkey AS i, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') SELECT k AS i, j, v FROM a JOIN o USING (i)")
def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_regions(spark, sf_dir).filter_rows("r_name = 'ASIA'").entries


@query(f"WITH {A_SQL}, o AS (SELECT p_partkey AS j, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part WHERE p_size > 40) SELECT i, k AS j, v FROM a JOIN o USING (j)")
def filter_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_regions(spark, sf_dir).filter_cols("p_size > 40").entries


@query("SELECT s_suppkey AS i FROM supplier WHERE s_acctbal > 0")
def obs_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_regions(spark, sf_dir).obs_indices("s_acctbal > 0")


@query(f"WITH {A_SQL}, p(i, k) AS (VALUES (5, 0), (3, 1), (5, 2)), q(j, l) AS (VALUES (11, 0), (7, 1), (60, 2), (2, 3)) SELECT CAST(k AS BIGINT) AS i, CAST(l AS BIGINT) AS j, v FROM a JOIN p USING (i) JOIN q USING (j)")
def slice_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).slice([5, 3, 5], [11, 7, 60, 2]).entries


@query(f"WITH {A_SQL} SELECT j AS i, i AS j, v FROM a")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).t().entries


@query(f"WITH {A_SQL} SELECT i, j, v FROM a UNION ALL SELECT i, j + n, 2 * v FROM a, dims")
def cbind(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    b = MatrixFrame(a.entries.select("i", "j", (F.col("v") * 2).alias("v")), a.m, a.n)
    return MatrixFrame.cbind([a, b]).entries


@query(f"WITH {A_SQL}, s AS (SELECT least(greatest(1, floor(40000.0 / (4 * m))), n) AS c, n FROM dims) SELECT CAST(x * c + 1 AS BIGINT) AS first, CAST(least((x + 1) * c, n) AS BIGINT) AS last FROM (SELECT unnest(range(CAST(ceil(n / c) AS BIGINT))) AS x, c, n FROM s)")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return spark.createDataFrame(store.chunk_ranges(a.n, store.chunk_columns(a.m, a.n, 40_000)), "first long, last long")


@query(f"WITH {A_SQL}, c AS (SELECT *, floor(j / 500) AS ch FROM a), l AS (SELECT ch, min(v) AS lo, max(v) AS hi FROM c GROUP BY ch) SELECT i, j, round(CASE WHEN hi > lo THEN floor((v - lo) / ((hi - lo) / 255) + 0.5) * ((hi - lo) / 255) + lo ELSE v END, 6) AS v FROM c JOIN l USING (ch)")
def quant8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.quantise8(supply(spark, sf_dir).entries, F.floor(F.col("j") / 500)).withColumn("v", r("v"))


@query(f"WITH {A_SQL}, x AS (SELECT i, j, v * 1.0001::DOUBLE AS v FROM a) SELECT i, j, round_even(v / power(2, floor(log2(v)) - 10), 0) * power(2, floor(log2(v)) - 10) AS v FROM x")
def fp16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).entries.select("i", "j", store.half(F.col("v") * 1.0001).alias("v"))


@query(f"WITH {A_SQL} SELECT i, j, v FROM a WHERE j IN (3, 50, 77)")
def store_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store.write(supply(spark, sf_dir), path, include_transpose=True, chunk_cols=64)
    s = store.read(spark, path, cols=[3, 50, 77]).entries
    back = spark.createDataFrame([(0, 3), (1, 50), (2, 77)], "j long, old long")
    return s.join(F.broadcast(back), "j").select("i", F.col("old").alias("j"), "v")


@query(f"WITH {A_SQL} SELECT floor(j / 64) AS chunk, count(*) AS n, sum(v) AS total FROM a GROUP BY 1")
def map_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store.write(supply(spark, sf_dir), path, chunk_cols=64)
    return store.map_chunks(spark, path, lambda e, a, b: pd.DataFrame({"chunk": [float(a // 64)], "n": [len(e)], "total": [e["v"].sum()]}), "chunk double, n long, total double")


def _folder(spark: SparkSession) -> str:
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/stores/{uuid.uuid4().hex}"


@query("WITH t AS (SELECT doc_id AS j, unnest(string_split(lower(text), ' ')) AS term FROM documents) SELECT term, count(DISTINCT j) AS docs, count(*) AS n FROM t WHERE term <> '' GROUP BY term")
def term_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("j"), F.explode(F.split(F.lower("text"), " ")).alias("term")).where("term <> ''")
    cells = t.groupBy("term", "j").agg(F.count("*").alias("v"))
    return cells.groupBy("term").agg(F.count("*").alias("docs"), F.sum("v").alias("n"))


# ---------------------------------------------------------------- linear algebra


@query(f"WITH {A_SQL}, {W_SQL}, p AS (SELECT 0 AS a, 0 AS b, w0 * w0 AS x FROM w UNION ALL SELECT 0, 1, w0 * w1 FROM w UNION ALL SELECT 0, 2, w0 * w2 FROM w UNION ALL SELECT 1, 1, w1 * w1 FROM w UNION ALL SELECT 1, 2, w1 * w2 FROM w UNION ALL SELECT 2, 2, w2 * w2 FROM w) SELECT a, b, sum(x) AS g FROM p GROUP BY a, b")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return linalg.gram_frame(w_frame(spark, a.m).withColumnRenamed("w", "h"), 3)


@query(f"WITH {A_SQL}, {W_SQL} SELECT j, sum(v * w0) AS b0, sum(v * w1) AS b1, sum(v * w2) AS b2 FROM a JOIN w USING (i) GROUP BY j")
def rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return linalg.rhs(a, w_frame(spark, a.m), 3, a.m)


@query(f"WITH {A_SQL}, {H_SQL} SELECT i, sum(v * h0) AS b0, sum(v * h1) AS b1, sum(v * h2) AS b2 FROM a JOIN h USING (j) GROUP BY i")
def rhs_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return linalg.rhs_transposed(a, h_frame(spark, a.n), 3, a.n)


@query(f"WITH {A_SQL} SELECT sum(v * v) AS trace FROM a")
def trace_ata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(linalg.sum_of_squares(supply(spark, sf_dir)),)], "trace double")


@query(f"WITH {ACT_SQL}, n AS (SELECT i, sqrt(sum(v * v)) AS n FROM a GROUP BY i) SELECT x.i AS j, y.i AS j2, round(sum(x.v * y.v) / (max(p.n) * max(q.n)), 6) AS cosine FROM a x JOIN a y ON x.j = y.j AND x.i <= y.i JOIN n p ON p.i = x.i JOIN n q ON q.i = y.i GROUP BY x.i, y.i")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.cosine(activity(spark, sf_dir).t()).withColumn("cosine", r("cosine"))


@query(f"WITH {A_SQL}, mu AS (SELECT i, sum(v) / max(n) AS mean FROM a, dims GROUP BY i), x AS (SELECT j, 1.0::DOUBLE + j % 3 AS x FROM (SELECT unnest(range(n)) AS j FROM dims)), y AS (SELECT i, sum(v * x) AS y FROM a JOIN x USING (j) GROUP BY i) SELECT i, round(coalesce(y, 0) - mean * (SELECT sum(x) FROM x), 4) AS y FROM mu LEFT JOIN y USING (i)")
def spmv_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    x = spark.range(a.n).select(F.col("id").alias("j"), (1.0 + F.col("id") % 3).alias("x"))
    mean = a.row_stats().where("nnz > 0").select("i", "mean")
    return linalg.spmv(a, x, mean).withColumn("y", r("y", 4))


@query(f"WITH {A_SQL}, {W_SQL} SELECT j, round(0.1 * sum(v * w0), 6) AS h0, round(0.2 * sum(v * w1), 6) AS h1, round(0.3 * sum(v * w2), 6) AS h2 FROM a JOIN w USING (i) GROUP BY j")
def projective_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    h = linalg.projective_h(a, w_frame(spark, a.m), SCALE, a.m)
    return h.select("j", *[r(F.col("h")[q]).alias(f"h{q}") for q in range(3)])


@query(f"WITH {A_SQL}, {W_SQL}, g AS (SELECT sum(w0 * w0) AS g00, sum(w0 * w1) AS g01, sum(w1 * w1) AS g11 FROM w), b AS (SELECT j, sum(v * w0) AS b0, sum(v * w1) AS b1 FROM a JOIN w USING (i) GROUP BY j) SELECT j, round(greatest((b0 * g11 - b1 * g01) / (g00 * g11 - g01 * g01), 0), 6) AS h0, round(greatest((b1 * g00 - b0 * g01) / (g00 * g11 - g01 * g01), 0), 6) AS h1 FROM b, g")
def nnls_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    h = linalg.nnls2(a, w_frame(spark, a.m, 2), a.m)
    return h.select("j", r("h0").alias("h0"), r("h1").alias("h1"))


@query(f"WITH {A_SQL}, {W_SQL}, g AS (SELECT sum(w0 * w0) AS g00, sum(w0 * w1) AS g01, sum(w1 * w1) AS g11 FROM w), b AS (SELECT j, sum(v * w0) AS b0, sum(v * w1) AS b1 FROM a JOIN w USING (i) GROUP BY j), x AS (SELECT j, (b0 * g11 - b1 * g01) / (g00 * g11 - g01 * g01) AS x0, (b1 * g00 - b0 * g01) / (g00 * g11 - g01 * g01) AS x1, b0, b1, g00, g11 FROM b, g) SELECT j, round(CASE WHEN x0 >= 0 AND x1 >= 0 THEN x0 WHEN x1 < 0 THEN greatest(b0 / g00, 0) ELSE 0 END, 5) AS h0, round(CASE WHEN x0 >= 0 AND x1 >= 0 THEN x1 WHEN x0 < 0 THEN greatest(b1 / g11, 0) ELSE 0 END, 5) AS h1 FROM x")
def nnls_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate descent; two factors have a closed form."""
    a = supply(spark, sf_dir)
    h = project(a, fixed_w(a.m, 2)).join(a.entries.select("j").distinct(), "j")
    return h.select("j", r(F.col("h")[0], 5).alias("h0"), r(F.col("h")[1], 5).alias("h1"))


@query(f"WITH {A_SQL}, {W_SQL}, g AS (SELECT sum(w0 * w0) AS g00, sum(w0 * w1) AS g01, sum(w1 * w1) AS g11 FROM w), b AS (SELECT j, sum(v * w0) AS b0, sum(v * w1) AS b1 FROM a JOIN w USING (i) GROUP BY j), x AS (SELECT j, greatest((b0 * g11 - b1 * g01) / (g00 * g11 - g01 * g01), 0) AS h0, greatest((b1 * g00 - b0 * g01) / (g00 * g11 - g01 * g01), 0) AS h1 FROM b, g) SELECT j, round(h0, 6) AS h0, round(h1, 6) AS h1, CASE WHEN h0 > h1 THEN 0 ELSE 1 END AS cluster FROM x")
def bipartition_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    w = w_frame(spark, a.m, 2).select("i", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))
    return C.bipartition_step(a, w).select("j", r("h0").alias("h0"), r("h1").alias("h1"), "cluster")


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL} SELECT round(sum(power(coalesce(v, 0) - (0.1 * w0 * h0 + 0.2 * w1 * h1 + 0.3 * w2 * h2), 2)), 2) AS sse FROM w CROSS JOIN h LEFT JOIN a ON a.i = w.i AND a.j = h.j")
def sse_all_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    x = linalg.all_entries_sse(a, w_frame(spark, a.m), SCALE, h_frame(spark, a.n), a.m)
    return spark.createDataFrame([(x,)], "sse double").select(r("sse", 2).alias("sse"))


# ---------------------------------------------------------------- losses and dispersion

_LOSSES = {
    "mse": ("power(v - mu, 2)", Loss("mse")),
    "mae": ("abs(v - mu)", Loss("mae")),
    "huber": ("CASE WHEN abs(v - mu) <= 2 THEN power(v - mu, 2) / 2 ELSE 2 * (abs(v - mu) - 1) END", Loss("huber", delta=2.0)),
    "kl": ("v * ln(v / mu) - v + mu", Loss("kl")),
    "gp": ("-ln(mu / 1.2) - CASE WHEN v >= 1 THEN (v - 1) * ln((mu + 0.2 * v) / 1.2) ELSE 0 END + (mu + 0.2 * v) / 1.2", Loss("gp", theta=0.2)),
    "nb": ("-lgamma(v + 5) + lgamma(5) - 5 * ln(5 / (5 + mu)) - v * ln(mu / (5 + mu))", Loss("nb", size=5.0)),
    "gamma": ("2 * (-ln(v / mu) + (v - mu) / mu)", Loss("gamma")),
    "inverse_gaussian": ("power(v - mu, 2) / (mu * mu * v)", Loss("inverse_gaussian")),
    "tweedie": ("2 * (power(v, 0.5) / (-0.5 * 0.5) - v * power(mu, -0.5) / -0.5 + power(mu, 0.5) / 0.5)", Loss("tweedie", power=1.5)),
}


def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return linalg.fitted(a, w_frame(spark, a.m), SCALE, h_frame(spark, a.n), a.m, a.n)


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS loss, round(avg({s}), 6) AS mean, count(*) AS n FROM fit" for k, (s, _) in _LOSSES.items()))
def stored_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _fit(spark, sf_dir).agg(F.count("*").alias("n"), *[F.avg(column(F.col("v"), F.col("mu"), x)).alias(k) for k, (_, x) in _LOSSES.items()])
    return one.select("n", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in _LOSSES]), F.array(*_LOSSES))).alias("loss", "mean")).select("loss", r("mean").alias("mean"), "n")


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL}, z AS (SELECT abs(v - mu) / sqrt(mu) AS z FROM fit) SELECT round(avg(CASE WHEN z <= 1.345 THEN z * z / 2 ELSE 1.345 * (z - 1.345 / 2) END), 6) AS mean FROM z")
def robust_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir).agg(r(F.avg(column(F.col("v"), F.col("mu"), Loss("gp", robust=1.345)))).alias("mean"))


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL} SELECT round(avg(power(v - mu, 2)), 5) AS mse, count(*) AS n FROM fit WHERE (i * 31 + j * 17) % 10 <> 0")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    mask = a.entries.where("(i * 31 + j * 17) % 10 = 0").select("i", "j")
    fit = linalg.fitted(a.without(mask), w_frame(spark, a.m), SCALE, h_frame(spark, a.n), a.m, a.n)
    return linalg.stored_loss(fit, Loss()).select(r("mean", 5).alias("mse"), "n")


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL}, s AS (SELECT i, sum(mu * mu) AS num, sum(power(v - mu, 2) - mu) AS den FROM fit GROUP BY i) SELECT i, round(CASE WHEN den > 0 THEN least(greatest(num / den, 0.01), 1e6) ELSE 1e6 END, 6) AS size FROM s")
def nb_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nb_sizes(_fit(spark, sf_dir)).select("i", r("size").alias("size"))


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL} SELECT i, round(least(greatest(avg(power(v - mu, 2) / power(mu, 2.0)), 0.0001), 10000), 6) AS phi FROM fit WHERE v > 0 GROUP BY i")
def gamma_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pearson_phi(_fit(spark, sf_dir), 2.0).select("i", r("phi").alias("phi"))


_TH = ", ".join(f"q{t} AS (SELECT i, sum(CASE WHEN v >= 1 THEN (v - 1) * theta * v / greatest(mu + theta * v, 1e-10) ELSE 0 END) AS c, sum(v - mu) AS r, sum(v) AS y FROM fit JOIN p{t} USING (i) GROUP BY i), p{t + 1} AS (SELECT i, least(greatest((-(y - r - c) + sqrt(power(y - r - c, 2) + 4 * y * c)) / (2 * y), 0), 5) AS theta FROM q{t})" for t in range(5))


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL}, p0 AS (SELECT DISTINCT i, 0.1::DOUBLE AS theta FROM fit), {_TH} SELECT i, round(theta, 6) AS theta FROM p5")
def gp_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gp_theta(_fit(spark, sf_dir)).select("i", r("theta").alias("theta"))


@query(f"WITH {A_SQL} SELECT list_sort(list(v))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM a")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(D.upper_median(supply(spark, sf_dir).entries, "v"),)], "median double")


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL}, x AS (SELECT i, power(v - mu, 2) / mu AS x FROM fit), k AS (SELECT i, x, row_number() OVER (PARTITION BY i ORDER BY x) AS rn, count(*) OVER (PARTITION BY i) AS n FROM x) SELECT i, round(avg(x), 6) AS mean FROM k WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1) GROUP BY i")
def trimmed_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = _fit(spark, sf_dir).withColumn("x", (F.col("v") - F.col("mu")) ** 2 / F.col("mu"))
    return D.trimmed_mean(fit, "i", "x").select("i", r("mean").alias("mean"))


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL} " + " UNION ALL ".join(f"SELECT 'power_{p}' AS test, round(avg(power(v - mu, 2) / power(mu, {p}.0) - 1), 5) AS score FROM fit" for p in range(4)) + " UNION ALL SELECT 'nb_overdispersion', round(avg((power(v - mu, 2) - mu) / (mu * mu)), 5) FROM fit")
def score_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.score_test_fit(_fit(spark, sf_dir))
    return spark.createDataFrame([(x, float(y)) for x, y in zip(t["test"], t["score"])], "test string, score double").select("test", r("score", 5).alias("score"))


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, c AS (SELECT w.i, h.j, exp(-0.01 * (0.1 * w0 * h0 + 0.2 * w1 * h1 + 0.3 * w2 * h2)) AS p FROM w CROSS JOIN h), e AS (SELECT i, sum(p) AS expected, count(*) AS n FROM c GROUP BY i), z AS (SELECT i, count(*) AS nnz FROM a WHERE v <> 0 GROUP BY i), x AS (SELECT i, greatest((n - coalesce(nnz, 0) - expected) / n, 0) AS excess FROM e LEFT JOIN z USING (i)) SELECT round(avg(excess), 6) AS excess, round(var_samp(excess), 6) AS row_variance FROM x")
def zero_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    z = D.zero_inflation(a, NMF(fixed_w(a.m), SCALE * 0.01, h_frame(spark, a.n), a.n))
    return spark.createDataFrame([(z["excess"], z["row_variance"])], "excess double, row_variance double").select(r("excess").alias("excess"), r("row_variance").alias("row_variance"))


# ---------------------------------------------------------------- models


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL} SELECT 'nmf1' AS factor, round(avg(CAST(h0 = 1 AS INT)), 6) AS share FROM h UNION ALL SELECT 'nmf2', round(avg(CAST(h1 = 1 AS INT)), 6) FROM h UNION ALL SELECT 'nmf3', round(avg(CAST(h2 = 1 AS INT)), 6) FROM h")
def sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    h = h_frame(spark, a.n).select("j", F.transform("h", lambda x: x - 1).alias("h"))
    s = NMF(fixed_w(a.m), SCALE, h, a.n).sparsity().where("model = 'h'")
    return s.select("factor", r("sparsity").alias("share"))


@query(f"WITH {A_SQL}, {H_SQL}, g AS (SELECT p_partkey AS j, p_brand AS grp FROM part) SELECT grp AS \"group\", 'nmf1' AS factor, sum(h0) AS stat FROM h JOIN g USING (j) GROUP BY grp UNION ALL SELECT grp, 'nmf2', sum(h1) FROM h JOIN g USING (j) GROUP BY grp UNION ALL SELECT grp, 'nmf3', sum(h2) FROM h JOIN g USING (j) GROUP BY grp")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"), F.col("p_brand").alias("group"))
    return NMF(fixed_w(a.m), SCALE, h_frame(spark, a.n), a.n).summary(groups)


@query(f"WITH {A_SQL}, {W_SQL}, s0 AS (SELECT i, w0 / (SELECT sum(w0) FROM w) AS w FROM w), " + ", ".join(f"h{t} AS (SELECT j, sum(v * w) / (SELECT sum(w * w) FROM s{t}) AS h FROM a JOIN s{t} USING (i) GROUP BY j), n{t} AS (SELECT j, h / (SELECT sum(h) FROM h{t}) AS h FROM h{t}), u{t} AS (SELECT i, sum(v * h) / (SELECT sum(h * h) FROM n{t}) AS w FROM a JOIN n{t} USING (j) GROUP BY i), s{t + 1} AS (SELECT i, w / (SELECT sum(w) FROM u{t}) AS w FROM u{t})" for t in range(3)) + " SELECT i, round(w * 1000, 6) AS w, round((SELECT sum(w) FROM u2), 3) AS d FROM s3")
def nmf_rank1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three iterations of rank one from a fixed start, which SQL can unroll."""
    a = supply(spark, sf_dir)
    w = fixed_w(a.m, 1)
    f = Fit(a, Config(k=1, maxit=3, init=w / w.sum(), tol=0.0)).run()
    rows = [(int(i), float(x) * 1000, float(f.d[0])) for i, x in enumerate(f.w[:, 0]) if x > 0]
    return spark.createDataFrame(rows, "i long, w double, d double").select("i", r("w").alias("w"), r("d", 3).alias("d"))


def _checks(spark: SparkSession, rows: list[tuple[str, bool]]) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in rows], "check string, holds boolean")


def _two(spark: SparkSession, a: MatrixFrame, **kw) -> DataFrame:
    """Three iterations of rank two from the fixed factor, by closed systems: (i, w0, w1, d0, d1)."""
    f = nmf(a, 2, maxit=3, tol=0.0, init=fixed_w(a.m, 2), solver="cholesky", sort_model=False, **kw)
    out = f.w_frame().select("i", r(F.col("w")[0] * 1000, 5).alias("w0"), r(F.col("w")[1] * 1000, 5).alias("w1"))
    return out.withColumns({f"d{q}": r(F.lit(float(f.d[q])), 2) for q in (0, 1)})


_TWO = "SELECT i, round(w0 * 1000, 5) AS w0, round(w1 * 1000, 5) AS w1, round(d0, 2) AS d0, round(d1, 2) AS d1 FROM done"
_MSE = f"WITH {A_SQL}, {W_SQL}, {U.rank_two(3)} {_TWO}"
_PENALTIES = f"WITH {A_SQL}, {W_SQL}, {U.rank_two(3, 0.001, 0.1, 0.02, 0.01)} {_TWO}"
_MASKED = f"WITH {A_SQL.replace('a AS (SELECT', 'all_ AS (SELECT', 1).replace('FROM a)', 'FROM all_)')}, a AS (SELECT * FROM all_ WHERE (i * 31 + j * 17) % 10 <> 0), {W_SQL}, {U.rank_two_masked(3)} {_TWO}"
_PENALTY = {"l1": (0.001, 0.001), "l2": (0.1, 0.1), "l21": (0.02, 0.02), "angular": (0.01, 0.01)}


def _mask(a: MatrixFrame) -> tuple[str, DataFrame]:
    return "zeros", a.entries.where("(i * 31 + j * 17) % 10 = 0").select("i", "j")


@query(_MSE)
def nmf_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, supply(spark, sf_dir))


@query(_MSE)
def nmf_mse_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in tasks, as for a matrix that the driver cannot hold."""
    return _two(spark, supply(spark, sf_dir), local_nnz=0)


@query(_PENALTIES)
def nmf_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, supply(spark, sf_dir), **_PENALTY)


@query(_PENALTIES)
def nmf_penalties_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, supply(spark, sf_dir), local_nnz=0, **_PENALTY)


@query(_MASKED)
def nmf_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return _two(spark, a, mask=_mask(a))


@query(_MASKED)
def nmf_masked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return _two(spark, a, mask=_mask(a), local_nnz=0)


def _one(spark: SparkSession, a: MatrixFrame, maxit: int = 2, **kw) -> DataFrame:
    """Two iterations of rank one with all reweighting rounds: (i, w, d)."""
    f = nmf(a, 1, maxit=maxit, tol=0.0, init=fixed_w(a.m, 1), still=0.0, **kw)
    return f.w_frame().select("i", r(F.col("w")[0] * 1000, 5).alias("w")).withColumn("d", r(F.lit(float(f.d[0])), 3))


_ONE = "SELECT i, round(w * 1000, 5) AS w, round(d, 3) AS d FROM done"
_KL = f"WITH {ACT_SQL}, {W_SQL}, {U.rank_one(2, '1 / greatest(mu, 1e-4)')} {_ONE}"
_NB = "least(z / (greatest(mu, 1e-10) * (z + greatest(mu, 1e-10))), 1e6)"
_ROBUST = "CASE WHEN abs(v - mu) > 1.345 THEN 1.345 / abs(v - mu) ELSE 1 END"
_GRAPH = "l AS (SELECT j AS a, j AS b, 2.0::DOUBLE AS v FROM (SELECT unnest(range(n)) AS j FROM dims) UNION ALL SELECT j, (j + 1) % n, -1.0 FROM (SELECT unnest(range(n)) AS j FROM dims), dims UNION ALL SELECT (j + 1) % n, j, -1.0 FROM (SELECT unnest(range(n)) AS j FROM dims), dims)"


@query(_KL)
def nmf_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, activity(spark, sf_dir), loss="kl")


@query(_KL)
def nmf_kl_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, activity(spark, sf_dir), loss="kl", local_nnz=0)


@query(f"WITH {ACT_SQL}, {W_SQL}, {U.rank_one(2, _NB)} {_ONE}")
def nmf_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, activity(spark, sf_dir), loss="nb", loss_args={"size": 5.0}, dispersion="none")


@query(f"WITH {ACT_SQL}, {W_SQL}, {U.rank_one(3, _NB, sizes=True)} SELECT i, round(ln(z), 5) AS log_size FROM size")
def nmf_nb_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the rows, found anew in each of three iterations."""
    a = activity(spark, sf_dir)
    f = nmf(a, 1, maxit=3, tol=0.0, init=fixed_w(a.m, 1), still=0.0, loss="nb", loss_args={"size": 5.0}, dispersion="per_row")
    return spark.createDataFrame([(i, float(np.log(x))) for i, x in enumerate(f.misc["size"])], "i long, x double").select("i", r("x", 5).alias("log_size"))


_THETA = f"WITH {ACT_SQL}, {W_SQL}, {U.rank_one(1, '1 / greatest(mu, 1e-4)')}, f AS (SELECT a.i, a.v, greatest(x.w * x.d * h / s0.d, 1e-10) AS mu FROM a JOIN w1_ x ON x.i = a.i JOIN h0_5 ON h0_5.j = a.j, s0), t AS (SELECT i, w * d AS total FROM w1_), {U.theta()} SELECT i, round(theta, 6) AS theta FROM th5"


@query(_THETA)
def nmf_gp_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activity(spark, sf_dir)
    f = nmf(a, 1, maxit=1, tol=0.0, init=fixed_w(a.m, 1), still=0.0, loss="gp", dispersion="per_row")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(f.misc["theta"])], "i long, x double").select("i", r("x").alias("theta"))


@query(_THETA)
def nmf_gp_dispersion_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activity(spark, sf_dir)
    f = nmf(a, 1, maxit=1, tol=0.0, init=fixed_w(a.m, 1), still=0.0, loss="gp", dispersion="per_row", local_nnz=0)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(f.misc["theta"])], "i long, x double").select("i", r("x").alias("theta"))


@query(f"WITH {ACT_SQL}, {W_SQL}, {U.rank_one(2, _ROBUST)} {_ONE}")
def nmf_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, activity(spark, sf_dir), robust=True)


@query(f"WITH {ACT_SQL}, {W_SQL}, {_GRAPH}, {U.rank_one(3, '1.0', rounds=0, graph=0.3)} {_ONE}")
def nmf_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of samples as the graph on H."""
    a = activity(spark, sf_dir)
    j, up = F.col("id"), (F.col("id") + 1) % a.n
    ring = spark.range(a.n)
    ring = ring.select(j.alias("a"), j.alias("b"), F.lit(2.0).alias("v")).unionByName(ring.select(j.alias("a"), up.alias("b"), F.lit(-1.0).alias("v"))).unionByName(ring.select(up.alias("a"), j.alias("b"), F.lit(-1.0).alias("v")))
    return _one(spark, a, 3, graph_h=ring, graph_h_weight=0.3)


_STARTS = ", ".join(f"x{q} AS (SELECT i, 1.0::DOUBLE + (i * 7 + {3 * q}) % 5 AS w FROM (SELECT unnest(range(m)) AS i FROM dims)), hx{q} AS (SELECT j, sum(v * w) / (SELECT sum(w * w) FROM x{q}) AS h FROM a JOIN x{q} USING (i) GROUP BY j), nx{q} AS (SELECT j, h / (SELECT sum(h) FROM hx{q}) AS h FROM hx{q}), ux{q} AS (SELECT i, sum(v * h) AS b, sum(v * h) / (SELECT sum(h * h) FROM nx{q}) AS w FROM a JOIN nx{q} USING (j) GROUP BY i)" for q in range(3))


@query(f"WITH {ACT_SQL}, {_STARTS} " + " UNION ALL ".join(f"SELECT {q} AS start, round((SELECT sum(v * v) FROM a) - 2 * sum(w * b) + sum(w * w) * (SELECT sum(h * h) FROM nx{q}), 3) AS loss FROM ux{q}" for q in range(3)))
def nmf_multi_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activity(spark, sf_dir)
    f = nmf(a, 1, maxit=1, tol=0.0, seeds=[fixed_w(a.m, 3)[:, [q]] for q in range(3)])
    return spark.createDataFrame([(k, x) for k, x, _ in f.misc["all_inits"]], "start int, x double").select("start", r("x", 3).alias("loss"))


def _history(spark: SparkSession, f: NMF) -> DataFrame:
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(f.misc["train_loss"], 1)], "iteration int, loss double")


@query()
def nmf_rank8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty iterations of rank eight: the loss of each."""
    return _history(spark, nmf(supply(spark, sf_dir), 8, maxit=20, tol=0.0))


@query()
def nmf_rank8_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, nmf(supply(spark, sf_dir), 8, maxit=20, tol=0.0, local_nnz=0))


@query()
def nmf_kl_rank2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, nmf(activity(spark, sf_dir), 2, maxit=15, loss="kl"))


@query()
def nmf_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nmf(supply(spark, sf_dir), [2, 4], maxit=8, mask="zeros", cv_seeds=[1, 2])


@query()
def nmf_auto_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(auto_rank(activity(spark, sf_dir), Config(maxit=8))[1])


@query()
def nmf_zero_inflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = nmf(activity(spark, sf_dir), 2, maxit=5, loss="nb", zi="row")
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(f.misc["pi_row"])], "i int, pi double")


@query()
def auto_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(D.auto_distribution(activity(spark, sf_dir), 2, maxit=8)[1])


@query()
def speckled_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supply(spark, sf_dir).entries.select("i", "j")

    def run(it):
        for p in it:
            yield pd.DataFrame({"j": p["j"], "t": held_out(1, p["i"].to_numpy(), p["j"].to_numpy(), 0.1).astype(int)})

    return e.mapInPandas(run, "j long, t long").groupBy("j").agg(F.sum("t").alias("test"), F.count("*").alias("n"))


_TOP = f"WITH {A_SQL}, {U.power(12)} SELECT i, round(u, 5) AS u, round(d, 2) AS d FROM u, top"


def _top(spark: SparkSession, sf_dir: str, method: str, **kw) -> DataFrame:
    """The first left vector and singular value of five; all entries of the vector have one sign."""
    a = supply(spark, sf_dir)
    s = svd(a, 5, method=method, **kw)
    if not np.allclose(s.u.T @ s.u, np.eye(5), atol=1e-6) or (np.diff(s.d) > 1e-9).any():
        raise ValueError("the factors are not orthonormal and sorted")
    rows = [(i, float(abs(x)), float(s.d[0])) for i, x in enumerate(s.u[:, 0]) if abs(x) > 1e-12]
    return spark.createDataFrame(rows, "i long, u double, d double").select("i", r("u", 5).alias("u"), r("d", 2).alias("d"))


@query(_TOP)
def svd_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "lanczos")


@query(_TOP)
def svd_lanczos_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "lanczos", local_nnz=0)


@query(_TOP)
def svd_randomized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "randomized", power=7)


@query(_TOP)
def svd_randomized_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "randomized", power=7, local_nnz=0)


@query(_TOP)
def svd_irlba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "irlba")


@query(_TOP)
def svd_krylov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "krylov")


_METHODS = ("lanczos", "irlba", "randomized", "krylov")


@query(f"WITH {ACT_SQL}, c AS (SELECT x.i AS p, y.i AS q, sum(x.v * y.v) AS c FROM a x JOIN a y USING (j) GROUP BY 1, 2), s AS (SELECT p, q, sum(x.c * y.c) AS c FROM (SELECT p, q AS o, c FROM c) x JOIN (SELECT p AS o, q, c FROM c) y USING (o) GROUP BY p, q) SELECT m.method, round(ln((SELECT sum(c) FROM c WHERE p = q)), 6) AS p1, round(ln((SELECT sum(c * c) FROM c)), 6) AS p2, round(ln((SELECT sum(s.c * c.c) FROM s JOIN c USING (p, q))), 6) AS p3 FROM (VALUES " + ", ".join(f"('{x}')" for x in _METHODS) + ") m(method)")
def svd_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All singular values by each method, as power sums of the squares, which SQL has as traces."""
    a = activity(spark, sf_dir)
    rows = []
    for x in _METHODS:
        d = svd(a, min(a.m, a.n), method=x).d
        rows.append((x, *(float(np.log((d ** (2 * p)).sum())) for p in (1, 2, 3))))
    return spark.createDataFrame(rows, "method string, p1 double, p2 double, p3 double").select("method", *[r(c).alias(c) for c in ("p1", "p2", "p3")])


@query(f"WITH {VEC_SQL}, d AS (SELECT id, unnest(x) AS v, unnest(range(len(x))) AS i FROM e), m AS (SELECT i, avg(v) AS mean FROM d GROUP BY i), z AS (SELECT id, i, v - mean AS v FROM d JOIN m USING (i)), c AS (SELECT x.i AS p, y.i AS q, sum(x.v * y.v) AS c FROM z x JOIN z y USING (id) GROUP BY 1, 2) SELECT round(ln((SELECT sum(c) FROM c WHERE p = q)), 6) AS p1, round(ln((SELECT sum(c * c) FROM c)), 6) AS p2")
def pca_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the embeddings, as power sums of their variances."""
    a = MatrixFrame.from_vectors(vectors(spark, sf_dir).select("id", "x"), "id", "x")
    d = pca(a, min(a.m, a.n)).d
    return spark.createDataFrame([tuple(float(np.log((d ** (2 * p)).sum())) for p in (1, 2))], "p1 double, p2 double").select(r("p1").alias("p1"), r("p2").alias("p2"))


@query(f"WITH {A_SQL}, {U.power(12)} SELECT round(d * d / (SELECT sum(v * v) FROM a), 6) AS share FROM top")
def variance_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = svd(supply(spark, sf_dir), 2)
    return spark.createDataFrame([(float(s.variance_explained()[0]),)], "share double").select(r("share").alias("share"))


@query(f"WITH {A_SQL}, {U.power(12)} SELECT i, round(u, 5) AS score FROM u")
def predict_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the matrix itself as new observations: their scores are the left vector."""
    a = supply(spark, sf_dir)
    return svd(a, 2).predict(a.entries).select("i", r(F.abs(F.col("score")[0]), 5).alias("score"))


@query(f"WITH {VEC_SQL}, d AS (SELECT id, unnest(x) AS v, unnest(range(len(x))) AS i FROM e), m AS (SELECT i, avg(v) AS mean FROM d GROUP BY i) SELECT round(sum(power(v - mean, 2)), 5) AS frobenius_sq FROM d JOIN m USING (i)")
def centered_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir).select("id", "x")
    s = pca(MatrixFrame.from_vectors(e, "id", "x"), 2)
    return spark.createDataFrame([(s.misc["frobenius_sq"],)], "frobenius_sq double").select(r("frobenius_sq", 5).alias("frobenius_sq"))


@query()
def svd_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = svd(activity(spark, sf_dir), 2, robust=True)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s.d)], "factor int, d double")


@query()
def svd_auto_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = svd(activity(spark, sf_dir), "auto")
    return spark.createDataFrame([(s.k, float(s.d[0]))], "k int, d1 double")


# ---------------------------------------------------------------- clustering


@query(f"WITH {A_SQL}, {W_SQL}, {U.split(4)} SELECT j, cluster FROM sides")
def bipartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides after four closed steps from the fixed factor."""
    a = supply(spark, sf_dir)
    return C.bipartition_sides(a, init=fixed_w(a.m, 2), maxit=4, tol=-1.0)[0].select("j", "cluster")


@query()
def dclust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dclust(supply(spark, sf_dir), min_samples=200).select("id", "size", F.size("samples").alias("n"))


@query()
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.consensus_nmf(activity(spark, sf_dir), 2, reps=5, maxit=10)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(c.clusters)], "i int, cluster int")


@query("WITH c AS (SELECT unnest(range(1, 6)) AS rep, s_suppkey AS i, s_nationkey AS k FROM supplier), d AS (SELECT rep, i, (k * rep) % 4 AS c FROM c) SELECT x.i, y.i AS i2, count(*) / 5.0::DOUBLE AS share FROM d x JOIN d y ON x.rep = y.rep AND x.c = y.c AND x.i <= y.i GROUP BY x.i, y.i")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that five groupings of the nations put together."""
    reps = spark.range(1, 6).select(F.col("id").alias("rep"))
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), "s_nationkey").crossJoin(F.broadcast(reps))
    return C.connectivity(a.select("rep", "i", (F.col("s_nationkey") * F.col("rep") % 4).alias("cluster")), 5)


# ---------------------------------------------------------------- assessment

_PRED = "p AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST((label * 3 + vec_id % 4) % 7 AS VARCHAR) AS pred FROM embeddings)"


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.col("label").cast("string").alias("label"), ((F.col("label") * 3 + F.col("id") % 4) % 7).cast("string").alias("pred"))


@query(f"WITH {_PRED} SELECT label, pred, count(*) AS n FROM p GROUP BY label, pred")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.contingency(_pred(spark, sf_dir))


@query(f"WITH {_PRED}, t AS (SELECT label, pred, count(*) AS n FROM p GROUP BY label, pred), s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM t), x AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY label)), y AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY pred)) SELECT round((s.s - x.s * y.s / (n * (n - 1) / 2.0)) / ((x.s + y.s) / 2.0 - x.s * y.s / (n * (n - 1) / 2.0)), 6) AS ari FROM s, x, y")
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ari(_pred(spark, sf_dir)).select(r("ari").alias("ari"))


@query(f"WITH {_PRED}, t AS (SELECT label, pred, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY label, pred), a AS (SELECT label, sum(n) AS na FROM t GROUP BY label), b AS (SELECT pred, sum(n) AS nb FROM t GROUP BY pred), c AS (SELECT sum(n) AS c FROM t) SELECT round((SELECT sum(n / c * ln(n * c / (na * nb))) FROM t JOIN a USING (label) JOIN b USING (pred), c) / sqrt((SELECT -sum(na / c * ln(na / c)) FROM a, c) * (SELECT -sum(nb / c * ln(nb / c)) FROM b, c)), 6) AS nmi")
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nmi(_pred(spark, sf_dir)).select(r("nmi").alias("nmi"))


@query(f"WITH {_PRED}, s AS (SELECT label, count(*) AS support, count(*) FILTER (label = pred) AS hit FROM p GROUP BY label), q AS (SELECT pred AS label, count(*) AS said FROM p GROUP BY pred), m AS (SELECT label, support, CASE WHEN coalesce(said, 0) > 0 THEN hit / CAST(said AS DOUBLE) ELSE 0 END AS pr, hit / CAST(support AS DOUBLE) AS rc FROM s LEFT JOIN q USING (label)) SELECT label, support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM m")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.class_metrics(_pred(spark, sf_dir)).select("label", "support", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH s AS (SELECT vec_id % 17 AS s, label = 3 OR vec_id % 5 = 0 AS p FROM embeddings), k AS (SELECT a.p, (SELECT count(*) FROM s b WHERE NOT b.p AND b.s < a.s) + (SELECT count(*) FROM s b WHERE NOT b.p AND b.s = a.s) / 2.0 AS u FROM s a WHERE a.p) SELECT round((SELECT sum(u) FROM k) / ((SELECT count(*) FROM s WHERE p) * (SELECT count(*) FROM s WHERE NOT p)), 6) AS auc")
def auc_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir).select("id", (F.col("id") % 17).alias("score"), ((F.col("label") == 3) | (F.col("id") % 5 == 0)).alias("positive"))
    return A.auc(e).select(r("auc").alias("auc"))


@query(f"WITH {VEC_SQL}, d AS (SELECT a.id, b.id AS other, list_distance(a.x, b.x) AS dist FROM e a JOIN e b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM d) SELECT id, other, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir).select("id", "x")
    return knn(e, e, 5).select("id", "other", r("dist").alias("dist"), "rank")


@query(f"WITH {VEC_SQL}, d AS (SELECT a.id, b.id AS other, 1 - list_cosine_similarity(a.x, b.x) AS dist FROM e a JOIN e b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM d) SELECT id, other, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir).select("id", "x")
    return knn(e, e, 3, "cosine").select("id", "other", r("dist").alias("dist"), "rank")


@query(f"WITH {VEC_SQL}, tr AS (SELECT * FROM e WHERE id % 5 <> 0), te AS (SELECT * FROM e WHERE id % 5 = 0), k AS (SELECT te.id, te.label, tr.label AS g, row_number() OVER (PARTITION BY te.id ORDER BY list_distance(te.x, tr.x), tr.id) AS rk FROM te, tr), v AS (SELECT id, label, g, count(*) AS n FROM k WHERE rk <= 5 GROUP BY id, label, g), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, g) AS q FROM v) SELECT id, label, g AS pred FROM b WHERE q = 1")
def classify_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return A.classify_knn(v.select("id", "x"), v.select("id", "label"), v.where("id % 5 = 0"), k=5)


@query(f"WITH {VEC_SQL}, d AS (SELECT a.id, a.label, b.label AS g, avg(list_distance(a.x, b.x)) AS m FROM e a, e b GROUP BY a.id, a.label, b.label), o AS (SELECT id, m AS a FROM d WHERE label = g), n AS (SELECT id, label, min(m) AS b FROM d WHERE label <> g GROUP BY id, label) SELECT id, CAST(label AS VARCHAR) AS label, round((b - a) / greatest(a, b), 6) AS s FROM o JOIN n USING (id)")
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return A.silhouette(v.select("id", "x"), v.select("id", "label"), per_class=None).select("id", "label", r("s").alias("s"))


@query(f"WITH {VEC_SQL}, u AS (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS r FROM e), c AS (SELECT label, r, avg(v) AS c FROM u GROUP BY label, r), m AS (SELECT r, avg(c) AS m FROM c GROUP BY r), t AS (SELECT label, r, c - m AS t FROM c JOIN m USING (r)) SELECT e.id AS j, round(sum(t * t), 6) AS length FROM e JOIN t USING (label) GROUP BY e.id")
def label_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    t = guide.target(v.select(F.col("id").alias("j"), F.col("x").alias("h")), v.select(F.col("id").alias("j"), "label"), 64)
    return t.select("j", r(F.aggregate("t", F.lit(0.0), lambda s, x: s + x * x)).alias("length"))


@query(f"WITH {VEC_SQL}, d AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rk FROM e a JOIN e b ON a.id <> b.id), c AS (SELECT id, other % 3 AS batch, count(*) AS c FROM d WHERE rk <= 15 GROUP BY 1, 2) SELECT id, round(-sum(c / 15.0 * ln(c / 15.0)) / ln(3), 6) AS entropy FROM c GROUP BY id")
def batch_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    m = A.batch_mixing(v.select("id", "x"), v.select("id", (F.col("id") % 3).cast("string").alias("batch")), 15)
    return m.select("id", r(F.col("entropy") + 0.0).alias("entropy"))


@query()
def classify_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    lab = v.select("id", F.col("label").cast("string").alias("label"))
    return A.overall(A.classify_logistic(v.select("id", "x"), lab, v.where("id % 5 = 0"), max_iter=20))


@query()
def classify_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    lab = v.select("id", F.col("label").cast("string").alias("label"))
    return A.overall(A.classify_forest(v.select("id", "x"), lab, v.where("id % 5 = 0"), trees=20))


@query()
def assess_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return spark.createDataFrame(A.assess(v.select("id", "x"), v.select("id", F.col("label").cast("string").alias("label")), metrics=("ari", "nmi", "silhouette", "knn"), n_folds=3, starts=1))


@query(f"WITH {_PRED}, s AS (SELECT label, count(*) AS support, count(*) FILTER (label = pred) AS hit FROM p GROUP BY label), q AS (SELECT pred AS label, count(*) AS said FROM p GROUP BY pred), m AS (SELECT label, support, CASE WHEN coalesce(said, 0) > 0 THEN hit / CAST(said AS DOUBLE) ELSE 0 END AS pr, hit / CAST(support AS DOUBLE) AS rc FROM s LEFT JOIN q USING (label)), f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m) SELECT round(avg(pr), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round((SELECT avg(CAST(label = pred AS INT)) FROM p), 6) AS accuracy FROM f")
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.overall(_pred(spark, sf_dir))
    return o.select(*[r(c).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "weighted_f1", "accuracy")])


@query(f"WITH {VEC_SQL}, u AS (SELECT id, unnest(x) AS v, unnest(range(len(x))) AS r FROM e), t AS (SELECT r, avg(v) AS m, stddev_samp(v) AS s FROM u WHERE id % 5 <> 0 GROUP BY r) SELECT id, round(sum(power((v - m) / s, 2)), 5) AS length FROM u JOIN t USING (r) GROUP BY id")
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "x")
    return A.scaled(v, v.where("id % 5 <> 0")).select("id", r(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x), 5).alias("length"))


# ---------------------------------------------------------------- models of fixed factors, projections


def _model(spark: SparkSession, a: MatrixFrame) -> NMF:
    return NMF(fixed_w(a.m), SCALE, h_frame(spark, a.n), a.n)


@query(SQL["nnls_project"])
def predict_nmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    h = NMF(fixed_w(a.m, 2), np.ones(2), h_frame(spark, a.n, 2), a.n).predict(a).join(a.entries.select("j").distinct(), "j")
    return h.select("j", r(F.col("h")[0], 5).alias("h0"), r(F.col("h")[1], 5).alias("h1"))


@query(f"WITH {A_SQL}, {W_SQL}, {H_SQL}, {FIT_SQL} SELECT (SELECT round(sum(power(coalesce(v, 0) - (0.1 * w0 * h0 + 0.2 * w1 * h1 + 0.3 * w2 * h2), 2)) / max(m * n), 5) FROM w CROSS JOIN h CROSS JOIN dims LEFT JOIN a ON a.i = w.i AND a.j = h.j) AS mse, (SELECT round(avg(v * ln(v / mu) - v + mu), 5) FROM fit) AS kl")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    m = _model(spark, a)
    x = spark.createDataFrame([(m.evaluate(a), m.evaluate(a, "kl", domain="stored"))], "mse double, kl double")
    return x.select(r("mse", 5).alias("mse"), r("kl", 5).alias("kl"))


@query(f"WITH {ACT_SQL}, {W_SQL}, {H_SQL} SELECT w.i, h.j, round(0.1 * w0 * h0 + 0.2 * w1 * h1 + 0.3 * w2 * h2, 6) AS v FROM w CROSS JOIN h")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, activity(spark, sf_dir)).reconstruct().select("i", "j", r("v").alias("v"))


@query(f"WITH {A_SQL}, {W_SQL} SELECT i, w0, w1, w2 FROM w")
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors in another order, brought back by the best matching."""
    m = _model(spark, supply(spark, sf_dir))
    return m.factors([2, 0, 1]).align(m).w_frame().select("i", *[F.col("w")[q].alias(f"w{q}") for q in range(3)])


@query(f"WITH {A_SQL}, {H_SQL} SELECT j, CASE WHEN h0 >= h1 AND h0 >= h2 THEN 0 WHEN h1 >= h2 THEN 1 ELSE 2 END AS factor FROM h")
def largest_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = h_frame(spark, supply(spark, sf_dir).n)
    return h.select("j", (F.array_position("h", F.array_max("h")) - 1).cast("int").alias("factor"))


@query(f"WITH {A_SQL}, {W_SQL}, g AS (SELECT sum(w0 * w0) AS g FROM w) SELECT j, round(least(greatest(sum(v * w0) / max(g), 0), 1.5), 6) AS h FROM a JOIN w USING (i), g GROUP BY j")
def nnls_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return project(a, fixed_w(a.m, 1), upper=1.5).join(a.entries.select("j").distinct(), "j").select("j", r(F.col("h")[0]).alias("h"))


@query(f"WITH {A_SQL}, {H_SQL} SELECT i, round(sum(v * h0) / (SELECT sum(h0 * h0) FROM h), 6) AS w FROM a JOIN h USING (j) GROUP BY i")
def nnls_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    w = nnls_fit(a, h=fixed_h(a.n, 1)).join(a.entries.select("i").distinct(), "i")
    return w.select("i", r(F.col("h")[0]).alias("w"))


@query(f"WITH {VEC_SQL}, u AS (SELECT id, unnest(x) AS v, unnest(range(len(x))) AS i FROM e), w AS (SELECT i, 1.0::DOUBLE + (i * 7) % 5 AS w FROM (SELECT DISTINCT i FROM u)) SELECT row_number() OVER (ORDER BY id) - 1 AS j, round(sum(v * w) / (SELECT sum(w * w) FROM w), 6) AS h FROM u JOIN w USING (i) GROUP BY id")
def semi_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed data without the sign constraint."""
    a = MatrixFrame.from_vectors(vectors(spark, sf_dir).select("id", "x"), "id", "x")
    return project(a, fixed_w(a.m, 1), nonneg=False).select("j", r(F.col("h")[0]).alias("h"))


@query(f"WITH {A_SQL}, {W_SQL}, g AS (SELECT sum(w0 * w0) AS g00, sum(w0 * w1) AS g01, sum(w1 * w1) AS g11 FROM w), b AS (SELECT j, sum(v * w0) AS b0, sum(v * w1) AS b1 FROM a JOIN w USING (i) GROUP BY j) SELECT j, round(greatest((b0 * g11 - b1 * g01) / (g00 * g11 - g01 * g01), 0), 5) AS h0, round(greatest((b1 * g00 - b0 * g01) / (g00 * g11 - g01 * g01), 0), 5) AS h1 FROM b, g")
def cholesky_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    h = project(a, fixed_w(a.m, 2), solver="cholesky", local_nnz=0).join(a.entries.select("j").distinct(), "j")
    return h.select("j", r(F.col("h")[0], 5).alias("h0"), r(F.col("h")[1], 5).alias("h1"))


@query(f"WITH {A_SQL}, {W_SQL}, b AS (SELECT i, j, v, w0 FROM a JOIN w USING (i) WHERE i % 2 = 0) SELECT j, round(sum(v * w0) / (SELECT sum(w0 * w0) FROM w WHERE i % 2 = 0 AND i IN (SELECT i FROM a)), 6) AS h FROM b GROUP BY j")
def project_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are matched by name; the factor has every second one only."""
    a = supply(spark, sf_dir)
    names = a.entries.select("i").distinct().select("i", F.concat(F.lit("s"), F.col("i")).alias("name"))
    a = MatrixFrame(a.entries, a.m, a.n, row_names=names)
    w = w_frame(spark, a.m, 1).where("i % 2 = 0").select(F.concat(F.lit("s"), F.col("i")).alias("name"), "w")
    h = project_named(a, w, 1).join(a.entries.where("i % 2 = 0").select("j").distinct(), "j")
    return h.select("j", r(F.col("h")[0]).alias("h"))


@query(f"WITH {A_SQL}, {H_SQL}, s AS (SELECT sum(h0) AS d, sum(h0 * h0) AS g FROM h), w AS (SELECT i, sum(v * h0) / (SELECT g FROM s) AS w FROM a JOIN h USING (j) GROUP BY i), n0 AS (SELECT i, w / (SELECT sum(w) FROM w) AS w FROM w), y AS (SELECT j, sum(v * w) / (SELECT sum(w * w) FROM n0) AS h FROM a JOIN n0 USING (i) GROUP BY j), z AS (SELECT j, h / (SELECT sum(h) FROM y) AS h FROM y), u AS (SELECT i, sum(v * h) / (SELECT sum(h * h) FROM z) AS w FROM a JOIN z USING (j) GROUP BY i) SELECT i, round(1000 * w / (SELECT sum(w) FROM u), 5) AS w, round((SELECT sum(w) FROM u), 2) AS d FROM u")
def nmf_from_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One iteration from a given H, which is turned to fit."""
    a = supply(spark, sf_dir)
    f = nmf(a, 1, maxit=1, tol=0.0, h_init=fixed_h(a.n, 1).T)
    rows = [(int(i), float(x) * 1000, float(f.d[0])) for i, x in enumerate(f.w[:, 0]) if x > 0]
    return spark.createDataFrame(rows, "i long, w double, d double").select("i", r("w", 5).alias("w"), r("d", 2).alias("d"))


_SYM = ", ".join(f"b{t} AS (SELECT x.i, sum(x.c * s{t}.w) / (SELECT sum(w * w) FROM s{t}) AS w FROM c x JOIN s{t} ON s{t}.i = x.j GROUP BY x.i), s{t + 1} AS (SELECT i, w / (SELECT sum(w) FROM b{t}) AS w FROM b{t})" for t in range(3))


@query(f"WITH {ACT_SQL}, {W_SQL}, c AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS c FROM a x JOIN a y USING (j) GROUP BY 1, 2), t AS (SELECT sum(w0) AS s FROM w), s0 AS (SELECT i, w0 / s AS w FROM w, t), {_SYM} SELECT i, round(1000 * w, 5) AS w FROM s3")
def nmf_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps on the products of the event types with each other."""
    a = activity(spark, sf_dir)
    e = a.entries
    c = e.join(e.select("j", F.col("i").alias("i2"), F.col("v").alias("v2")), "j").groupBy("i", F.col("i2").alias("j")).agg(F.sum(F.col("v") * F.col("v2")).alias("v"))
    w = fixed_w(a.m, 1)
    f = nmf(MatrixFrame(c, a.m, a.m), 1, maxit=3, tol=0.0, symmetric=True, init=w / w.sum())
    return f.w_frame().select("i", r(F.col("w")[0] * 1000, 5).alias("w"))


# ---------------------------------------------------------------- more of the stores


@query(f"WITH {A_SQL} SELECT j AS i, i AS j, v FROM a")
def store_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store.write(supply(spark, sf_dir), path, chunk_cols=64)
    store.add_transpose(spark, path)
    return store.read_transpose(spark, path).entries


@query(f"WITH {A_SQL}, p(i, k) AS (VALUES (5, 0), (3, 1), (8, 2)) SELECT CAST(k AS BIGINT) AS i, j, v FROM a JOIN p USING (i)")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store.write(supply(spark, sf_dir), path, include_transpose=True)
    return store.slice_rows(spark, path, [5, 3, 8]).entries


@query(f"WITH {A_SQL} SELECT m AS \"rows\", n AS cols, (SELECT count(*) FROM a) AS nnz, 8 * (SELECT count(*) FROM a) + 4 * (n + 1) AS raw_bytes, round(100.0 * (SELECT count(*) FROM a) / (m * n), 6) AS density_pct FROM dims")
def store_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = store.write(supply(spark, sf_dir), _folder(spark))
    x = spark.createDataFrame([(i["rows"], i["cols"], i["nnz"], i["raw_bytes"], i["density_pct"])], "rows long, cols long, nnz long, raw_bytes long, density_pct double")
    return x.withColumn("density_pct", r("density_pct"))


@query("SELECT s_suppkey AS i, n_name, r_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def store_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store.write(with_regions(spark, sf_dir), path)
    return store.read_obs(spark, path)


@query("SELECT p_partkey AS j, p_brand, p_size FROM part")
def store_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store.write(with_regions(spark, sf_dir), path)
    return store.read_var(spark, path)


@query(f"WITH {VEC_SQL} SELECT id AS j, round(list_sum(x), 5) AS total, CAST(len(x) AS INT) AS n FROM e")
def store_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store.write_dense(vectors(spark, sf_dir), path, "id", "x")
    return store.read_dense(spark, path).select("j", r(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("x").alias("n"))


@query(f"WITH {A_SQL} SELECT i, j, v FROM a UNION ALL SELECT i, j + n, v FROM a, dims")
def store_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    a = supply(spark, sf_dir)
    store.write_list([a, a], path)
    return store.read(spark, path).entries


@query(f"WITH {A_SQL} SELECT i, j, v FROM a UNION ALL SELECT i + m, j, 2 * v FROM a, dims")
def rbind(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    return MatrixFrame.rbind([a, MatrixFrame(a.entries.select("i", "j", (F.col("v") * 2).alias("v")), a.m, a.n)]).entries


@query(f"WITH {A_SQL} SELECT i, j, v FROM a")
def matrix_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a coordinate file, read by the dispatcher and stored."""
    a, path = supply(spark, sf_dir), _folder(spark)
    lines = a.entries.select(F.lit(2).alias("at"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "v").alias("value"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{a.m} {a.n} {a.entries.count()}")], "at int, value string")
    head.unionByName(lines).repartition(1).sortWithinPartitions("at").select("value").write.text(f"{path}/a.mtx")
    store.convert(spark, f"{path}/a.mtx", f"{path}/store")
    return store.read(spark, f"{path}/store").entries


# ---------------------------------------------------------------- graphs, guides, simulation, streams


@query()
def graph_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.factor_input(supply(spark, sf_dir), "supply")
    first = G.nmf_layer(x, 6, G.W(l1=0.01), name="first")
    net = G.factor_net(x, G.nmf_layer(first, 3, name="second"), G.GraphConfig(outer=2, init_iterations=5))
    return spark.createDataFrame(G.fit(net).summary())


@query()
def graph_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    e = table(spark, sf_dir, "lineitem").groupBy(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("i"), F.col("l_partkey").alias("j")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    out = nmf({"supply": a, "revenue": MatrixFrame.from_long(e, m=2, n=a.n)}, 4, maxit=8)
    return spark.createDataFrame([(k, int(w.shape[0])) for k, w in out.modalities["L1"].items()], "modality string, n_rows int")


@query()
def refine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activity(spark, sf_dir)
    f = nmf(a, 2, maxit=10)
    labels = spark.range(a.n).select(F.col("id").alias("j"), F.when(F.col("id") % 7 != 0, (F.col("id") % 2).cast("string")).alias("label"))
    out = guide.refine(f, a, labels)
    return out.h.select("j", r(F.col("h")[0]).alias("h0"), r(F.col("h")[1]).alias("h1"))


@query()
def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, w, _ = simulate.simulate_nmf(spark, 30, 40, 3, noise=0.0, dropout=0.0)
    f = nmf(a, 3, maxit=200, tol=1e-9)
    return _checks(spark, [("recovered", f.misc["loss"] < 1e-3 * linalg.sum_of_squares(a)), ("columns sum to one", np.allclose(w.sum(axis=0), 1))])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming over the events, one available batch, complete mode."""
    path = _folder(spark)
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file or a folder
    counts = projection.windowed_counts(s)

    def keep(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total", 4).alias("total"))


@query(f"WITH {ACT_SQL}, w AS (SELECT i, 1.0::DOUBLE + (i * 7) % 5 AS w0 FROM (SELECT unnest(range(m)) AS i FROM dims)), g AS (SELECT sum(w0 * w0) AS g FROM w) SELECT j, round(sum(v * w0) / max(g), 6) AS h0 FROM a JOIN w USING (i), g GROUP BY j")
def stream_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New samples projected on a fixed factor as they arrive."""
    path = _folder(spark)
    a = activity(spark, sf_dir)
    a.entries.write.parquet(f"{path}/in")
    s = spark.readStream.schema("i long, j long, v double").parquet(f"{path}/in")
    projection.project_stream(s, fixed_w(a.m, 1), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("j", r(F.col("h")[0]).alias("h0"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-four factors of supply: (j, h)."""
    return nmf(supply(spark, sf_dir), 4, maxit=20).h.orderBy("j")
