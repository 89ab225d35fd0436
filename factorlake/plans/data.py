"""The driver's tables as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.matrix import MatrixFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply(spark: SparkSession, sf_dir: str) -> MatrixFrame:
    """Suppliers x parts, total quantity."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return MatrixFrame.from_long(e)


def with_regions(spark: SparkSession, sf_dir: str) -> MatrixFrame:
    """supply with the suppliers' nation and region as row metadata, and the parts' as column metadata."""
    a = supply(spark, sf_dir)
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    obs = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("i"), "n_name", "r_name", "s_acctbal")
    var = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"), "p_brand", "p_size")
    return MatrixFrame(a.entries, a.m, a.n, obs, var)


def activity(spark: SparkSession, sf_dir: str) -> MatrixFrame:
    """Event types x users, counts."""
    e = table(spark, sf_dir, "events")
    types = e.select("event_type").distinct().orderBy("event_type").collect()  # a handful of types
    code = F.create_map(*[x for k, t in enumerate(types) for x in (F.lit(t[0]), F.lit(k))])
    return MatrixFrame.from_long(e.select(code[F.col("event_type")].alias("i"), F.col("user_id").alias("j"), F.lit(1.0).alias("v")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def fixed_w(m: int, k: int = 3) -> np.ndarray:
    """w[i, r] = 1 + (7 i + 3 r) mod 5, a factor that SQL can write too."""
    return 1.0 + (np.arange(m)[:, None] * 7 + np.arange(k)[None, :] * 3) % 5


def fixed_h(n: int, k: int = 3) -> np.ndarray:
    return 1.0 + (np.arange(n)[:, None] * 5 + np.arange(k)[None, :] * 2) % 7


SCALE = np.array([0.1, 0.2, 0.3])


def w_frame(spark: SparkSession, m: int, k: int = 3) -> DataFrame:
    """fixed_w as (i, w), made in tasks."""
    return spark.range(m).select(F.col("id").alias("i"), F.array(*[(1 + (F.col("id") * 7 + 3 * r) % 5).cast("double") for r in range(k)]).alias("w"))


def h_frame(spark: SparkSession, n: int, k: int = 3) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("j"), F.array(*[(1 + (F.col("id") * 5 + 2 * r) % 7).cast("double") for r in range(k)]).alias("h"))

