"""MatrixFrame: a features x samples matrix as a long DataFrame (i, j, v) with its size and metadata.

Rows of the DataFrame are the stored entries; what is not stored is zero. i and j are 0-based. Slices, filters and
statistics are plain DataFrame plans; `blocks` groups the entries by sample once for the iterative operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONG = "i long, j long, v double"


@dataclass(frozen=True)
class MatrixFrame:
    entries: DataFrame
    m: int
    n: int
    obs: DataFrame | None = None  # row metadata, keyed by i
    var: DataFrame | None = None  # column metadata, keyed by j
    row_names: DataFrame | None = field(default=None)  # (i, name)
    col_names: DataFrame | None = field(default=None)  # (j, name)

    # ---- making

    @staticmethod
    def from_long(df: DataFrame, i: str = "i", j: str = "j", v: str = "v", m: int | None = None, n: int | None = None, **meta: DataFrame) -> MatrixFrame:
        """Duplicate (i, j) are summed. Sizes not given are one more than the largest index."""
        e = df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.col(v).cast("double").alias("v"))
        e = e.groupBy("i", "j").agg(F.sum("v").alias("v"))
        if m is None or n is None:
            top = e.agg(F.max("i"), F.max("j")).first()
            m = m if m is not None else (top[0] if top[0] is not None else -1) + 1
            n = n if n is not None else (top[1] if top[1] is not None else -1) + 1
        return MatrixFrame(e, m, n, **meta)

    @staticmethod
    def from_keys(df: DataFrame, row: str, col: str, v: str) -> MatrixFrame:
        """Dense ids by sorted key; the keys become row and column names."""
        rows, cols = _numbered(df, row, "i"), _numbered(df, col, "j")
        e = df.join(rows.withColumnRenamed("name", row), row).join(cols.withColumnRenamed("name", col), col)
        return MatrixFrame.from_long(e, "i", "j", v, row_names=rows, col_names=cols)

    @staticmethod
    def from_numpy(spark: SparkSession, x: np.ndarray, keep_zeros: bool = False) -> MatrixFrame:
        x = np.asarray(x, float)
        i, j = np.nonzero(np.ones_like(x, bool) if keep_zeros else (x != 0) | np.isnan(x))
        rows = list(zip(i.tolist(), j.tolist(), x[i, j].tolist()))
        return MatrixFrame(spark.createDataFrame(rows, LONG), *x.shape)

    @staticmethod
    def from_vectors(df: DataFrame, id_col: str, vector: str) -> MatrixFrame:
        """Samples with an array column: dimension is the row."""
        cols = _numbered(df, id_col, "j")
        e = df.join(cols.withColumnRenamed("name", id_col), id_col).select("j", F.posexplode(vector).alias("i", "v"))
        return MatrixFrame.from_long(e, col_names=cols)

    # ---- checking

    def validate(self) -> dict[str, int]:
        """Counts of stored, missing (null or NaN) and negative entries, in one pass."""
        bad = F.col("v").isNull() | F.isnan("v")
        r = self.entries.agg(F.count("*").alias("nnz"), F.count_if(bad).alias("missing"), F.count_if(~bad & (F.col("v") < 0)).alias("negative")).first()
        return {k: int(r[k]) for k in ("nnz", "missing", "negative")}

    def info(self) -> dict[str, float]:
        nnz = self.entries.count()
        size = max(1, self.m * self.n)
        return {"rows": self.m, "cols": self.n, "nnz": nnz, "density_pct": 100.0 * nnz / size, "raw_bytes": 8 * nnz + 4 * (self.n + 1) + 4 * nnz}

    # ---- shape

    def t(self) -> MatrixFrame:
        e = self.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        flip = lambda d, a, b: None if d is None else d.withColumnRenamed(a, b)
        return MatrixFrame(e, self.n, self.m, flip(self.var, "j", "i"), flip(self.obs, "i", "j"), flip(self.col_names, "j", "i"), flip(self.row_names, "i", "j"))

    def slice(self, rows: list[int] | None = None, cols: list[int] | None = None) -> MatrixFrame:
        """Rows and columns in the order asked for; a repeated index repeats the row or column."""
        out = self
        if rows is not None:
            out = out._pick("i", _order(self.entries.sparkSession, rows, self.m, "i"), len(rows))
        if cols is not None:
            out = out._pick("j", _order(self.entries.sparkSession, cols, self.n, "j"), len(cols))
        return out

    def _pick(self, k: str, order: DataFrame, size: int) -> MatrixFrame:
        """order: (k, new)."""
        other = "j" if k == "i" else "i"
        e = self.entries.join(F.broadcast(order) if size <= 1_000_000 else order, k).select(F.col("new").alias(k), other, "v").select("i", "j", "v")
        meta = {"i": ("obs", "row_names"), "j": ("var", "col_names")}[k]
        new = {a: getattr(self, a).join(order, k).drop(k).withColumnRenamed("new", k) for a in meta if getattr(self, a) is not None}
        return replace(self, entries=e, **{"m" if k == "i" else "n": size}, **new)

    def obs_indices(self, where: str | Column) -> DataFrame:
        """Row numbers for which the predicate on the row metadata is true (null is not)."""
        if self.obs is None:
            raise ValueError("the matrix has no row metadata")
        return self.obs.filter(where).select("i")

    def filter_rows(self, where: str | Column) -> MatrixFrame:
        return self._filtered("i", self.obs, where)

    def filter_cols(self, where: str | Column) -> MatrixFrame:
        return self._filtered("j", self.var, where)

    def _filtered(self, k: str, meta: DataFrame | None, where: str | Column) -> MatrixFrame:
        if meta is None:
            raise ValueError(f"the matrix has no {'row' if k == 'i' else 'column'} metadata")
        order = numbered(meta.filter(where).select(k), k, "new")
        size = order.count()
        if not size:
            raise ValueError("no row or column matches")
        return self._pick(k, order, size)

    @staticmethod
    def cbind(parts: list[MatrixFrame]) -> MatrixFrame:
        if len({p.m for p in parts}) != 1:
            raise ValueError("all matrices need the same number of rows")
        return _bound(parts, "j")

    @staticmethod
    def rbind(parts: list[MatrixFrame]) -> MatrixFrame:
        if len({p.n for p in parts}) != 1:
            raise ValueError("all matrices need the same number of columns")
        return _bound(parts, "i")

    def without(self, mask: DataFrame) -> MatrixFrame:
        """Entries that the mask (i, j) does not hold."""
        return replace(self, entries=self.entries.join(mask.select("i", "j"), ["i", "j"], "left_anti"))

    # ---- statistics, all over m or n, not over stored entries

    def column_stats(self) -> DataFrame:
        """(j, nnz, zeros, total, mean, sd) of every column, empty ones too."""
        return _stats(self.entries, "j", self.n, self.m)

    def row_stats(self) -> DataFrame:
        return _stats(self.entries, "i", self.m, self.n)

    def blocks(self, by: str = "j") -> DataFrame:
        """(key, idx, val): the entries of each column (or row) as sorted arrays; zeros are not kept."""
        other = "i" if by == "j" else "j"
        pairs = F.array_sort(F.collect_list(F.struct(F.col(other).cast("int").alias("idx"), "v")))
        e = self.entries.where("v <> 0 or v is null").groupBy(by).agg(pairs.alias("p"))
        return e.select(F.col(by).alias("key"), F.col("p.idx").alias("idx"), F.col("p.v").alias("val"))

    def to_numpy(self, limit: int = 50_000_000) -> np.ndarray:
        if self.m * self.n > limit:
            raise ValueError(f"{self.m} x {self.n} is too large to collect")
        out = np.zeros((self.m, self.n))
        e = self.entries.toPandas()
        out[e["i"], e["j"]] = e["v"]
        return out


def numbered(df: DataFrame, key: str, name: str, held: list[DataFrame] | None = None) -> DataFrame:
    """(key, name): 0-based positions by sorted key, by range partitions, so that no task sorts everything.

    What it keeps in the cache goes to `held`, for callers that give it back."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(key).repartitionByRange(n, key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    d = d.persist()
    if held is not None:
        held.append(d)
    base = d.groupBy("__p").agg(F.count("*").alias("__c"))  # a row a partition
    base = base.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))
    return d.join(F.broadcast(base), "__p").select(key, (F.col("__b") + F.col("__k")).alias(name))


def _numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    return numbered(df.select(F.col(key).alias("name")).where("name is not null").distinct(), "name", name)


def _order(spark: SparkSession, picked: list[int], size: int, k: str) -> DataFrame:
    if any(not 0 <= x < size for x in picked):
        raise IndexError(f"index outside 0..{size - 1}")
    return spark.createDataFrame(list(zip(map(int, picked), range(len(picked)))), f"{k} long, new long")


def _bound(parts: list[MatrixFrame], k: str) -> MatrixFrame:
    at, out = 0, None
    for p in parts:
        e = p.entries.withColumn(k, F.col(k) + F.lit(at)).select("i", "j", "v")
        out = e if out is None else out.unionByName(e)
        at += p.n if k == "j" else p.m
    return MatrixFrame(out, parts[0].m if k == "j" else at, at if k == "j" else parts[0].n)


def _stats(e: DataFrame, k: str, size: int, of: int) -> DataFrame:
    s = e.groupBy(k).agg(F.count_if(F.col("v") != 0).alias("nnz"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("sq"))
    s = e.sparkSession.range(size).withColumnRenamed("id", k).join(s, k, "left").fillna(0, ["nnz"]).fillna(0.0, ["total", "sq"])
    mean = F.col("total") / of
    return s.select(k, "nnz", (F.lit(of) - F.col("nnz")).alias("zeros"), "total", mean.alias("mean"), F.sqrt(F.greatest(F.col("sq") / of - mean * mean, F.lit(0.0))).alias("sd"))
