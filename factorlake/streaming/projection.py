"""Streams of new samples: projection on a fitted W, and online updates of W from running sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.linalg import gram, rhs_transposed
from ..operators.nmf import project
from ..operators.solve import nnls
from ..sources.matrix import MatrixFrame, numbered


def _renumbered(df: DataFrame, m: int, held: list[DataFrame]) -> tuple[MatrixFrame, DataFrame]:
    """The samples of a batch as columns 0, 1, ..., and their ids (id, j); the ids stay in the cluster."""
    local = df.select(F.col("i").cast("long"), F.col("j").cast("long").alias("id"), F.col("v").cast("double")).groupBy("i", "id").agg(F.sum("v").alias("v")).persist()
    held.append(local)
    names = numbered(local.select("id").distinct(), "id", "j", held).persist()
    held.append(names)
    return MatrixFrame(local.join(names, "id").select("i", "j", "v"), m, names.count()), names


def project_stream(stream: DataFrame, w: np.ndarray, path: str, checkpoint: str, once: bool = True, **rule) -> StreamingQuery:
    """(i, j, v) rows, whole samples in a batch -> (j, h, batch) under `path`; a repeated batch overwrites its own folder."""

    def one(df: DataFrame, batch: int) -> None:
        held: list[DataFrame] = []
        try:
            a, names = _renumbered(df, w.shape[0], held)
            if a.n:
                out = project(a, w, **rule).join(names, "j").select(F.col("id").alias("j"), "h")
                out.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        finally:
            for d in held:
                d.unpersist()

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


STATE = "kind string, i long, x array<double>, saved long, batch long, size long"


class OnlineNMF:
    """W kept current over batches of samples: only the k x k and m x k sums of what was seen are held.

    With a folder `path` these are written after each batch, to two places by turns, so that a driver that is started anew goes on
    from the last whole one; a place counts if it has all rows that it says it has."""

    def __init__(self, w: np.ndarray, forget: float = 1.0, path: str | None = None) -> None:
        self.w, self.forget, self.path = w.copy(), forget, path
        k = w.shape[1]
        self.gram, self.b, self.last, self.saved = np.zeros((k, k)), np.zeros(w.shape), -1, 0

    def update(self, a: MatrixFrame, batch: int) -> np.ndarray:
        """Batch numbers rise; one that is not above the last changes nothing."""
        if batch <= self.last:
            return self.w
        k = self.w.shape[1]
        h = project(a, self.w)
        b = rhs_transposed(a, h, k).toPandas()
        part = np.zeros(self.w.shape)
        part[b["i"].to_numpy()] = b[[f"b{r}" for r in range(k)]].to_numpy()
        self.gram = self.forget * self.gram + gram(h, k)
        self.b = self.forget * self.b + part
        self.w = nnls(self.gram + 1e-12 * np.eye(k), self.b.T).T
        self.last = batch
        if self.path is not None:
            self.save(a.entries.sparkSession)
        return self.w

    def save(self, spark: SparkSession) -> None:
        self.saved += 1
        rows = [(kind, i, x.tolist()) for kind, part in (("w", self.w), ("b", self.b), ("gram", self.gram)) for i, x in enumerate(part)]
        rows = [(*r, self.saved, self.last, len(rows)) for r in rows]
        spark.createDataFrame(rows, STATE).write.mode("overwrite").parquet(f"{self.path}/{self.saved % 2}")

    def restore(self, spark: SparkSession) -> bool:
        """Go on from the folder's last whole state; False if there is none."""
        for saved, place in sorted((x for x in (self._place(spark, n) for n in (0, 1)) if x is not None), key=lambda x: -x[0]):
            p = place.orderBy("kind", "i").toPandas()  # as large as W, which the driver holds anyway
            got = {kind: np.stack([np.asarray(v) for v in g["x"]]) for kind, g in p.groupby("kind")}
            if got["w"].shape != self.w.shape:
                raise ValueError(f"the state under {self.path} is of a W of {got['w'].shape}, not {self.w.shape}")
            self.w, self.b, self.gram = got["w"], got["b"], got["gram"]
            self.last, self.saved = int(p["batch"].iloc[0]), int(saved)
            return True
        return False

    def _place(self, spark: SparkSession, n: int) -> tuple[int, DataFrame] | None:
        try:
            df = spark.read.schema(STATE).parquet(f"{self.path}/{n}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        r = df.agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("saved").alias("saved")).first()
        return (r["saved"], df) if r["n"] and r["n"] == r["size"] else None

    def attach(self, stream: DataFrame, m: int, checkpoint: str, then: Callable[[np.ndarray, int], None] | None = None) -> StreamingQuery:
        """Update from a stream of (i, j, v), whole samples in a batch; the state is kept beside the checkpoint if no path is given."""
        if self.path is None:
            self.path = f"{checkpoint.rstrip('/')}_sums"
        if self.last < 0:
            self.restore(stream.sparkSession)

        def one(df: DataFrame, batch: int) -> None:
            held: list[DataFrame] = []
            try:
                a, _ = _renumbered(df, m, held)
                if a.n:
                    w = self.update(a, batch)
                    if then:
                        then(w, batch)
            finally:
                for d in held:
                    d.unpersist()

        return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n, total): tumbling counts with a watermark; the samples of an activity matrix as they arrive."""
    t = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key)
    return t.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
