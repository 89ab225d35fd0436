"""Embedding assessment: agreement of labels and clusters, silhouette, classifiers, batch mixing; metrics as plans."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import NMF, SVD
from .neighbours import REF_VALUES, TILE, dealt, distances, knn, matrix, pairs, products, query_blocks, squares, too_large
from .passes import listed

MIN_CLASS = 10
NEAR_SHARE = 1e-4  # of the squared lengths: closer pairs are not left to the product


def embedding(model: NMF | SVD) -> DataFrame:
    """(id, x): scaled sample coordinates."""
    if isinstance(model, NMF):
        return model.h.select(F.col("j").alias("id"), F.array(*[F.col("h")[r] * float(model.d[r]) for r in range(model.k)]).alias("x"))
    return model.v.select(F.col("j").alias("id"), F.array(*[F.col("v")[r] * float(model.d[r]) for r in range(model.k)]).alias("x"))


# ---------------------------------------------------------------- label agreement


def contingency(pairs: DataFrame, a: str = "label", b: str = "pred") -> DataFrame:
    """(a, b, n) over rows where neither is null."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def ari(pairs: DataFrame, a: str = "label", b: str = "pred") -> DataFrame:
    """One row (ari): adjusted Rand index; 0 where it has no denominator."""
    t = contingency(pairs, a, b)
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = t.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n"))
    rows = t.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sa"))
    cols = t.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sb"))
    x = cells.join(F.broadcast(rows)).join(F.broadcast(cols))  # one row each
    expected = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2.0)
    top = (F.col("sa") + F.col("sb")) / 2.0
    return x.select(F.when(top == expected, 0.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))


def nmi(pairs: DataFrame, a: str = "label", b: str = "pred") -> DataFrame:
    """One row (nmi): mutual information over the geometric mean of the entropies, natural logarithm."""
    t = contingency(pairs, a, b)
    na = t.groupBy(a).agg(F.sum("n").alias("na"))
    nb = t.groupBy(b).agg(F.sum("n").alias("nb"))
    n = t.agg(F.sum("n").alias("total"))
    e = t.join(na, a).join(nb, b).join(F.broadcast(n))
    mi = e.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda d, c, name: d.join(F.broadcast(n)).agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(name))
    x = mi.join(F.broadcast(h(na, "na", "ha"))).join(F.broadcast(h(nb, "nb", "hb")))
    den = F.sqrt(F.col("ha") * F.col("hb"))
    return x.select(F.when(den <= 0, 0.0).otherwise(F.col("mi") / den).alias("nmi"))


def class_metrics(pred: DataFrame, label: str = "label", guess: str = "pred") -> DataFrame:
    """(label, support, precision, recall, f1) of each class that occurs as a label."""
    t = contingency(pred, label, guess)
    support = t.groupBy(label).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    said = t.groupBy(F.col(guess).alias(label)).agg(F.sum("n").alias("said"))
    x = support.join(said, label, "left").fillna(0, ["said"])
    p = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    r = F.col("hit") / F.col("support")
    return x.select(label, "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def overall(pred: DataFrame, label: str = "label", guess: str = "pred") -> DataFrame:
    """One row: accuracy, macro precision, recall and f1, support-weighted f1."""
    m = class_metrics(pred, label, guess)
    acc = pred.where(F.col(label).isNotNull() & F.col(guess).isNotNull()).agg(F.avg((F.col(label) == F.col(guess)).cast("double")).alias("accuracy"))
    return m.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")).join(F.broadcast(acc))


def _before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over the rows that sort before: inside range partitions, and over the partitions' totals."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()).persist()
    parts = d.groupBy("__p").agg(F.sum(value).alias("__c"))  # a row a partition
    parts = parts.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))
    own = F.sum(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return d.join(F.broadcast(parts), "__p").withColumn(name, F.coalesce(own, F.lit(0)) + F.col("__b")).drop("__p", "__b")


def auc(scored: DataFrame, score: str = "score", positive: str = "positive", midrank: bool = True) -> DataFrame:
    """One row (auc). Equal scores count half with midrank; ties go by the order of `id` otherwise. 0.5 with one class only.

    Ranks come from sums inside ranges of the score and one sum a range, so no task sorts all rows."""
    if midrank:
        t = scored.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("c")).withColumn("neg", F.col("c") - F.col("p"))
        below = _before(t, [F.col(score)], "neg", "lower")
        r = below.agg(F.sum(F.col("p") * (F.col("lower") + F.col("neg") / 2.0)).alias("u"), F.sum("p").alias("np"), F.sum("neg").alias("nn"))
    else:
        t = scored.select(score, "id", F.col(positive).cast("long").alias("p"))
        seen = _before(t, [F.desc(score), F.col("id")], "p", "above")
        r = seen.agg(F.sum((1 - F.col("p")) * F.col("above")).cast("double").alias("u"), F.sum("p").alias("np"), F.sum(1 - F.col("p")).alias("nn"))
    return r.select(F.when((F.col("np") == 0) | (F.col("nn") == 0), 0.5).otherwise(F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


# ---------------------------------------------------------------- geometry


def silhouette(emb: DataFrame, labels: DataFrame, per_class: int | None = None, seed: int = 1, ref_values: int = REF_VALUES) -> DataFrame:
    """(id, label, s). Means to all members of each class (to at most per_class of them if it is given), the sample itself included.

    References beyond ref_values numbers are dealt into blocks, whose sums by class are added up."""
    spark = emb.sparkSession
    e = emb.join(labels.where("label is not null"), "id").select("id", F.col("label").cast("string").alias("label"), "x")
    refs = e
    if per_class is not None:
        w = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id")
        refs = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_class).drop("r")
    sizes = refs.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).orderBy("label").collect()  # a row a class
    if not sizes:
        return spark.createDataFrame([], "id long, label string, s double")
    names, n, width = [r["label"] for r in sizes], np.array([r["n"] for r in sizes]), max(r["width"] for r in sizes)
    blocks = max(1, -(-int(n.sum()) * width // ref_values))
    if blocks == 1:
        shared = spark.sparkContext.broadcast(by_class(refs.toArrow(), names))

        def run(it):
            for batch in it:
                sums = class_sums(matrix(batch.column("x")), *shared.value, len(names))
                own = np.searchsorted(names, batch.column("label").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("label"), pa.array(scores(sums / n, own))], ["id", "label", "s"])

        return dealt(e).mapInArrow(run, "id long, label string, s double")
    mine = query_blocks(e, width, blocks, ref_values)
    q = e.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fresh = [F.col(c).alias(c) for c in ("id", "label", "x")]  # else columns of the two sides are the same ones
    r = refs.select(*fresh).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(mine - 1)))).withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        sums = class_sums(matrix(q["x"]), *by_class(r, names), len(names)) if len(q) and len(r) else np.zeros((len(q), len(names)))
        return pa.table({"id": q["id"].cast(pa.int64()), "label": q["label"], "sums": listed(sums)})

    parts = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(meet, "id long, label string, sums array<double>")
    total = parts.groupBy("id", "label").agg(F.array(*[F.sum(F.col("sums")[c]) for c in range(len(names))]).alias("sums"))

    def last(it):
        for batch in it:
            own = np.searchsorted(names, batch.column("label").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(scores(matrix(batch.column("sums")) / n, own))], ["id", "label", "s"])

    return total.mapInArrow(last, "id long, label string, s double")


def by_class(t: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers, which rise, and vectors."""
    c = np.searchsorted(names, t["label"].to_numpy())
    o = np.argsort(c, kind="stable")
    return c[o], matrix(t["x"])[o]


def class_sums(x: np.ndarray, c: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Sums of the distances of each row of x to the rows of y of each class; near ones are computed by differences."""
    out = np.zeros((len(x), n))
    if not len(x):
        return out
    xx, yy = squares(x), squares(y)
    plain = too_large(xx, yy)
    for b in range(0, len(y), TILE[1]):
        t = slice(b, b + TILE[1])
        start = np.flatnonzero(np.append(True, c[t][1:] != c[t][:-1]))
        for a in range(0, len(x), TILE[0]):
            s = slice(a, a + TILE[0])
            if plain:
                d = distances(x[s], y[t], "euclidean")
            else:
                d = products(x[s], y[t], xx[s], yy[t])
                r, q = np.nonzero(d < NEAR_SHARE * (xx[s].max() + yy[t].max()))
                d[r, q] = 0.0
                d = np.sqrt(d, out=d)
                d[r, q] = pairs(x[s], y[t], r, q)
            out[s, c[t][start]] += np.add.reduceat(d, start, axis=1)
    return out


def scores(means: np.ndarray, own: np.ndarray) -> np.ndarray:
    at = np.arange(len(means))
    a = means[at, own]
    means[at, own] = np.inf
    b = means.min(axis=1)
    top = np.maximum(a, b)
    return np.where(np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)


def batch_mixing(emb: DataFrame, batch: DataFrame, k: int = 15) -> DataFrame:
    """(id, entropy): entropy of the batches among the k nearest, over the logarithm of the number of batches."""
    b = batch.where("batch is not null")
    n = b.select("batch").distinct().count()
    near = knn(emb, emb, k).join(b.withColumnRenamed("id", "other"), "other")
    c = near.groupBy("id", "batch").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy("id")))
    p = F.col("c") / F.col("t")
    return c.groupBy("id").agg((-F.sum(p * F.log(p)) / math.log(max(n, 2))).alias("entropy"))


# ---------------------------------------------------------------- classifiers


def folds(labels: DataFrame, n_folds: int = 5, seed: int = 1) -> DataFrame:
    """(id, label, fold): stratified, by the order of a hash inside each class."""
    w = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return labels.where("label is not null").withColumn("fold", (F.row_number().over(w) - 1) % n_folds)


def scaled(emb: DataFrame, train: DataFrame) -> DataFrame:
    """Coordinates standardised by the training rows."""
    t = emb.join(train.select("id"), "id").select(F.posexplode("x").alias("r", "v")).groupBy("r").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).orderBy("r").collect()
    return emb.select("id", F.array(*[(F.col("x")[q["r"]] - float(q["m"])) / float(q["s"] if q["s"] else 1.0) for q in t]).alias("x"))


def knn_predict(emb: DataFrame, train: DataFrame, test: DataFrame, k: int = 5, metric: str = "euclidean") -> DataFrame:
    """(id, label, pred): vote of the k nearest training rows; ties go to the first label in order."""
    near = knn(emb.join(test.select("id"), "id"), emb.join(train.select("id"), "id"), k, metric, exclude_self=False)
    votes = near.join(train.select(F.col("id").alias("other"), F.col("label").alias("pred")), "other").groupBy("id", "pred").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("id").orderBy(F.desc("votes"), "pred")
    best = votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "pred")
    return test.join(best, "id").select("id", "label", "pred")


def _ml(emb: DataFrame, train: DataFrame, test: DataFrame, estimator) -> DataFrame:
    names = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
    code = F.create_map(*[x for k, c in enumerate(names) for x in (F.lit(c), F.lit(float(k)))])
    feats = emb.select("id", array_to_vector("x").alias("features"))
    model = estimator.fit(feats.join(train, "id").withColumn("code", code[F.col("label")]).select("features", F.col("code").alias("label")))
    out = model.transform(feats.join(test.withColumnRenamed("label", "truth"), "id"))
    back = F.create_map(*[x for k, c in enumerate(names) for x in (F.lit(float(k)), F.lit(c))])
    return out.select("id", F.col("truth").alias("label"), back[F.col("prediction")].alias("pred"))


def classify_knn(emb: DataFrame, labels: DataFrame, test: DataFrame | None = None, test_fraction: float = 0.2, k: int = 5, metric: str = "euclidean", seed: int = 1) -> DataFrame:
    tr, te = _split(labels, test, test_fraction, seed)
    return knn_predict(emb, tr, te, k, metric)


def classify_logistic(emb: DataFrame, labels: DataFrame, test: DataFrame | None = None, test_fraction: float = 0.2, seed: int = 1, max_iter: int = 100) -> DataFrame:
    tr, te = _split(labels, test, test_fraction, seed)
    return _ml(scaled(emb, tr), tr, te, OneVsRest(classifier=LogisticRegression(regParam=0.0, maxIter=max_iter)))


def classify_forest(emb: DataFrame, labels: DataFrame, test: DataFrame | None = None, test_fraction: float = 0.2, seed: int = 1, trees: int = 500) -> DataFrame:
    tr, te = _split(labels, test, test_fraction, seed)
    return _ml(emb, tr, te, RandomForestClassifier(numTrees=trees, seed=seed))


def _split(labels: DataFrame, test: DataFrame | None, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    lab = labels.where("label is not null")
    if test is not None:
        return lab.join(test.select("id"), "id", "left_anti"), lab.join(test.select("id"), "id", "left_semi")
    cut = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < int(fraction * 1000)
    return lab.where(~cut), lab.where(cut)


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame

    def per_class(self) -> DataFrame:
        return class_metrics(self.predictions)

    def confusion(self) -> DataFrame:
        return contingency(self.predictions)

    def overall(self) -> dict[str, float]:
        return overall(self.predictions).first().asDict()

    def __repr__(self) -> str:
        return ", ".join(f"{k} {v:.4f}" for k, v in self.overall().items())


def kmeans(emb: DataFrame, k: int, seed: int = 1, starts: int = 10, max_iter: int = 100) -> DataFrame:
    """(id, pred): the best of several starts by within-cluster cost."""
    v = emb.select("id", array_to_vector("x").alias("features")).persist()
    fits = [KMeans(k=k, seed=seed + s, maxIter=max_iter).fit(v) for s in range(starts)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    return best.transform(v).select("id", F.col("prediction").alias("pred"))


def assess(emb: DataFrame, labels: DataFrame, batch: DataFrame | None = None, metrics: tuple[str, ...] = ("ari", "nmi", "silhouette", "knn"), n_folds: int = 5, k_nn: int = 15, seed: int = 1, trees: int = 100, starts: int = 3) -> pd.DataFrame:
    """(metric, value); classes under ten samples are left out."""
    big = labels.where("label is not null").groupBy("label").count().where(f"count >= {MIN_CLASS}")
    lab = labels.join(big.select("label"), "label", "left_semi").select("id", "label")
    k = big.count()
    out: list[tuple[str, float]] = []
    e = emb.join(lab.select("id"), "id").persist()
    if {"ari", "nmi"} & set(metrics) and k > 1:
        pairs = kmeans(e, k, seed, starts).join(lab, "id").persist()
        out += [(m, float(f(pairs).first()[0])) for m, f in (("ari", ari), ("nmi", nmi)) if m in metrics]
    if "silhouette" in metrics:
        out.append(("silhouette", float(silhouette(e, lab).agg(F.avg("s")).first()[0] or 0.0)))
    split = folds(lab, n_folds, seed).persist()
    for name in ("knn", "logistic", "forest"):
        if name not in metrics:
            continue
        preds = None
        for f in range(n_folds):
            tr, te = split.where(F.col("fold") != f).select("id", "label"), split.where(F.col("fold") == f).select("id", "label")
            x = scaled(e, tr) if name != "forest" else e
            p = knn_predict(x, tr, te, k_nn) if name == "knn" else _ml(x, tr, te, OneVsRest(classifier=LogisticRegression(regParam=0.0)) if name == "logistic" else RandomForestClassifier(numTrees=trees, seed=seed))
            preds = p if preds is None else preds.unionByName(p)
        preds = preds.persist()  # several aggregates read it
        r = overall(preds).first()
        preds.unpersist()
        out += [(f"{name}_{m}", float(r[m])) for m in ("accuracy", "macro_precision", "macro_recall", "macro_f1")]
    if batch is not None:
        out.append(("batch_mixing", float(batch_mixing(emb, batch, k_nn).agg(F.avg("entropy")).first()[0] or 0.0)))
    return pd.DataFrame(out, columns=["metric", "value"])
