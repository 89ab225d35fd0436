"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over hashed words and word beginnings is trained in numpy from confirmed toxic examples and unlabelled
text. Its risk is prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior * E_pos[l(-)]); where the bracket turns negative, the
step undoes it instead (the published non-negative correction). The prior is the share of toxic rows among the training
labels. Training sees bounded samples (`max_positive`, `max_unlabelled`: the rows with the smallest hash of their id);
scoring reads the whole of every text.

Defined results: a null or empty text has only the bias, which gives a score under the threshold; repeated rows get the
same score each; without positive examples every score is 0; an empty table gives no rows; null labels or ids never train;
extra columns are not read by a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mix, span_hashes, text_chunks, word_bounds

DIM = 1 << 20
PREFIXES = (5, 7)  # bytes of a word's beginning that are features too
MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
THRESHOLD = 0.7


def features(col: pa.Array) -> Iterator[np.ndarray]:
    """For each row the sorted distinct feature numbers of its whole text."""
    for lo, hi, data, offs in text_chunks(col):
        s, e = word_bounds(data, offs)
        first = np.searchsorted(s, offs)
        h = [span_hashes(data, s, e)]
        row = [np.repeat(np.arange(hi - lo), np.diff(first))]
        base = row[0]
        for k in PREFIXES:
            long = np.flatnonzero(e - s > k)
            h.append(mix(span_hashes(data, s[long], s[long] + k) ^ np.uint64(k)))
            row.append(base[long])
        key = np.unique((np.concatenate(row).astype(np.int64) << np.int64(20)) | (np.concatenate(h) % np.uint64(DIM)).astype(np.int64))
        cut = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.int64) << 20)
        key &= DIM - 1
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield key[a:b].astype(np.int32)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(features(b.column(1)))
        lens = np.cumsum([0, *map(len, rows)])
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))], names=["pos", "f"])


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    bias: float
    prior: float
    history: list[float] = field(default_factory=list)

    def table(self) -> np.ndarray:
        w = np.zeros(DIM)
        w[self.keys] = self.weights
        return w


def _csr(rows: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in keys, row of each), features that are not in keys left out."""
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    f = np.concatenate(rows)
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
    ok = keys[at] == f
    return at[ok], r[ok]


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, epochs: int = 300, rate: float = 0.05, l2: float = 1e-4, min_share: float = 0.015, lift: float = 3.0) -> Model:
    """Keeps features of at least `min_share` of the positives and `lift` times as frequent there; full-batch Adam on the non-negative risk with the logistic loss."""
    if not pos or not unl:
        return Model(np.empty(0, np.int64), np.empty(0), -20.0, prior)
    seen, times = np.unique(np.concatenate(pos), return_counts=True)
    # features of a passage that a few examples share would fit those examples only
    common, among = np.unique(np.concatenate(unl), return_counts=True)
    rate_unl = np.zeros(DIM)
    rate_unl[common] = among / len(unl)
    share = times / len(pos)
    keys = seen[(share >= min_share) & (times >= min(3, len(pos))) & (share >= lift * rate_unl[seen])].astype(np.int64)
    if not len(keys):
        return Model(np.empty(0, np.int64), np.empty(0), -20.0, prior)
    (pk, pr), (uk, ur) = _csr(pos, keys), _csr(unl, keys)
    k, m = len(keys), np.zeros((2, len(keys) + 1))
    w, bias, history = np.zeros(k), -2.0, []

    def sig(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    for t in range(1, epochs + 1):
        zp = np.bincount(pr, w[pk], len(pos)) + bias
        zu = np.bincount(ur, w[uk], len(unl)) + bias
        soft = lambda z: np.logaddexp(0, z)
        negative = soft(zu).mean() - prior * soft(zp).mean()
        history.append(prior * soft(-zp).mean() + max(0.0, negative))
        if negative >= 0:  # gradient of both parts
            gp, gu = prior * (sig(zp) - 1) / len(pos) - prior * sig(zp) / len(pos), sig(zu) / len(unl)
        else:  # undo the negative part only
            gp, gu = prior * sig(zp) / len(pos), -sig(zu) / len(unl)
        g = np.empty(k + 1)
        g[:k] = np.bincount(pk, gp[pr], k) + np.bincount(uk, gu[ur], k) + l2 * w
        g[k] = gp.sum() + gu.sum()
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.999 * m[1] + 0.001 * g * g
        step = rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:k], bias - step[k]
    return Model(keys, w, float(bias), prior, history)


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, id_col: str = "doc_id", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Labels only from rows whose crc32(id) mod `mod` is not `held_out`."""
    train_ids = crc_mod(id_col, mod) != held_out
    lab = labels.select(F.col(id_col).alias("__id"), "toxic").where(F.col("__id").isNotNull() & F.col("toxic").isNotNull())
    lab = lab.withColumnRenamed("__id", id_col).where(train_ids)
    prior = lab.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    pos_ids = lab.where("toxic = 1").select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_positive).withColumn("pos", F.lit(True))
    unl_ids = docs.select(F.col(id_col).alias("__id")).where(train_ids_of("__id", mod, held_out) & F.col("__id").isNotNull()).distinct().orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(max_unlabelled).withColumn("pos", F.lit(False))
    ids = pos_ids.unionByName(unl_ids)  # at most max_positive + max_unlabelled rows
    picked = docs.select(F.col(id_col).alias("__id"), "text").join(F.broadcast(ids), "__id").select("pos", "text")
    pos, unl = [], []
    for b in picked.mapInArrow(_feature_batches, "pos boolean, f array<int>").toArrow().to_batches():
        f = b.column(1)
        vals, offs = f.values.to_numpy(), f.offsets.to_numpy()
        for i, p in enumerate(b.column(0).to_pylist()):
            (pos if p else unl).append(vals[offs[i] : offs[i + 1]])
    order = lambda x: (len(x), x.tobytes())  # noqa: E731  the same model whatever the order of arrival
    return fit(sorted(pos, key=order), sorted(unl, key=order), float(prior))


def train_ids_of(col: str, mod: int, held_out: int) -> Column:
    return crc_mod(col, mod) != held_out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a last column `__score` (0 to 1)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.keys, model.weights))  # min(DIM, features of the positives) entries
    bias, n, empty = model.bias, docs.columns.index("text"), not len(model.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(DIM)
        keys, weights = shared.value
        w[keys] = weights
        for b in batches:
            z = np.fromiter((w[f].sum() for f in features(b.column(n))), np.float64, b.num_rows) + bias
            p = np.zeros(len(z)) if empty else 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "__score"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("__score")).schema)


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    model = train(docs, labels, mod, held_out, id_col)
    s = score(docs.select(F.col(id_col).alias("doc_id"), "text"), model)
    return s.select(F.col("doc_id").alias(id_col), (crc_mod("doc_id", mod) == held_out).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Rows scored under the threshold, all columns kept."""
    return score(docs, train(docs, labels, mod, held_out)).where(F.col("__score") < threshold).select(*docs.columns)
