"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort inside each range places equal texts
side by side, and each row is compared with its neighbour in full. Ranges are cut by (first bytes, digest, id),
so the copies of one text may spread over many ranges and no task holds a whole hot group; the runs that touch
a range's first or last row (two a range at most) are merged by one small table.

Defined results: a null text counts as empty and groups with other empty texts; a null id sorts after all others, so
it stays only if its whole group has null ids; repeated rows (same id and text) are separate members of one group, and
only the first of them is kept; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions

PREFIX = 32  # bytes of text in a splitter, so that what is sampled to the driver stays small


def normalised(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+", " ")


_OUT = pa.schema([("id", pa.int64()), ("keep_id", pa.int64()), ("size", pa.int64()), ("first", pa.bool_()), ("edge", pa.bool_()), ("sha", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; of each run of equal texts only the ids are held."""
    ids: list[np.ndarray] = []
    nulls: list[np.ndarray] = []
    text, sha, at_start, edge_sha = None, None, True, None

    def close(last: bool) -> list:
        v, isnull = np.concatenate(ids), np.concatenate(nulls)
        keep = None if isnull[0] else int(v[0])
        return [v, isnull, keep, sha, last or sha == edge_sha]

    def emit(rows: list) -> pa.RecordBatch:
        v = np.concatenate([r[0] for r in rows])
        isnull = np.concatenate([r[1] for r in rows])
        n = np.array([len(r[0]) for r in rows])
        first = np.zeros(len(v), bool)
        first[np.cumsum(n) - n] = True
        keep = pa.array([r[2] for r in rows], pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), n)))
        shas = pa.array([r[3] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), n)))
        return pa.record_batch([pa.array(v, pa.int64(), mask=isnull), keep, pa.array(np.repeat(n, n)), pa.array(first), pa.array(np.repeat(np.array([r[4] for r in rows]), n)), shas], schema=_OUT)

    for b in batches:
        if not b.num_rows:
            continue
        norm, digest, raw = b.column(0), b.column(1), b.column(2)
        v, isnull = raw.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(raw.is_null())
        cut = [0]
        if len(norm) > 1:
            cut += (np.flatnonzero(~np.asarray(pc.equal(norm[1:], norm[:-1]))) + 1).tolist()
        rows = []
        for lo, hi in zip(cut, [*cut[1:], b.num_rows]):
            own = norm[lo].as_py()
            if text is not None and own != text:
                rows.append(close(False))
                ids, nulls = [], []
            if own != text:
                text, sha = own, digest[lo].as_py()
                if at_start:
                    edge_sha, at_start = sha, False
            ids.append(v[lo:hi])
            nulls.append(isnull[lo:hi])
        if rows:
            yield emit(rows)
    if ids:
        yield emit([close(True)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).cast("long").alias("__id"), normalised(F.col(text_col)).alias("__norm"))
    df = df.withColumn("__sha", F.sha2(F.col("__norm").cast("binary"), 256))
    keys = [F.substring(F.col("__norm").cast("binary"), 1, PREFIX).alias("__p"), "__sha"]
    df = df.select("__norm", "__sha", "__id", keys[0])
    last = F.col("__id").asc_nulls_last()
    df = df.repartitionByRange(partitions(spark), "__p", "__sha", last).sortWithinPartitions("__p", "__sha", "__norm", last)
    runs = materialise(df.select("__norm", "__sha", "__id").mapInArrow(_runs, "id long, keep_id long, size long, first boolean, edge boolean, sha string"), "exact")
    # runs that touch an end of their range may go on in the next one: two a range at most
    part = runs.where("edge and first").groupBy("sha").agg(F.min("keep_id").alias("k2"), F.sum("size").alias("s2"))
    out = runs.join(F.broadcast(part), "sha", "left")
    keep = F.when(F.col("edge"), F.col("k2")).otherwise(F.col("keep_id"))
    size = F.when(F.col("edge"), F.col("s2")).otherwise(F.col("size"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        size.alias("group_size"),
        (F.col("first") & F.col("id").eqNullSafe(keep)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, all columns kept."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumn("__own", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    out = own.join(kept, own[id_col].eqNullSafe(kept["__id"]) & (own["__own"] == kept["__sha"]), "left_semi")
    if docs.groupBy(id_col).count().where("count > 1").limit(1).count():  # rows of one id and one text: one of them
        out = out.dropDuplicates([id_col, "__own"])
    return out.select(*docs.columns)
