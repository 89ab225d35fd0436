"""Shared helpers: session settings, durable intermediate tables, and numpy text kernels.

The numpy kernels work on the UTF-8 bytes of a whole Arrow column chunk at once, in chunks of about a
megabyte, so the memory of a Python worker does not follow the size of an Arrow batch.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts (space, and \t \n \v \f \r).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="factorlake-")
        spark.conf.set("spark.checkpoint.dir", at)
        _remove_at_exit(spark, at)
    return at.rstrip("/")


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def gone() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may already be stopped
            pass

    atexit.register(gone)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/factorlake/{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_shared(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder, as a mounted path that tasks can memory-map."""
    path = new_path(spark, name)
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"memory-mapped levels need spark.checkpoint.dir on a mounted file system, not {path}")
    return path.removeprefix("file://").removeprefix("file:")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else; plain lower() where the text is ASCII, as it is faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- numpy text kernels

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(int(_R), -1, 2**64))
_pow: dict[str, np.ndarray] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64, for i < n."""
    if len(_pow.get("r", ())) < n:
        for k, base in (("r", _R), ("i", _RINV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow["r"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    a = batch.column(batch.schema.get_field_index(name))
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def text_chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them), nulls as empty; whole texts only."""
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each white-space separated word; words end with their text."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~_IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(data)]
    start[cut] = word[cut]
    end = np.zeros(len(data) + 1, bool)
    end[1:-1] = word[:-1] & ~word[1:]
    end[-1] = word[-1]
    cut = cut[cut > 0]
    end[cut] = word[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, by one prefix sum over the chunk; equal bytes give equal hashes anywhere."""
    if not len(starts):
        return np.empty(0, np.uint64)
    r, rinv = _powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * rinv[: len(data)], out=s[1:])
    return mix((s[ends] - s[starts]) * r[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased (A-Z) word of the chunk, and the number of words before each row (len(rows)+1)."""
    s, e = word_bounds(data, offs)
    return span_hashes(data, s, e), np.searchsorted(s, offs)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; with fewer words, the whole sequence as one; none: empty."""
    out: list[np.ndarray] = []
    n = len(h)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : n - k + 1 + j]
        acc = mix(acc ^ np.uint64(k))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        elif b > a:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for j in range(a, b):
                    x = x * np.uint64(0xC2B2AE3D27D4EB4F) + h[j]
            out.append(mix(np.array([x ^ np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
