"""Delta-maintained token counts by source, language and tokenizer version.

A batch of signed changes is reduced to additive totals and written to a staging folder; one rename to the batch's own name
commits it. A batch whose name is there already is not applied again, so a driver may repeat any commit after a failure, and
a lost executor only repeats tasks of the staging write. Totals are the sum over the committed batches. `compact` folds
batches into one that lists their names.

Defined results: null text counts as empty (one document, no tokens); null source or language is a group of its own;
repeated rows are counted each; an empty batch commits without rows; extra columns are not read; a group whose documents
are all deleted stays, with zeros, until `totals(drop_zero=True)`.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the published split pattern of this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


@cache
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """docs with a last column n_tokens, the length of each whole text under the vocabulary."""
    n = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for b in batches:
            c = pa.array([len(enc.encode_ordinary(t.as_py() or "")) for t in b.column(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, c], names=[*b.schema.names, "n_tokens"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias("n_tokens")).schema)


def changes(docs: DataFrame, sign: int, version: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Signed rows of a batch: +1 for inserted texts, -1 for deleted ones; a revision is both."""
    d = with_tokens(docs.select("source", "lang", "text"), path, pattern)
    s = F.lit(sign).cast("long")
    return d.select("source", "lang", F.lit(version).alias("tokenizer"), s.alias("n_docs"), (s * F.col("n_tokens")).alias("n_tokens"), (s * F.char_length(F.coalesce("text", F.lit(""))).cast("long")).alias("n_chars"))


def revised(counts: DataFrame, version: str) -> DataFrame:
    """Signed rows from counts known before and after: columns source, lang, old_tokens, new_tokens (and old_chars, new_chars)."""
    return counts.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), (F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).cast("long").alias("n_tokens"), (F.coalesce("new_chars", F.lit(0)) - F.coalesce("old_chars", F.lit(0))).cast("long").alias("n_chars"))


class Rollup:
    """Totals in a folder of the shared store; any number of readers, one committing driver at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("batches", "staging"):
            self._fs.mkdirs(self._path(f"{self.path}/{d}"))

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/batches")))

    @staticmethod
    def _name(batch_id: str) -> str:
        return "b-" + batch_id.encode().hex()

    def _lists(self) -> set[str]:
        """Names that compacted batches stand for."""
        names: set[str] = set()
        for n in self._names():
            if n.startswith("c-"):
                text = self.spark.read.text(f"{self.path}/batches/{n}/names.json").collect()[0][0]
                names |= set(json.loads(text))
        return names

    def committed(self, batch_id: str) -> bool:
        name = self._name(batch_id)
        return self._fs.exists(self._path(f"{self.path}/batches/{name}")) or name in self._lists()

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """Apply the batch once; False if it was there already."""
        if self.committed(batch_id):
            return False
        stage = f"{self.path}/staging/{uuid.uuid4().hex}"
        signed.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).write.parquet(f"{stage}/data")
        done = self._fs.rename(self._path(stage), self._path(f"{self.path}/batches/{self._name(batch_id)}"))
        if not done and not self.committed(batch_id):
            raise OSError(f"batch {batch_id} could not be committed")
        return bool(done)

    def totals(self, drop_zero: bool = False) -> DataFrame:
        names = self._names()
        listed = self._lists()
        paths = [f"{self.path}/batches/{n}/data" for n in names if n not in listed]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        out = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return out.where(" or ".join(f"{c} <> 0" for c in SUMS)) if drop_zero else out

    def compact(self) -> None:
        """Fold all committed batches into one; readers see either the old ones or the new one."""
        names, listed = self._names(), self._lists()
        stage = f"{self.path}/staging/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{stage}/data")
        text = json.dumps(sorted(set(names) | listed))
        out = self._fs.create(self._path(f"{stage}/names.json"))
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(self._path(stage), self._path(f"{self.path}/batches/c-{uuid.uuid4().hex}"))
        for n in names:  # they are listed, so a reader skips them while they go
            self._fs.delete(self._path(f"{self.path}/batches/{n}"), True)
