"""Benchmark decontamination: test windows of words looked up in every window of every document.

Native: DataFrame and SQL functions only. A bit table of the test windows' (first word, last word) hashes picks the
candidate positions of a document inside its row, so only those few windows leave the row; each is then compared in
full with the test windows by a hash join (broadcast while the count of test windows is within `broadcast_limit`,
shuffled beyond it). The bit table has a fixed size; a benchmark that fills it costs time, never results.

Defined results: null text has no words, no hits and is not contaminated; an item without words has no window; an item
of fewer than n words is one window of its own length; repeated rows are judged each on its own; an empty documents
table gives no rows, an empty benchmark no hits; null item ids hit words but are not counted as items; extra columns
of either table are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

BITS = 1 << 19
BROADCAST_LIMIT = 500_000


def words(text: Column) -> Column:
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _bucket(a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(BITS))


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(len, key, a, b, item_id): every n-word window of each item, or the whole of a shorter one."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n))).where("len > 0")
    w = w.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    s = F.slice("w", F.col("at"), F.col("len"))
    return w.select("item", "len", F.array_join(s, " ").alias("key"), _bucket(F.element_at(s, 1), F.element_at(s, -1)).alias("bucket")).distinct()


def _bit_table(buckets: list[int]) -> Column:
    table = [0] * (BITS // 64)
    for b in buckets:
        table[b >> 6] |= 1 << (b & 63)
    return F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in table)), ",").cast("array<bigint>")


def _test(table: Column, length: int) -> Callable[[Column], Column]:
    def test(i: Column) -> Column:
        b = _bucket(F.get("__w", i), F.get("__w", i + (length - 1)))
        return F.getbit(F.get(table, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def _candidate(length: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice("__w", i + 1, length), " ").alias("key"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """docs with __rid, __n (words), __spans (array of (at, len), 0-based words) and __items (array of item ids)."""
    windows = item_windows(benchmark, n).cache()
    count = windows.count()
    by_len = {r["len"]: r["b"] for r in windows.groupBy("len").agg(F.collect_set("bucket").alias("b")).collect()}
    base = docs.withColumn("__w", words(F.col("text"))).withColumn("__n", F.size("__w"))
    found = []
    for length, buckets in sorted(by_len.items()):
        table = _bit_table(buckets)

        at = F.when(F.col("__n") >= length, F.filter(F.sequence(F.lit(0), F.col("__n") - length), _test(table, length)))
        found.append(F.transform(F.coalesce(at, F.array().cast("array<int>")), _candidate(length)))
    keep = [F.col(c) for c in docs.columns]
    empty = F.array().cast("array<struct<at:int,len:int,key:string>>")
    c = base.select(*keep, "__n", F.monotonically_increasing_id().alias("__rid"), (F.concat(*found) if found else empty).alias("__c"))
    c = c.select(*keep, "__n", "__rid", F.explode_outer("__c").alias("__c"))
    c = c.select(*keep, "__n", "__rid", F.col("__c.at").alias("__at"), F.col("__c.len").alias("__len"), F.col("__c.key").alias("__key"))
    side = windows.select(F.col("key").alias("__key"), F.col("item").alias("__item"), F.lit(True).alias("__hit"))
    c = c.join(F.broadcast(side) if count <= broadcast_limit else side, "__key", "left")
    first = [F.first(x).alias(x.replace("`", "")) for x in docs.columns]
    out = c.groupBy("__rid", "__n").agg(*first, F.collect_set(F.when(F.col("__hit"), F.struct(F.col("__at").alias("at"), F.col("__len").alias("len")))).alias("__spans"), F.collect_set(F.when(F.col("__hit"), F.col("__item"))).alias("__items"))
    return out


def covered(spans: str = "__spans") -> Column:
    """The distinct word positions that the spans cover."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Per document: n_words, n_hit (words inside any occurrence of a window), the items, contaminated."""
    h = hits(docs.select(F.col(id_col).alias("doc_id"), "text"), benchmark, n, broadcast_limit)
    return h.select(
        F.col("doc_id").alias(id_col),
        F.col("__n").cast("long").alias("n_words"),
        F.size(covered()).cast("long").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Documents without a hit, all columns kept."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    bad = hits(docs.select(F.col(id_col).alias("__id"), mark.alias("__mark"), "text"), benchmark, n, broadcast_limit)
    bad = bad.where(F.size("__spans") > 0).select("__id", "__mark")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]) & (mark == bad["__mark"]), "left_anti")
