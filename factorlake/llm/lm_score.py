"""LM scoring with an Elias-Fano trie of words, word pairs and longer n-grams up to `order`.

Level 1 holds the hashes of all training words with their exact counts, level 2 the words that follow each word, level n the
words that follow each n-gram of the level before. All lie in shards of memory-mapped Elias-Fano files in the shared folder:
monotone keys, monotone cumulated counts, monotone pointers from an n-gram to its followers, and the followers' numbers, made
monotone by starting each list after the end of the list before it. An n-gram is found by a successor search relative to its
context's list; its place in its shard names it as a context of the next level. Levels from 2 on keep the discounted
probability of each n-gram, and from 3 on the weight of the shorter context, quantised in 16 bits of log10 and rounded down, so
that the model's probabilities sum to one at most. p(w|v) = max(c(vw) - D, 0) / c(v) + D * followers(v) / c(v) * p(w), with
p(w) = (c(w) + 1) / (N + V + 1), and in the same way p(w|uv) on p(w|v) and so on; the context of a text's first word is the end
mark, after an unknown word only p(w) counts, and after a context that was not seen the shorter one. Texts are never joined.

Tasks count words and pairs of whole partitions in numpy and send sorted blocks by shard; words with more followers than a
shard should hold are split over shards by the follower. The number of shards follows the bytes of the training text.

Defined results: null and empty texts are one end mark; a null id hashes as the empty text; repeated rows train and score
each; texts of any length are scored whole; without training rows N and V are 0 and every token has probability 1; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, local_shared, mix, text_chunks, word_hashes
from .elias_fano import EliasFano, replace

END = np.uint64(0x454E44)  # no word hashes are compared with it but by chance, as with any other word
DISCOUNT = 0.75
SHARD_BYTES = 24 << 20
ORDER = 3
STEP = 6000.0  # codes to a factor of ten
NONE = 65535  # the code of a context that was not seen
DECODED = 10.0 ** (-np.arange(NONE + 1) / STEP)
TOKENS = 1 << 21  # tokens looked up together


def tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, token hashes with an end mark after each row, rows' offsets in them)."""
    for lo, hi, data, offs in text_chunks(col):
        h, first = word_hashes(data, offs)
        n = np.diff(first)
        out = np.full(len(h) + hi - lo, END, np.uint64)
        out[np.arange(len(h)) + np.repeat(np.arange(hi - lo), n)] = h
        yield lo, hi, out, np.concatenate([[0], np.cumsum(n + 1)])


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as byte planes of their differences, counts in the smallest type: the shuffle's codec does the rest."""
    d = np.diff(keys, prepend=np.uint64(0))
    c = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes(), c.dtype.char.encode() + c.tobytes()


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    d = np.frombuffer(keys, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(counts[1:], np.dtype(counts[:1].decode())).astype(np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


class Tally:
    """Counts of 64-bit keys, merged whenever the unmerged ones outgrow the merged."""

    def __init__(self) -> None:
        self.k, self.c, self.waiting = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.k.append(k)
        self.c.append(c.astype(np.int64))
        self.waiting += len(k)
        if self.waiting > max(1 << 20, len(self.k[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = merged(self.k, self.c)
        self.k, self.c, self.waiting = [k], [c], 0
        return k, c


def place_counts(shard: np.ndarray, key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, key, count) summed by shard and key, in their order; without counts each row is one."""
    room = 64 - int(shard.max(initial=0)).bit_length()
    if int(key.max(initial=0)).bit_length() <= room < 64:  # both fit in one word
        both = (shard.astype(np.uint64) << np.uint64(room)) | key
        if count is None:
            both, count = np.unique(both, return_counts=True)
        else:
            both, count = merged([both], [count])
        return (both >> np.uint64(room)).astype(np.int32), both & np.uint64((1 << room) - 1), count.astype(np.int64)
    count = np.ones(len(key), np.int64) if count is None else count
    o = np.lexsort((key, shard))
    shard, key, count = shard[o], key[o], count[o]
    first = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.empty(0, np.int64)
    return shard[first], key[first], np.add.reduceat(count, first) if len(first) else count


_BLOCK = pa.schema([("shard", pa.int32()), ("k", pa.binary()), ("c", pa.binary())])


def blocks(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    o = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[o], keys[o], counts[o]
    names, first = np.unique(shard, return_index=True)
    for s, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(shard)]):
        k, c = pack(keys[a:b], counts[a:b])
        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([k], pa.binary()), pa.array([c], pa.binary())], schema=_BLOCK)


@dataclass(frozen=True)
class Model:
    """Small: a few numbers, and one count of words for each shard."""

    path: str
    bits: int  # 2**bits shards
    sizes: tuple[int, ...]  # words in each shard of level 1
    n: int
    v: int
    split: int  # contexts seen more often than this are split
    discount: float
    order: int


class Reader:
    """The memory-mapped levels in one worker."""

    def __init__(self, m: Model) -> None:
        self.m = m
        self.base = np.concatenate([[0], np.cumsum(m.sizes)]).astype(np.int64)
        self.files: dict[str, EliasFano | np.ndarray] = {}

    def _ef(self, name: str) -> EliasFano:
        if name not in self.files:
            self.files[name] = EliasFano.load(f"{self.m.path}/{name}")
        return self.files[name]

    def words(self, h: np.ndarray, followers: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct hashes: (number or -1, count, followers)."""
        rank, count, fol = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shift = np.uint64(64 - self.m.bits)
        names, first = np.unique(h >> shift, return_index=True)
        for s, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(h)]):
            if not self.m.sizes[s]:
                continue
            i, hit = self._ef(f"w{s}.keys").find(local_key(h[a:b], self.m.bits))
            i = i[hit]
            at = a + np.flatnonzero(hit)
            rank[at] = i + self.base[s]
            count[at] = _between(self._ef(f"w{s}.counts"), i)
            if followers:
                fol[at] = _between(self._ef(f"w{s}.followers"), i)
        return rank, count, fol

    def pairs(self, key: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability of each (number << 32 | number), 0 if unseen, and its place in its shard, -1 if unseen; keys
        sorted inside each shard."""
        out, place = np.zeros(len(key)), np.full(len(key), -1, np.int64)
        for s, own in by_shard(shard):
            ctx, inv = np.unique(key[own] >> np.uint64(32), return_inverse=True)
            i, hit = self._ef(f"p{s}.contexts").find(ctx)
            ok = np.flatnonzero(hit[inv])
            k, found = self._follow(f"p{s}", np.where(hit, i, 0), inv[ok], key[own[ok]])
            out[own[ok[found]]], place[own[ok[found]]] = self._probability(f"p{s}", k[found]), k[found]
        return out, place

    def longer(self, n: int, place: np.ndarray, shard: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For n-grams by the place of their context: probability, weight of the shorter context (1 if the context was not seen),
        and place in the same shard."""
        out, back, at = np.zeros(len(place)), np.ones(len(place)), np.full(len(place), -1, np.int64)
        for s, own in by_shard(shard):
            key, inv = np.unique((place[own].astype(np.uint64) << np.uint64(32)) | word[own].astype(np.uint64), return_inverse=True)
            ctx, of = np.unique(key >> np.uint64(32), return_inverse=True)
            code = self._codes(f"t{n}_{s}.backs")[ctx.astype(np.int64)]
            back[own] = np.where(code == NONE, 1.0, DECODED[code])[of][inv]
            k, found = self._follow(f"t{n}_{s}", ctx.astype(np.int64), of, key)
            p, where = np.zeros(len(key)), np.full(len(key), -1, np.int64)
            p[found], where[found] = self._probability(f"t{n}_{s}", k[found]), k[found]
            out[own], at[own] = p[inv], where[inv]
        return out, back, at

    def _follow(self, name: str, ctx: np.ndarray, of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search of the low halves of keys in the lists of their contexts ctx[of]: (place, found)."""
        ptr, val = self._ef(f"{name}.pointers"), self._ef(f"{name}.values")
        if not val.n:
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        start = ptr.access(ctx).astype(np.int64)
        base = np.zeros(len(ctx), np.uint64)
        later = start > 0
        base[later] = val.access(start[later] - 1) + np.uint64(1)
        k, found = val.find(base[of] + (key & np.uint64(0xFFFFFFFF)))
        at = np.flatnonzero(found)
        found[at] = k[at] < ptr.access(ctx[of[at]] + 1).astype(np.int64)
        return k, found

    def _codes(self, name: str) -> np.ndarray:
        if name not in self.files:
            path = f"{self.m.path}/{name}"
            self.files[name] = np.memmap(path, np.uint16, "r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, np.uint16)
        return self.files[name]

    def _probability(self, name: str, k: np.ndarray) -> np.ndarray:
        return DECODED[self._codes(f"{name}.codes")[k]]

    def chain(self, rank: np.ndarray, count: np.ndarray, lead: np.ndarray, edge: np.ndarray, up_to: int) -> Iterator[tuple]:
        """Tokens by number and count, each text led by an end mark; `lead` marks those that end no text themselves, `edge`
        all of them. For each n from 2 to `up_to`: (n, the positions i whose n-gram lies inside a text and whose context was seen, its shards, the contexts' places (None for pairs),
        probabilities, weights of the shorter context, places)."""
        ok = (rank >= 0) & ~lead
        at = np.flatnonzero(ok)
        at = at[rank[at - 1] >= 0]
        key, inv = np.unique((rank[at - 1].astype(np.uint64) << np.uint64(32)) | rank[at].astype(np.uint64), return_inverse=True)
        c = np.zeros(len(key), np.int64)
        c[inv] = count[at - 1]
        shard = pair_shards(key, c, self.m.split, 1 << self.m.bits)
        p, place = self.pairs(key, shard)
        shard, place = shard[inv], place[inv]
        yield 2, at, shard, None, p[inv], None, place
        whole, homes = np.full(len(rank), -1, np.int64), np.zeros(len(rank), np.int32)
        for n in range(3, up_to + 1):
            whole[:] = -1
            whole[at], homes[at] = place, shard
            at = np.flatnonzero(ok)
            at = at[(whole[at - 1] >= 0) & ~edge[at - 1]]
            shard, ctx = homes[at - 1], whole[at - 1]
            p, back, place = self.longer(n, ctx, shard, rank[at])
            yield n, at, shard, ctx, p, back, place


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    o = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[o], return_index=True)
    for s, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(o)]):
        yield s, o[a:b]


def local_key(h: np.ndarray, bits: int) -> np.ndarray:
    """A hash inside its shard, under 2**63 (bits is 1 at least)."""
    return h & ((np.uint64(1) << np.uint64(64 - bits)) - np.uint64(1))


def _between(cum: EliasFano, i: np.ndarray) -> np.ndarray:
    return (cum.access(i + 1) - cum.access(i)).astype(np.int64)


def pair_shards(key: np.ndarray, c_first: np.ndarray, split: int, n: int) -> np.ndarray:
    """Shard of each pair; a context that occurs more than `split` times is dealt over several by its follower."""
    ctx, w = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
    parts = -(-c_first // split)
    salt = np.where(parts > 1, mix(w + np.uint64(77)) % np.maximum(parts, 1).astype(np.uint64), np.uint64(0))
    return (mix(ctx * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(n)).astype(np.int32)


def numbered(h: np.ndarray, reader: Reader, followers: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, count and followers of every token."""
    uniq, inv = np.unique(h, return_inverse=True)
    r, c, f = reader.words(uniq, followers)
    return r[inv], c[inv], f[inv]


def quantised(p: np.ndarray) -> np.ndarray:
    return np.ceil(-np.log10(p) * STEP - 1e-9).clip(0, NONE - 1).astype(np.uint16)


def write_lists(name: str, w: np.ndarray, first: np.ndarray, stop: np.ndarray, p: np.ndarray) -> None:
    """The followers w of each context (w[first:stop], none empty) and their probabilities."""
    last = w[stop - 1] + np.uint64(1) if len(stop) else np.empty(0, np.uint64)
    base = np.concatenate([[np.uint64(0)], np.cumsum(last, dtype=np.uint64)[:-1]]) if len(stop) else last
    replace(f"{name}.values", EliasFano.build(np.repeat(base, stop - first) + w).save)
    replace(f"{name}.codes", quantised(p).tofile)


def train(docs: DataFrame, text: str = "text", discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES, order: int = ORDER) -> Model:
    """Build the levels from all rows of docs."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col(text).alias("text"))
    path = local_shared(spark, "lm")
    os.makedirs(path, exist_ok=True)
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(1, int(size // shard_bytes).bit_length())
    shards = 1 << bits

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tally()
        for b in batches:
            for _, _, h, _ in tokens(b.column(0)):
                t.add(h)
        k, c = t.merge()
        yield from blocks((k >> np.uint64(64 - bits)).astype(np.int32), k, c)

    def write_words(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        k, c = merged(*zip(*map(lambda x, y: unpack(x, y), table["k"].to_pylist(), table["c"].to_pylist())))
        replace(f"{path}/w{s}.keys", EliasFano.build(local_key(k, bits)).save)
        replace(f"{path}/w{s}.counts", EliasFano.build(np.concatenate([[0], np.cumsum(c)])).save)
        return pa.table({"shard": pa.array([s], pa.int32()), "v": pa.array([len(k)]), "n": pa.array([int(c.sum())])})

    block = "shard int, k binary, c binary"
    made = docs.mapInArrow(count_words, block).groupBy("shard").applyInArrow(write_words, "shard int, v long, n long").collect()  # a row a shard
    sizes = [0] * shards
    for r in made:
        sizes[r["shard"]] = r["v"]
    n, v = sum(r["n"] for r in made), sum(sizes)
    if v >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    m = Model(path, bits, tuple(sizes), n, v, max(1, n // (4 * shards)), discount, order)
    if not n:
        return m

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, reader, waiting, size = Tally(), Reader(m), [], 0

        def take() -> None:
            r, _, _ = numbered(np.concatenate(waiting), reader)
            t.add((r[:-1].astype(np.uint64) << np.uint64(32)) | r[1:].astype(np.uint64))

        for b in batches:
            for _, _, h, _ in tokens(b.column(0)):
                waiting.append(h if waiting else np.concatenate([[END], h]))
                size += len(h)
                if size >= TOKENS:
                    take()
                    waiting, size = [], 0
        if waiting:
            take()
        k, c = t.merge()
        if len(k):
            first, at = np.unique(k >> np.uint64(32), return_inverse=True)
            yield from blocks(pair_shards(k, reader_counts(reader, first)[at], m.split, shards), k, c)

    def write_pairs(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        k, c = merged(*zip(*map(lambda x, y: unpack(x, y), table["k"].to_pylist(), table["c"].to_pylist())))
        ctx, first = np.unique(k >> np.uint64(32), return_index=True)
        stop = np.append(first[1:], len(k)) if len(k) else first
        total = np.repeat(reader_counts(Reader(m), ctx), stop - first)
        write_lists(f"{path}/p{s}", k & np.uint64(0xFFFFFFFF), first, stop, np.maximum(c - discount, 1e-9) / total)
        replace(f"{path}/p{s}.pointers", EliasFano.build(np.append(first, len(k))).save)
        replace(f"{path}/p{s}.contexts", EliasFano.build(ctx).save)
        home = np.searchsorted(Reader(m).base[1:], ctx.astype(np.int64), "right").astype(np.int32)
        names, at = np.unique(home, return_index=True)
        rows = [pack(x, y) for x, y in zip(np.split(ctx, at[1:]), np.split(stop - first, at[1:]))][: len(names)]
        return pa.table({"shard": pa.array(names, pa.int32()), "k": pa.array([x for x, _ in rows], pa.binary()), "c": pa.array([y for _, y in rows], pa.binary())})

    def write_followers(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        k, c = merged(*zip(*map(lambda x, y: unpack(x, y), table["k"].to_pylist(), table["c"].to_pylist())))
        full = np.zeros(sizes[s] + 1, np.int64)
        full[1 + k.astype(np.int64) - int(Reader(m).base[s])] = c
        replace(f"{path}/w{s}.followers", EliasFano.build(np.cumsum(full)).save)
        return pa.table({"shard": pa.array([s], pa.int32())})

    none = pack(np.empty(0, np.uint64), np.empty(0, np.int64))  # every shard is written, so a missing file is an error
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(none[0]).alias("k"), F.lit(none[1]).alias("c"))
    pairs = docs.mapInArrow(count_pairs, block).unionByName(every).groupBy("shard").applyInArrow(write_pairs, block)
    done = {r["shard"] for r in pairs.groupBy("shard").applyInArrow(write_followers, "shard int").collect()}  # a row a shard
    for s in range(shards):
        if sizes[s] and s not in done:
            replace(f"{path}/w{s}.followers", EliasFano.build(np.zeros(sizes[s] + 1, np.int64)).save)
    for level in range(3, order + 1):
        long = docs.mapInArrow(_count_long(m, level), block).unionByName(every)
        long.groupBy("shard").applyInArrow(_write_long(m, level), "shard int").agg(F.count("*")).collect()
    return m


def _count_long(m: Model, n: int):
    """Blocks of (place of the context << 32 | number) with counts, by the context's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, waiting, size, parts, held = Reader(m), [], 0, [], 0

        def take() -> None:
            h = np.concatenate(waiting)
            rank, count, _ = numbered(h, reader)
            lead = np.zeros(len(h), bool)
            lead[0] = True  # the other texts are led by the end mark of the one before; no longer n-gram may hold it inside
            *_, (_, at, shard, _, _, _, place) = reader.chain(rank, count, lead, h == END, n - 1)
            whole, homes = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int32)
            whole[at], homes[at] = place, shard
            at = np.flatnonzero((h[:-1] != END) & (whole[:-1] >= 0) & (rank[1:] >= 0)) + 1
            key = (whole[at - 1].astype(np.uint64) << np.uint64(32)) | rank[at].astype(np.uint64)
            parts.append(place_counts(homes[at - 1], key))

        for b in batches:
            for _, _, h, _ in tokens(b.column(0)):
                waiting.append(h if waiting else np.concatenate([[END], h]))
                size += len(h)
                if size >= TOKENS:
                    take()
                    waiting, size, held = [], 0, held + len(parts[-1][1])
                    if held > 2 * len(parts[0][1]) + (1 << 22):
                        parts = [place_counts(*map(np.concatenate, zip(*parts)))]
                        held = len(parts[0][1])
        if waiting:
            take()
        if parts:
            yield from blocks(*place_counts(*map(np.concatenate, zip(*parts))))

    return run


def _write_long(m: Model, n: int):
    def run(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        k, c = merged(*zip(*map(lambda x, y: unpack(x, y), table["k"].to_pylist(), table["c"].to_pylist())))
        before = Reader(m)._ef(f"p{s}.values" if n == 3 else f"t{n - 1}_{s}.values").n
        ctx, first = np.unique(k >> np.uint64(32), return_index=True)
        stop = np.append(first[1:], len(k)) if len(k) else first
        total, own = np.add.reduceat(c, first) if len(k) else c, ctx.astype(np.int64)
        name = f"{m.path}/t{n}_{s}"
        write_lists(name, k & np.uint64(0xFFFFFFFF), first, stop, np.maximum(c - m.discount, 1e-9) / np.repeat(total, stop - first))
        sizes, backs = np.zeros(before + 1, np.int64), np.full(before, NONE, np.uint16)
        sizes[own + 1] = stop - first
        backs[own] = quantised(m.discount * (stop - first) / total)
        replace(f"{name}.pointers", EliasFano.build(np.cumsum(sizes)).save)
        replace(f"{name}.backs", backs.tofile)
        return pa.table({"shard": pa.array([s], pa.int32())})

    return run


def reader_counts(reader: Reader, number: np.ndarray) -> np.ndarray:
    """Counts of words by their (sorted) numbers."""
    number = number.astype(np.int64)
    out = np.zeros(len(number), np.int64)
    cut = np.searchsorted(number, reader.base)
    for s in range(len(cut) - 1):
        if cut[s] < cut[s + 1]:
            out[cut[s] : cut[s + 1]] = _between(reader._ef(f"w{s}.counts"), number[cut[s] : cut[s + 1]] - reader.base[s])
    return out


def score(docs: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """docs with last columns n_tokens, n_known, base_score, score."""
    n = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(m)
        for b in batches:
            out, waiting, size = [], [], 0
            for part in tokens(b.column(n)):
                waiting.append(part)
                size += len(part[2])
                if size >= TOKENS:
                    out.append(scored(waiting, reader))
                    waiting, size = [], 0
            if waiting:
                out.append(scored(waiting, reader))
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, t) for t in (np.int64, np.int64, float, float)]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cols)], names=[*b.schema.names, "n_tokens", "n_known", "base_score", "score"])

    zero = F.lit(0).cast("long")
    return docs.mapInArrow(run, docs.select("*", zero.alias("n_tokens"), zero.alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema)


def scored(parts: list, reader: Reader) -> tuple[np.ndarray, ...]:
    m = reader.m
    h = np.concatenate([p[2] for p in parts])
    lens = np.concatenate([np.diff(p[3]) for p in parts])
    first = np.cumsum(lens) - lens
    uniq, inv = np.unique(h, return_inverse=True)
    rank, count, fol = reader.words(uniq, followers=m.n > 0)
    p1 = (count + 1.0) / (m.n + m.v + 1.0)
    p = p1[inv]
    if m.n:
        lead = first + np.arange(len(first))  # every text is led by an end mark of its own
        inside = np.ones(len(h) + len(first), bool)
        inside[lead] = False
        at_end = np.searchsorted(uniq, END)
        seq = np.full(len(inside), at_end)
        seq[inside] = inv
        back = np.where(count > 0, m.discount * fol / np.maximum(count, 1), 1.0)
        full = np.zeros(len(seq))
        full[inside] = back[seq[np.flatnonzero(inside) - 1]] * p
        for n, at, _, _, prob, weight, _ in reader.chain(rank[seq], count[seq], ~inside, ~inside, m.order):
            full[at] = (full[at] if n == 2 else weight * full[at]) + prob
        p = full[inside]
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
    total = lambda x: np.add.reduceat(x, first)
    return lens, total((count > 0)[inv].astype(np.int64)), total(np.log10(p1)[inv]), total(np.log10(np.minimum(p, 1.0)))


def lm_scores(docs: DataFrame, mod: int = 7, held_out: int = 2, id_col: str = "doc_id", discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES, order: int = ORDER) -> DataFrame:
    """Train on rows whose crc32(id) mod `mod` is not `held_out`; score all rows."""
    d = docs.select(F.col(id_col).alias("doc_id"), "text")
    held = crc_mod("doc_id", mod) == held_out
    m = train(d.where(~held), discount=discount, shard_bytes=shard_bytes, order=order)
    s = score(d, m)
    return s.select(F.col("doc_id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), "base_score", "score")
