"""Suffix-array dedup: removes every byte that a `length`-byte string covers which starts anywhere else too.

Sorting all suffixes of a large corpus would move every byte many times. Each window of `length` bytes is instead named by
the leftmost smallest hash of a `gram`-byte string inside it, its anchor: equal windows have equal anchors at equal places.
So only the suffixes that start at anchors are sorted, and of these only the ones whose anchor string occurs twice or more,
with the text around them that their windows cover, each distinct context once. Suffixes (and, reversed, the prefixes before
them) are put in order by deep-shallow sorting: multikey quicksort on eight bytes at a time to a shallow depth, then a blind
trie for each group that still agrees. Common-prefix lengths of neighbours then tell, for each place of a window around the
anchor, which suffixes agree before and after it far enough; those windows are the repeated ones. Results are exact to
128-bit digests of equal contexts and equal texts.

An anchor string with more than `hot` distinct contexts does not meet in one task. Its windows are halved by the bytes they
have before the anchor, each context being cut to what the windows of a half cover; windows of one half that are equal share
the bytes that all its windows cover, so the half's contexts part by those bytes. Halves that are still too large are halved
again; contexts that have become equal are one from then on. The same sorting solves the parts.

Equal texts are one text, found again by its digest; of two or more rows every byte is repeated if it has `length` of them.

Defined results: null counts as empty; texts under `length` bytes keep all; repeated rows are repeats of each other; ids are
not read but returned, so null and repeated ids are as any other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, materialise, mix, text_chunks

LENGTH = 400
GRAM = 48
SHALLOW = 64  # bytes sorted by multikey quicksort
HOT = 4096  # distinct contexts of one anchor string that are sorted together
BATCH = 24 << 20  # bytes of contexts sorted together
POS = np.uint64((1 << 20) - 1)
SEGMENT = 1 << 20


# ---------------------------------------------------------------- anchors


def _segment(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, hash) of each anchor of at most SEGMENT bytes, places within the segment."""
    n = len(data)
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    if n < length:
        return none
    r, rinv = _powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * rinv[:n], out=s[1:])
    g = mix((s[gram:] - s[:-gram]) * r[: n - gram + 1])
    key = (g & ~POS) | np.arange(len(g), dtype=np.uint64)
    w = length - gram + 1
    pad = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(key)] = key
    rows = pad.reshape(-1, w)
    pre = np.minimum.accumulate(rows, axis=1).ravel()
    suf = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - length + 1
    at = (np.minimum(suf[:last], pre[w - 1 : w - 1 + last]) & POS).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)  # windows that lie inside one row
    size = np.diff(offs)
    ok = size >= length
    edge[offs[:-1][ok]] += 1
    edge[offs[:-1][ok] + size[ok] - length + 1] -= 1
    v = np.flatnonzero(np.cumsum(edge)[:last] > 0)
    if not len(v):
        return none
    p = at[v]
    cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(v) != 1)) + 1
    first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(v)]]) - 1
    return np.searchsorted(offs, v[first], "right") - 1, p[first], v[first], v[end], g[p[first]]


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window start, last window start, hash), places from the start of the row's text."""
    if len(data) <= SEGMENT:
        row, p, lo, hi, g = _segment(data, offs, length, gram)
        base = offs[row]
        return row, p - base, lo - base, hi - base, g
    out = []
    for k in range(len(offs) - 1):  # a row over a segment long is read in segments that share length - 1 bytes
        text = data[offs[k] : offs[k + 1]]
        for at in range(0, max(1, len(text) - length + 1), SEGMENT - length + 1):
            part = text[at : at + SEGMENT]
            row, p, lo, hi, g = _segment(part, np.array([0, len(part)]), length, gram)
            out.append((row + k, p + at, lo + at, hi + at, g))
    return tuple(np.concatenate(x) for x in zip(*out))


# ---------------------------------------------------------------- deep-shallow sorting


def _multikey(words: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ternary quicksort of all groups at once on eight-byte keys; (order, group number of each place) when rows agree on
    `depth` words or stand alone."""
    n = len(order)
    group, level, done = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    while True:
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, n))
        done |= np.repeat(size == 1, size) | (level >= depth)
        live = np.flatnonzero(~done)
        if not live.size:
            return order, group
        key = words[order[live], level[live]]
        of = np.searchsorted(start, live, "right") - 1
        lead = np.concatenate([[True], of[1:] != of[:-1]])
        first = np.flatnonzero(lead)
        many = np.diff(np.append(first, len(live)))
        pivot = key[first + many // 2]
        turn = np.cumsum(lead) - 1
        side = 1 + (key > pivot[turn]).astype(np.int64) - (key < pivot[turn]).astype(np.int64)
        o = np.lexsort((side, turn))
        order[live] = order[live[o]]
        level[live] = level[live[o]] + (side[o] == 1)
        fresh = np.zeros(n, bool)
        fresh[start] = True
        s, t = side[o], turn[o]
        fresh[live[1:][(s[1:] != s[:-1]) | (t[1:] != t[:-1])]] = True
        group = np.cumsum(fresh) - 1


class BlindTrie:
    """Orders rows that agree on a long prefix: nodes hold only the depth at which rows part."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.root = rows, None

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        row = self.rows[i]
        node = self.root
        while not isinstance(node, list):  # blindly to some leaf
            node = node[1].get(int(row[node[0]])) or next(iter(node[1].values()))
        other = self.rows[node[0]]
        differ = np.flatnonzero(row != other)
        if not differ.size:
            node.append(i)
            return
        at = int(differ[0])
        up, branch, node = None, None, self.root
        while not isinstance(node, list) and node[0] < at:
            up, branch = node, int(row[node[0]])
            node = node[1][branch]
        if not isinstance(node, list) and node[0] == at:
            node[1][int(row[at])] = [i]
            return
        made = (at, {int(other[at]): node, int(row[at]): [i]})
        if up is None:
            self.root = made
        else:
            up[1][branch] = made

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                out += node
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the row before it) of zero-padded byte rows; their width is a multiple of eight."""
    n, width = rows.shape
    words = rows.view(">u8").astype(np.uint64).reshape(n, width // 8)
    depth = min(shallow, width) // 8
    order, group = _multikey(words, np.arange(n), depth)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), n]):
        if b - a > 1:
            trie = BlindTrie(rows)
            for i in order[a:b].tolist():
                trie.add(i)
            order[a:b] = trie.order()
    lcp = np.zeros(n, np.int64)
    for a in range(1, n, 4096):
        b = min(n, a + 4096)
        same = rows[order[a:b]] == rows[order[a - 1 : b - 1]]
        lcp[a:b] = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    return order, lcp


def _padded(parts: list[bytes]) -> np.ndarray:
    width = max(8, -(-max(map(len, parts)) // 8) * 8)
    out = np.zeros((len(parts), width), np.uint8)
    lens = np.array([len(p) for p in parts])
    flat = np.frombuffer(b"".join(parts), np.uint8)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(np.arange(len(parts)), lens), at] = flat
    return out


def repeated_windows(contexts: list[bytes], before: np.ndarray, times: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct context (bytes around an anchor, `before` of them before it, seen `times` times): the largest and the
    smallest number of bytes before the anchor at which a repeated window starts; -1 where there is none."""
    n = len(contexts)
    size = np.array([len(c) for c in contexts])
    ahead = size - before
    most, least = before.copy(), np.maximum(0, length - ahead)  # windows that lie inside the context
    top, low = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    twice = times > 1
    top[twice], low[twice] = most[twice], least[twice]
    if n < 2:
        return top, low
    fo, fl = deep_shallow(_padded([c[b:] for c, b in zip(contexts, before.tolist())]))
    bo, bl = deep_shallow(_padded([c[:b][::-1] for c, b in zip(contexts, before.tolist())]))
    fr, br = np.empty(n, np.int64), np.empty(n, np.int64)
    fr[fo], br[bo] = np.arange(n), np.arange(n)
    for o in range(int(most.max()) + 1):
        some = np.flatnonzero((least <= o) & (o <= most))
        if len(some) < 2:
            continue
        f = np.cumsum(fl < length - o)[fr[some]]
        b = np.cumsum(bl < o)[br[some]] if o else np.zeros(len(some), np.int64)
        key = f * (n + 1) + b
        s = np.argsort(key, kind="stable")
        k = key[s]
        same = k[1:] == k[:-1]
        hit = some[s[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        top[hit] = np.maximum(top[hit], o)
        low[hit] = np.where((low[hit] < 0) | (low[hit] > o), o, low[hit])
    return top, low


# ---------------------------------------------------------------- Spark


def _fresh(t1: pa.Array, t2: pa.Array, seen: set) -> np.ndarray:
    """Rows whose text the task has not met; `seen` only saves work, so it may forget."""
    if len(seen) > 1_000_000:
        seen.clear()
    out = []
    for k, key in enumerate(zip(t1.to_pylist(), t2.to_pylist())):
        if key not in seen:
            seen.add(key)
            out.append(k)
    return np.array(out, np.int64)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t1, t2, text) without the copies inside a task."""
    seen: set = set()
    for b in batches:
        yield b.take(pa.array(_fresh(b.column(0), b.column(1), seen)))


_ANCHOR = "h long, t1 long, t2 long, pos int, lo int, hi int"


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _once(batches):
            t1, t2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, data, offs in text_chunks(b.column(2)):
                row, p, first, last, g = anchors(data, offs, length, gram)
                yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(t1[lo + row]), pa.array(t2[lo + row]), *(pa.array(x.astype(np.int32)) for x in (p, first, last))], names=["h", "t1", "t2", "pos", "lo", "hi"])

    return run


def _longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit digests as two columns."""
    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(d[:, 0]), pa.array(d[:, 1])


_CONTEXT = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("before", pa.int32()), ("context", pa.binary()), ("n", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int32())])
_CONTEXT_SQL = "g1 long, g2 long, k1 long, k2 long, before int, context binary, n long, t1 long, t2 long, pos int"


def _contexts(length: int):
    """Rows (t1, t2, text, list) in. Out: each context that the task has met, with its count (g1: the anchor's hash, g2: 0); and
    each place of a context (t1, t2, pos), without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: dict[bytes, list] = {}
        size = 0

        def met() -> pa.RecordBatch:
            h, before, ctx, n = zip(*held.values())
            none = pa.nulls(len(held), pa.int64())
            return pa.record_batch([pa.array(h, pa.int64()), pa.array(np.zeros(len(h), np.int64)), *_longs(list(held)), pa.array(before, pa.int32()), pa.array(ctx, pa.binary()), pa.array(n, pa.int64()), none, none, pa.nulls(len(held), pa.int32())], schema=_CONTEXT)

        for b in batches:
            keys, t1, t2, pos = [], [], [], []
            for k in _fresh(b.column(0), b.column(1), seen).tolist():
                text = b.column(2)[k].as_py().encode()
                at = b.column(3)[k].as_py()
                for a in at:
                    c = text[a["lo"] : a["hi"] + length]
                    before = a["pos"] - a["lo"]
                    x = xxhash.xxh3_128_digest(c + before.to_bytes(4, "little"))
                    keys.append(x), pos.append(a["pos"])
                    if x in held:
                        held[x][3] += 1
                    else:
                        held[x] = [a["h"], before, c, 1]
                        size += len(c) + 200
                t1 += [b.column(0)[k].as_py()] * len(at)
                t2 += [b.column(1)[k].as_py()] * len(at)
            none = pa.nulls(len(keys), pa.int64())
            yield pa.record_batch([none, none, *_longs(keys), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary()), none, pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(pos, pa.int32())], schema=_CONTEXT)
            if size > 2 * BATCH:
                yield met()
                held, size = {}, 0
        if held:
            yield met()

    return run


_SOLVED = "k1 long, k2 long, top int, low int"


def _solve(length: int):
    """Rows (g1, g2, k1, k2, before, context, n) sorted by g in; groups are taken whole, and sorted together while they are small."""

    def solve(held: dict[bytes, list]) -> pa.RecordBatch:
        keys = list(held)
        group, before, ctx, n = zip(*held.values())
        _, inv, many = np.unique(np.array(group), return_inverse=True, return_counts=True)
        need = np.flatnonzero(many[inv] > 1)  # alone in its group: only its own copies count
        before, times = np.array(before, np.int64), np.array(n, np.int64)
        size = np.array([len(c) for c in ctx], np.int64)
        top = np.where(times > 1, before, -1)
        low = np.where(times > 1, np.maximum(0, length - (size - before)), -1)
        if len(need):
            top[need], low[need] = repeated_windows([ctx[k] for k in need.tolist()], before[need], times[need], length)
        hit = np.flatnonzero(top >= 0)
        return pa.record_batch([*_longs([keys[k] for k in hit.tolist()]), pa.array(top[hit].astype(np.int32)), pa.array(low[hit].astype(np.int32))], names=["k1", "k2", "top", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, last, group = 0, None, -1
        for b in batches:
            digest = np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()], axis=1).tobytes()
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist())
            for k, (g1, g2, before, c, n) in enumerate(rows):
                if (g1, g2) != last:
                    if size >= BATCH:
                        yield solve(held)
                        held, size = {}, 0
                    last, group = (g1, g2), group + 1
                key = digest[16 * k : 16 * k + 16]
                if key in held:
                    held[key][3] += n
                else:
                    held[key] = [group, before, c, n]
                    size += len(c) + 200
        if held:
            yield solve(held)

    return run


def _halves(length: int):
    """Rows (c1, c2, before, context, w1, w2) in, one row out for each half of the windows w1..w2 (bytes before the anchor) that
    the context has: the context cut to them, its digest k, and the digest g of the bytes that all windows of the half cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, g, d = [], [], []
            for c1, c2, before, x, w1, w2 in zip(*(b.column(k).to_pylist() for k in range(6))):
                mid = (w1 + w2) // 2
                for a, z in {(w1, mid), (mid + 1, w2)}:
                    lo, hi = max(a, length - (len(x) - before)), min(z, before)
                    if lo > hi:
                        continue
                    cut, mark = x[before - hi : before - lo + length], b"%d %d " % (a, z)
                    g.append(xxhash.xxh3_128_digest(mark + x[before - a : before + length - z]))
                    d.append(xxhash.xxh3_128_digest(mark + b"%d " % hi + cut))
                    out.append((c1, c2, hi, cut, a, z))
            c1, c2, before, cut, a, z = zip(*out) if out else ((),) * 6
            yield pa.record_batch([*_longs(g), *_longs(d), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(before, pa.int32()), pa.array(cut, pa.binary()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["g1", "g2", "k1", "k2", "c1", "c2", "before", "context", "w1", "w2"])

    return run


def _sorted(contexts: DataFrame, length: int) -> DataFrame:
    rows = contexts.select("g1", "g2", "k1", "k2", "before", "context", "n")
    return rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_solve(length), _SOLVED)


def _split(contexts: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(contexts of groups of up to `hot` distinct ones, the large groups or None). The list of large groups is short: it is
    broadcast while it has 100,000 rows at most."""
    big = materialise(contexts.groupBy("g1", "g2").agg(F.count("*").alias("distinct")).where(F.col("distinct") > hot).select("g1", "g2"), "large-groups")
    n = big.count()
    if not n:
        return contexts, None
    big = F.broadcast(big) if n <= 100_000 else big
    return contexts.join(big, ["g1", "g2"], "left_anti"), big


def solved(contexts: DataFrame, length: int, width: int, hot: int) -> DataFrame:
    """Contexts (g1, g2, k1, k2, before, context, n) with repeated windows: (k1, k2, top, low), a row for each part of the windows."""
    small, big = _split(contexts, hot)
    out = _sorted(small, length)
    if big is None:
        return out
    one = [F.min(c).alias(c) for c in ("before", "context")]
    rest = contexts.join(big, ["g1", "g2"]).groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(*one, F.sum("n").alias("n"))
    rest = materialise(rest, "large")
    twice = rest.where("n > 1").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("before").alias("top"), F.greatest(F.lit(0), length - (F.octet_length("context") - F.col("before"))).cast("int").alias("low"))
    out = out.unionByName(twice)
    rest = rest.withColumn("w1", F.lit(0)).withColumn("w2", F.lit(width - 1))
    while big is not None:
        schema = "g1 long, g2 long, k1 long, k2 long, c1 long, c2 long, before int, context binary, w1 int, w2 int"
        parts = materialise(rest.select("c1", "c2", "before", "context", "w1", "w2").mapInArrow(_halves(length), schema), "halves")
        reps = materialise(parts.groupBy("g1", "g2", "k1", "k2").agg(*one, F.count("*").alias("n")), "distinct")
        small, big = _split(reps, hot)
        found = _sorted(small, length)
        out = out.unionByName(parts.join(found, ["k1", "k2"]).select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "top", "low"))
        if big is not None:
            rest = parts.join(big, ["g1", "g2"], "left_semi")
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, t2, text, list of spans) in; kept text and the figures out."""
    for b in batches:
        kept, rows = [], []
        for t, spans in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            raw = (t or "").encode()
            runs: list[list[int]] = []
            for a, z in sorted((s["start"], s["stop"]) for s in spans or []):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], z)
                else:
                    runs.append([a, z])
            at, out = 0, []
            for a, z in runs:
                out.append(raw[at:a])
                at = z
            out.append(raw[at:])
            left = b"".join(out)
            kept.append(left)
            rows.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"start": a, "stop": z} for a, z in runs]))
        n, removed, spans, sha, where = zip(*rows) if rows else ((),) * 5
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes)."""
    gram = min(gram, max(1, length // 2))
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))
    t = d.select("t1", "t2", "text").where(F.octet_length("text") >= length)
    a = materialise(t.mapInArrow(_anchor_rows(length, gram), _ANCHOR), "anchors")
    # written, so that the join reads both sides from a shuffle and a common anchor string's rows can be dealt out
    seen = materialise(a.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "repeated-anchors")
    lists = a.join(seen, "h").groupBy("t1", "t2").agg(F.collect_set(F.struct("h", "pos", "lo", "hi")).alias("list"))
    both = t.mapInArrow(_once, "t1 long, t2 long, text string").join(lists, ["t1", "t2"]).select("t1", "t2", "text", "list")
    c = materialise(both.mapInArrow(_contexts(length), _CONTEXT_SQL), "contexts")
    windows = solved(c.where("n is not null"), length, length - gram + 1, hot)
    spans = c.where("n is null").select("t1", "t2", "pos", "k1", "k2").join(windows, ["k1", "k2"])
    spans = spans.select("t1", "t2", (F.col("pos") - F.col("top")).alias("start"), (F.col("pos") - F.col("low") + length).alias("stop"))
    copies = t.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("stop")).where("n > 1")
    spans = spans.unionByName(copies.select("t1", "t2", F.lit(0).alias("start"), "stop"))
    found = materialise(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("list")), "spans")
    out = d.join(found, ["t1", "t2"], "left").select("doc_id", "t1", "t2", "text", "list")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"
    return out.mapInArrow(_cut, schema).withColumnRenamed("doc_id", id_col)
