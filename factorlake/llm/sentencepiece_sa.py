"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A text falls into units that no piece of the vocabulary can span; the units that a worker has not met yet are concatenated
and indexed by a suffix array (sorted to the length of the longest piece). Every piece of the vocabulary is found by binary
search as one range of suffixes; the ranges are the edges of the units' lattices. Sorted by their ends, the edges are
relaxed from left to right: an edge may end a path if its piece and the path's last piece would stand side by side in a BPE
encoding, so that each prefix has one path, the encoding that merging by score gives. All steps are numpy over whole
batches. Characters outside the vocabulary become byte pieces.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded each; texts of any
length are encoded whole; an empty table gives no rows; decoding an id that is not in the vocabulary is an error; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BATCH_CHARS = 1 << 20  # bytes of text whose units are looked up together
CACHE_UNITS = 400_000  # units remembered by a worker before it starts anew
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
NEVER = np.int64(1) << 60


@dataclass
class Vocabulary:
    """Read once by the driver; everything here is bounded by the size of the vocabulary."""

    pieces: list[str]
    kinds: list[int]
    rank: np.ndarray  # position by falling score, equal for equal scores
    byte_id: np.ndarray
    prefix: bool
    time: np.ndarray = field(default=None)  # when merging by score makes the piece; -1 single characters, NEVER not at all
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    pair_keys: np.ndarray = field(default=None)  # (a << 20 | b) of all pairs that make a piece, sorted, and that piece's rank
    pair_rank: np.ndarray = field(default=None)


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type != 2 or m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only BPE models with the identity normaliser are read")
    pieces, kinds = [p.piece for p in m.pieces], [p.type for p in m.pieces]
    scores = np.array([p.score for p in m.pieces])
    _, inverse = np.unique(-scores, return_inverse=True)
    byte_id = np.full(256, 0, np.int32)
    for i, (p, k) in enumerate(zip(pieces, kinds)):
        if k == BYTE:
            byte_id[int(p[3:5], 16)] = i
    v = Vocabulary(pieces, kinds, inverse.astype(np.int64), byte_id, bool(m.normalizer_spec.add_dummy_prefix))
    _merge_tables(v)
    return v


def merge(v: Vocabulary, known: dict[str, int], text: str) -> list[tuple[str, tuple | None, int]]:
    """Plain merging by score, leftmost first: (string, its two halves, time) of what is left. For building tables and tests."""
    parts: list[tuple[str, tuple | None, int]] = [(c, None, -1) for c in text]
    now = -1
    while True:
        best = min(((v.rank[known[a[0] + b[0]]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a[0] + b[0] in known), default=None)
        if best is None:
            return parts
        r, i = best
        now = max(now, int(r))
        parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], (parts[i][0], parts[i + 1][0]), now)]


def _merge_tables(v: Vocabulary) -> None:
    n = len(v.pieces)
    known = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k in (NORMAL, USER)}
    v.time, v.left, v.right = np.full(n + 1, NEVER), np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    keys, ranks = [], []
    for p, i in known.items():
        if len(p) == 1:
            v.time[i] = -1
            continue
        for k in range(1, len(p)):
            a, b = known.get(p[:k]), known.get(p[k:])
            if a is not None and b is not None:
                keys.append(a << 20 | b)
                ranks.append(v.rank[i])
        last = merge(v, known, p)
        if len(last) == 1:
            a, b = last[0][1]
            v.time[i], v.left[i], v.right[i] = last[0][2], known.get(a, -1), known.get(b, -1)
            if v.left[i] < 0 or v.right[i] < 0:  # a half outside the vocabulary cannot be
                v.time[i] = NEVER
    order = np.argsort(np.array(keys, np.int64))
    v.pair_keys, v.pair_rank = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]


class Encoder:
    """One per worker. Unit -> ids, found for many new units at a time."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        usable = [i for i, k in enumerate(v.kinds) if k in (NORMAL, USER) and v.time[i] < NEVER]
        self.known = {v.pieces[i]: i for i in usable}
        self.longest = max(4, 4 * -(-max((len(p) for p in self.known), default=1) // 4))
        chars = sorted({c for p in self.known for c in p})
        self.code = {c: i + 2 for i, c in enumerate(chars)}  # 0: after the end, 1: outside the vocabulary
        self.bits = max(1, (len(chars) + 2).bit_length())
        if 4 * self.bits > 62:
            raise ValueError("too many characters in the vocabulary")
        self.points = np.array(sorted(map(ord, chars)), np.int64)
        many = [p for p in self.known if len(p) > 1]
        inner = {c for p in many for c in p}
        #: no piece goes from another character to a space mark, so units end there; single characters stand alone
        self.split_marks = not any(a != SPACE and b == SPACE for p in many for a, b in zip(p, p[1:]))
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        stop = re.escape(alone)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+|[{stop}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.split_marks else re.compile(r"(?s).+")
        # pieces as rows of packed codes, four characters to a word
        self.ids = np.array([self.known[p] for p in self.known], np.int64)
        self.lens = np.array([len(p) for p in self.known], np.int64)
        if self.lens.max(initial=0) > 63:
            raise ValueError("a piece of more than 63 characters does not fit the packed edges")
        packed = np.zeros((len(self.ids), self.longest), np.int64)
        for r, p in enumerate(self.known):
            packed[r, : len(p)] = [self.code[c] for c in p]
        self.low = self._pack(packed)
        full = (1 << self.bits) - 1
        self.high = self._pack(np.where(np.arange(self.longest) < self.lens[:, None], packed, full))
        self.hit_keys = np.full(1 << 20, -1, np.int64)
        self.hit_ok = np.zeros(1 << 20, bool)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]

    def _pack(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] // 4), np.int64)
        for k in range(4):
            out = (out << self.bits) | codes[:, k::4]
        return out

    # ---- the lattice of new units

    def _suffixes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array of the codes by their first `longest` characters, and the packed four characters at each place."""
        n = len(text)
        pad = np.zeros(n + self.longest + 4, np.int64)
        pad[:n] = text
        k0 = np.zeros(n + self.longest, np.int64)
        for k in range(4):
            k0 = (k0 << self.bits) | pad[k : k + len(k0)]
        rank = np.unique(k0, return_inverse=True)[1].astype(np.int64)
        width = 4
        while width < self.longest:
            nxt = np.zeros(len(rank), np.int64)
            nxt[:-width] = rank[width:]
            rank = np.unique((rank << np.int64(32)) | nxt, return_inverse=True)[1].astype(np.int64)
            width *= 2
        return np.argsort(rank[:n], kind="stable"), k0

    def _search(self, sa: np.ndarray, k0: np.ndarray, keys: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(sa), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            at, less, same = sa[mid], np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for w in range(keys.shape[1]):
                x, y = k0[at + 4 * w], keys[open_, w]
                less |= same & (x < y)
                same &= x == y
            go = less | same if right else less
            lo[open_[go]] = mid[go] + 1
            hi[open_[~go]] = mid[~go]
        return lo

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b stand side by side in the encoding of their concatenation."""
        key = a << 20 | b
        slot = ((key * np.int64(0x2545F4914F6CDD1D)) >> np.int64(40)) & np.int64((1 << 20) - 1)
        hit = self.hit_keys[slot] == key
        out = self.hit_ok[slot]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            uniq, inv = np.unique(key[miss], return_inverse=True)
            ok = self._side_by_side(uniq >> 20, uniq & ((1 << 20) - 1))
            out[miss] = ok[inv]
            self.hit_keys[slot[miss]] = key[miss]
            self.hit_ok[slot[miss]] = out[miss]
            # two new keys may share a slot: the last one written is what the slot holds, both of its values from one row
        return out

    def _side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Walks both pieces' inner edges back in time; a merge across them that comes before their parents' breaks the pair."""
        v = self.v
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while live.size:
            x, y = a[live], b[live]
            key = x << 20 | y
            at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            there = v.pair_keys[at] == key
            when = np.maximum(v.pair_rank[at], np.maximum(v.time[x], v.time[y]))
            bad = there & (when < until_a[live]) & (when <= until_b[live])
            ok[live[bad]] = False
            ta, tb = v.time[x], v.time[y]
            go_a = (ta >= tb) & (ta >= 0)
            go_b = ~go_a & (tb >= 0)
            i, j = live[go_a & ~bad], live[go_b & ~bad]
            until_a[i] = v.time[a[i]]
            a[i] = v.right[a[i]]
            until_b[j] = v.time[b[j]]
            b[j] = v.left[b[j]]
            live = np.concatenate([i, j])
        return ok

    def _new(self, units: list[str]) -> None:
        """Encode units that are not in the index."""
        lens = np.array([len(u) for u in units], np.int64)
        raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, raw), len(self.points) - 1)
        code = np.where(self.points[at] == raw, at + 2, 1)
        # a mark after each unit keeps matches inside it
        first = np.cumsum(lens + 1) - (lens + 1)
        text = np.zeros(len(raw) + len(units), np.int64)
        place = np.arange(len(raw)) + np.repeat(np.arange(len(units)), lens)
        text[place] = code
        sa, k0 = self._suffixes(text)
        lo, hi = self._search(sa, k0, self.low, False), self._search(sa, k0, self.high, True)
        count = hi - lo
        # edges by their end, longer ones first; the piece's number in the low bits
        which = np.repeat(np.arange(len(count)), count)
        start = sa[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        edges = np.sort(((start + self.lens[which]) << 26) | ((63 - np.minimum(self.lens[which], 63)) << 20) | self.ids[which])
        ends = edges >> 26
        piece = edges & ((1 << 20) - 1)
        length = 63 - ((edges >> 20) & 63)
        n = len(text) + 1
        ptr = np.searchsorted(ends, np.arange(n + 1))
        unk = len(self.v.pieces)
        last, back = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        offset = place - np.repeat(first, lens) + 1  # of the end of each character in its unit
        stop = place + 1
        outside = code == 1
        order = np.argsort(offset, kind="stable")
        cuts = np.searchsorted(offset[order], np.arange(1, int(lens.max(initial=0)) + 2))
        for t in range(len(cuts) - 1):
            group = order[cuts[t] : cuts[t + 1]]
            e = stop[group]
            out = outside[group]
            last[e[out]], back[e[out]] = unk, 1
            e, base = e[~out], t + 1
            r = 0
            while e.size:
                k = ptr[e] + r
                alive = k < ptr[e + 1]
                if not alive.all():
                    raise ValueError("a prefix has no encoding; the vocabulary's merges are not consistent")
                p, size = piece[k], length[k]
                before = last[e - size]
                free = (size == base) | (before == unk)
                ok = free.copy()
                if not free.all():
                    f = ~free
                    ok[f] = self.compatible(before[f], p[f])
                last[e[ok]], back[e[ok]] = p[ok], size[ok]
                e = e[~ok]
                r += 1
        # paths from the ends of the units
        e = first + lens
        steps, owner = [], []
        live = np.arange(len(units))
        while live.size:
            steps.append(last[e[live]])
            owner.append(np.stack([live, e[live]]))
            e[live] -= back[e[live]]
            live = live[e[live] > first[live]]
        tok = np.concatenate(steps) if steps else np.empty(0, np.int64)
        own = np.concatenate(owner, axis=1) if owner else np.empty((2, 0), np.int64)
        o = np.argsort(own[1], kind="stable")
        tok, own = tok[o], own[:, o]
        bad = np.flatnonzero(tok == unk)
        if bad.size:
            char = np.zeros(n, np.int64)
            char[stop] = raw
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in char[own[1][bad]]]
            reps = np.ones(len(tok), np.int64)
            reps[bad] = [len(s) for s in spelled]
            where = np.cumsum(reps) - reps
            tok, unit_of = np.repeat(tok, reps), np.repeat(own[0], reps)
            ids = np.concatenate([self.v.byte_id[np.frombuffer(s, np.uint8)] for s in spelled])
            spots = np.repeat(where[bad], reps[bad]) + np.arange(len(ids)) - np.repeat(np.cumsum(reps[bad]) - reps[bad], reps[bad])
            tok[spots] = ids
        else:
            unit_of = own[0]
        base = len(self.index)
        for k, u in enumerate(units):
            self.index[u] = base + k
        total = self.ends[-1][-1]
        self.flat.append(tok.astype(np.int32))
        self.ends.append(total + np.cumsum(np.bincount(unit_of, minlength=len(units))))

    # ---- texts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one row, offsets of the texts in it)."""
        if len(self.index) > CACHE_UNITS:
            self.clear()
        find, units = self.unit.findall, []
        counts = np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            if t:
                u = find((SPACE if self.v.prefix else "") + t.replace(" ", SPACE))
                units += u
                counts[k + 1] = len(u)
        index = self.index
        new = list(dict.fromkeys(u for u in units if u not in index))
        if new:
            self._new(new)
        self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        ends, flat = self.ends[0], self.flat[0]
        at = np.fromiter(map(index.__getitem__, units), np.int64, len(units))
        lo, size = ends[at], ends[at + 1] - ends[at]
        offs = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(offs[-1]) - np.repeat(offs[:-1], size) + np.repeat(lo, size)] if len(at) else np.empty(0, np.int32)
        return ids, offs[np.cumsum(counts)]


class Decoder:
    def __init__(self, v: Vocabulary) -> None:
        self.table = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds)]
        self.prefix = v.prefix

    def decode(self, ids: np.ndarray) -> str:
        t = self.table
        s = b"".join([t[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return s[1:] if self.prefix and s[:1] == " " else s


def _per_worker(shared) -> tuple[Encoder, Decoder]:
    v = shared.value
    if not hasattr(v, "_tools"):
        v._tools = (Encoder(v), Decoder(v))
    return v._tools


def _pieces(col: pa.Array) -> Iterator[tuple[int, int]]:
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    end, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + BATCH_CHARS, "right")))
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, path: str = MODEL, text: str = "text") -> DataFrame:
    """docs with last columns ids (array of int) and round_trip (the ids decode to the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # bounded by the vocabulary
    n = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what an earlier stage has left in a worker that is used again
        enc, dec = _per_worker(shared)
        for whole in batches:
            for lo, hi in _pieces(whole.column(n)):
                b = whole.slice(lo, hi - lo)
                texts = b.column(n).to_pylist()
                ids, offs = enc.encode(texts)
                same = [dec.decode(ids[i:j]) == (t or "") for i, j, t in zip(offs[:-1], offs[1:], texts)]
                cols = [*b.columns, pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "ids", "round_trip"])

    return docs.mapInArrow(run, docs.select("*", F.array(F.lit(0)).alias("ids"), F.lit(True).alias("round_trip")).schema)


def decode(encoded: DataFrame, path: str = MODEL, ids: str = "ids") -> DataFrame:
    """encoded with a last column decoded, the text of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    n = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dec = _per_worker(shared)
        for b in batches:
            out = pa.array([dec.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(n)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("decoded")).schema)
