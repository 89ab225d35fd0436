import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factorlake.llm.elias_fano import EliasFano
from factorlake.llm.lm_score import DISCOUNT, lm_scores, pack, unpack

from .fixtures import SCHEMA, rows


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(1)
    cases = [rng.integers(0, 2**62, 5000), rng.integers(0, 300, 4000), np.zeros(70, np.int64), np.arange(1000), np.array([2**62]), np.empty(0, np.int64), np.repeat(rng.integers(0, 2**40, 20), 90)]
    for k, v in enumerate(cases):
        v = np.sort(v).astype(np.uint64)
        EliasFano.build(v).save(f"{tmp_path}/{k}")
        e = EliasFano.load(f"{tmp_path}/{k}")
        if len(v):
            assert (e.access(np.arange(len(v))) == v).all()
        q = np.unique(np.concatenate([v, v + np.uint64(1), rng.integers(0, 2**62, 50).astype(np.uint64), [np.uint64(0)]]))
        assert (e.successor(q) == np.searchsorted(v, q)).all()
        assert (e.find(q)[1] == np.isin(q, v)).all()
    assert EliasFano.build(np.sort(rng.integers(0, 2**30, 100_000))).nbytes() < 100_000 * 2.3


def test_pack():
    k, c = np.array([3, 900, 2**60], np.uint64), np.array([1, 300, 2])
    a, b = unpack(*pack(k, c))
    assert (a == k).all() and (b == c).all()


def toks(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(data, order, d=DISCOUNT):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in data}
    c, grams = Counter(), Counter()
    for i, t, *_ in data:
        if not held[i]:
            w = toks(t)
            c.update(w)
            led = [None, *w]
            for n in range(2, order + 1):
                grams.update(tuple(led[k : k + n]) for k in range(len(led) - n + 1))
    n, v = sum(c.values()), len(c)
    total, fol = Counter(), Counter()
    for g, k in grams.items():
        total[g[:-1]] += k
        fol[g[:-1]] += 1

    def p(ctx, x):
        if not ctx:
            return (c[x] + 1) / (n + v + 1)
        low = p(ctx[1:], x)
        t = c[ctx[0]] if len(ctx) == 1 else total[ctx]
        return max(grams[*ctx, x] - d, 0) / t + d * fol[ctx] / t * low if t else low

    out = {}
    for i, t, *_ in data:
        w = toks(t)
        led = [None, *w]
        out[i] = (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w), sum(math.log10(p(tuple(led[max(0, k + 2 - order) : k + 1]), x)) for k, x in enumerate(w)))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_matches_brute_force(spark, order):
    data = rows(150)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as score", "2 as n_tokens").repartition(5)
    want = brute(data, order)
    for size in (1 << 30, 2000):  # one and several shards, split contexts
        got = {r.doc_id: tuple(r)[1:] for r in lm_scores(df, shard_bytes=size, order=order).collect()}
        assert got.keys() == want.keys()
        for i, w in want.items():
            assert got[i][:4] == w[:4]
            assert abs(got[i][4] - w[4]) < 1e-6 * max(1, abs(w[4]))
            assert -2e-4 * order * w[1] < got[i][5] - w[5] < 1e-6 * w[1] + 1e-9, (i, got[i], w)


def test_null_and_repeated_ids(spark):
    data = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b d"), (None, None)]
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in lm_scores(spark.createDataFrame(data, "doc_id long, text string")).collect())
    held = {x: zlib.crc32(x.encode()) % 7 == 2 for x in ("", "5")}
    trained = [t or "" for i, t in data if not held["" if i is None else str(i)]]
    n = sum(len(t.split()) + 1 for t in trained)
    assert [g[3] for g in got] == [n] * 5 and sorted(g[1] for g in got) == [1, 4, 4, 4, 4]


def test_empty_and_all_held_out(spark):
    df = spark.createDataFrame(rows(20), SCHEMA)
    assert lm_scores(df.limit(0)).count() == 0
    one = [r for r in rows(60) if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    got = lm_scores(spark.createDataFrame(one, SCHEMA)).collect()
    assert len(got) == len(one) and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 == r.base_score for r in got)
