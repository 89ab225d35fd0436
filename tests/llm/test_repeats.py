import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factorlake.llm.repeats import BlindTrie, anchors, deep_shallow, repeats

from .fixtures import SCHEMA, rows


def brute(data, length):
    raw = [(i, (t or "").encode()) for i, t, *_ in data]
    seen = Counter(r[s : s + length] for _, r in raw for s in range(len(r) - length + 1))
    out = []
    for i, r in raw:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(r, gone) if not g)
        out.append((i, len(r), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(8)
    data = rows(60, seed=2, words=30)
    passage = "".join(rnd.choice("abcde \x00é") for _ in range(300))
    for i in range(40):
        a, b = sorted(rnd.sample(range(len(passage)), 2))
        t = "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 200))) + passage[a:b] + "".join(rnd.choice("uvw ") for _ in range(rnd.randint(0, 99)))
        data.append((2000 + i, t * rnd.choice([1, 1, 2]), "en", "s", 1))
    return data


@pytest.mark.parametrize("length,hot", [(50, 10**9), (50, 3), (50, 1), (13, 2), (13, 10**9), (400, 10**9)])
def test_matches_brute_force(spark, length, hot):
    data = corpus()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as t1", "2 as k1", "3 as spans").repartition(4)
    got = sorted((tuple(r)[:5] for r in repeats(df, length=length, gram=max(3, length // 6), hot=hot).collect()), key=str)
    assert got == brute(data, length)


def test_repeated_rows_null_ids_and_empty(spark):
    t = "abcdefghij" * 30
    df = spark.createDataFrame([(1, t), (1, t), (None, "q" + t), (2, None)], "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed) for r in repeats(df, length=100).collect()], key=str)
    assert got == sorted([(1, 300, 300), (1, 300, 300), (None, 301, 300), (2, 0, 0)], key=str)
    assert repeats(df.limit(0)).count() == 0


def test_many_rows_of_one_id_and_text(spark):
    rnd = random.Random(5)
    t = "".join(rnd.choice("abcdefgh ") for _ in range(1090))
    rest = [(k + 10, t[:700] + str(k)) for k in range(60)] + [(None, t), (7, t[:399])]
    df = spark.createDataFrame([(1, t)] * 10_000 + rest, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r)[:5] for r in repeats(df, hot=8).collect())
    want = Counter(dict.fromkeys(brute([(1, t)] * 2 + rest, 400), 1))
    assert got == want | {next(x for x in want if x[0] == 1): 10_000}


def test_anchors_of_long_rows_cover_every_window():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, (1 << 20) + 5000).astype(np.uint8)
    data[3000:9000] = 97
    row, p, lo, hi, _ = anchors(data, np.array([0, len(data)]))
    seen = np.zeros(len(data), bool)
    for a, b in zip(lo, hi):
        seen[a : b + 1] = True
    assert seen[: len(data) - 399].all() and not seen[len(data) - 399 :].any()
    assert ((p >= hi) & (p + 48 <= lo + 400)).all()


def test_deep_shallow_sorts():
    rng = np.random.default_rng(3)
    rows_ = rng.integers(0, 3, (400, 96)).astype(np.uint8)
    rows_[100:300, :80] = rows_[100, :80]
    rows_[310:320] = rows_[310]
    order, lcp = deep_shallow(rows_.copy(), shallow=16)
    s = [rows_[i].tobytes() for i in order]
    assert s == sorted(s)
    assert [next((k for k in range(96) if a[k] != b[k]), 96) for a, b in zip(s, s[1:])] == lcp[1:].tolist()
    trie = BlindTrie(rows_)
    for i in range(400):
        trie.add(i)
    assert [rows_[i].tobytes() for i in trie.order()] == s
