import random
import zlib

import numpy as np
import pyarrow as pa

from factorlake.llm.toxicity import drop_toxic, features, fit, toxicity

from .fixtures import AWKWARD, SCHEMA

BAD = ["trashy", "loathsome", "vermin", "scumbag", "idiotic"]


def table(n=500, seed=4):
    rnd = random.Random(seed)
    vocab = ["word%d" % i for i in range(800)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.2
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        docs.append((i, " ".join(w), "en", "s", 1))
        if rnd.random() < 0.6:
            labels.append((i, 1, int(toxic)))
        docs[-1] = (*docs[-1], toxic)
    return docs, labels


def test_held_out_accuracy_and_defined_cases(spark):
    docs, labels = table()
    truth = {d[0]: d[5] for d in docs}
    data = [d[:5] for d in docs] + [(10_000 + i, t, None, None, None) for i, t in enumerate(AWKWARD)] + [(None, "trashy vermin", None, None, None)] * 2
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "0 as score", "1 as predicted", "2 as __id")
    got = toxicity(df, lab).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    right = sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.93
    assert all(r.predicted == 0 for r in got if r.doc_id in (10_000, 10_001, 10_002))
    kept = {r.doc_id for r in drop_toxic(df, lab).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = table(200)
    df = spark.createDataFrame([d[:5] for d in docs], SCHEMA)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in (labels, flip))
    assert a == b


def test_empty_and_no_positives(spark):
    docs, _ = table(30)
    df = spark.createDataFrame([d[:5] for d in docs], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity(df, none).collect()} == {0.0}
    assert toxicity(df.limit(0), none).count() == 0


def test_risk_never_negative():
    rng = np.random.default_rng(1)
    rows = list(features(pa.array([" ".join(rng.choice(["a1", "b2", "c3", "d4"], 6)) for _ in range(60)])))
    m = fit(rows[:10], rows[10:], 0.5, epochs=50, lift=0.1)
    assert min(m.history) >= 0 and m.history[-1] <= m.history[0]
