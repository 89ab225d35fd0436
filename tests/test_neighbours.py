import numpy as np

from factorlake.operators import neighbours
from factorlake.operators.assess import assess, silhouette
from factorlake.operators.neighbours import distances, knn


def test_equal_vectors_of_a_large_reference_side():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(62_600, 64))  # over 4,000,000 numbers
    x = np.vstack([y[:40], y[40:60] + 1e-9])
    d = distances(x, y, "euclidean")
    assert np.isfinite(d).all() and (d[np.arange(40), np.arange(40)] == 0).all()
    assert (d.argmin(axis=1) == np.arange(60)).all() and np.allclose(d[np.arange(40, 60), np.arange(40, 60)], 8e-9, rtol=1e-3)


def test_blocks_do_not_change_distances():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(37, 5)), rng.normal(size=(53, 5))
    want = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    for values in (1, 5, 60, 1000, 10**6):
        assert (distances(x, y, "euclidean", values) == want).all()


def test_copies_are_found_through_the_blocked_path(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=(31_400, 128))  # over 4,000,000 numbers
    y[31_300:] = y[:100]
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, x array<double>")
    got = knn(refs.where("id < 100"), refs, 1).collect()
    assert {(r.id, r.other, r.dist) for r in got} == {(i, 31_300 + i, 0.0) for i in range(100)}


def test_shuffled_blocks_give_the_broadcast_side_s_answer(spark):
    rng = np.random.default_rng(9)
    y = np.round(rng.normal(size=(300, 4)), 1)  # many ties
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, x array<double>")
    queries = refs.where("id % 3 = 0")
    for metric in ("euclidean", "cosine"):
        one, many = (sorted(map(tuple, knn(queries, refs, 5, metric, ref_values=values).collect())) for values in (10**6, 90))
        assert len(one) == 500
        assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many]
        assert np.allclose([r[2] for r in one], [r[2] for r in many], atol=1e-12)
    assert knn(queries, refs.where("id < 0"), 5).count() == 0


def test_products_leave_ties_and_near_pairs_as_they_are(monkeypatch):
    rng = np.random.default_rng(3)
    y = np.round(rng.normal(size=(200, 3)), 1) * 1e-7 + 1.0  # squared differences are lost in products
    ids, own = np.arange(200) * 3, np.arange(0, 600, 7)
    x = np.concatenate([y[:40], rng.normal(size=(46, 3))])
    monkeypatch.setattr(neighbours, "TILE", (16, 30))
    for metric in ("euclidean", "cosine"):
        a, b, d, rank = neighbours._best(own, x, ids, y, 6, metric, True)
        want = distances(x, y, metric)
        want[own[:, None] == ids[None, :]] = np.inf
        assert (rank.reshape(-1, 6) == np.arange(1, 7)).all() and np.allclose(d.reshape(-1, 6), np.sort(want, axis=1)[:, :6], rtol=1e-9, atol=1e-15)
        if metric == "euclidean":
            assert (b.reshape(-1, 6) == np.argsort(want, axis=1, kind="stable")[:, :6]).all()


def test_silhouette_takes_all_members_of_a_class(spark):
    rng = np.random.default_rng(8)
    x, label = np.concatenate([rng.normal(size=(450, 3)), np.zeros((1, 3))]), np.append(np.arange(450) % 2, 2)
    x[:250] = np.round(x[:250], 0)  # many equal ones
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    means = np.stack([d[:, label == c].mean(axis=1) for c in range(3)], axis=1)
    a = means[np.arange(451), label]
    means[np.arange(451), label] = np.inf
    b = means.min(axis=1)
    want = (b - a) / np.maximum(a, b)
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    lab = spark.createDataFrame([(i, str(c)) for i, c in enumerate(label)], "id long, label string")
    for values in (10**6, 400):
        got = silhouette(emb, lab, ref_values=values).toPandas().sort_values("id")
        assert np.allclose(got["s"], want, atol=1e-12) and list(got["label"]) == [str(c) for c in label]
    value = assess(emb, lab, metrics=("silhouette",))["value"][0]  # the class of one sample is left out
    two = silhouette(emb, lab.where("label <> '2'")).toPandas()["s"]
    assert abs(value - two.mean()) < 1e-12


def test_assessment_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)) + np.arange(60)[:, None] % 2)], "id long, x array<double>")
    lab = emb.selectExpr("id", "cast(id % 2 as string) as label")
    one = assess(emb, lab, metrics=("silhouette", "knn"), n_folds=2, k_nn=3)
    monkeypatch.setattr(knn, "__defaults__", (*knn.__defaults__[:-1], 50))
    monkeypatch.setattr(silhouette, "__defaults__", (*silhouette.__defaults__[:-1], 50))
    many = assess(emb, lab, metrics=("silhouette", "knn"), n_folds=2, k_nn=3)
    assert list(one["metric"]) == list(many["metric"]) and np.allclose(one["value"], many["value"])
