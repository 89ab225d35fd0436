import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import cluster, dispersion, passes
from factorlake.operators import graph as G
from factorlake.operators.assess import auc
from factorlake.operators.cluster import bipartition, connectivity, consensus_nmf, dclust, split_dense, tree_table
from factorlake.operators.guide import refine, target
from factorlake.operators.models import NMF
from factorlake.operators.nmf import Config, Fit, auto_rank, nmf, nnls_fit, project
from factorlake.operators.passes import factor_frame
from factorlake.operators.simulate import simulate_nmf, simulate_swimmer
from factorlake.operators.solve import hungarian
from factorlake.operators.svd import METHODS, pca, svd
from factorlake.sources.matrix import MatrixFrame
from factorlake.streaming.projection import OnlineNMF, project_stream

BOTH = pytest.mark.parametrize("local", [10**9, 0], ids=["driver", "tasks"])


@pytest.fixture(scope="module")
def planted(spark):
    return simulate_nmf(spark, 30, 40, 3, noise=0.02, dropout=0.0, seed=5)


def full(f):
    return (f.w * f.d) @ f.h_numpy().T


@BOTH
def test_recovers_planted_factors(spark, planted, local):
    a, w, _ = planted
    f = nmf(a, 3, maxit=60, tol=1e-8, local_nnz=local)
    c = np.corrcoef(f.w.T, w.T)[:3, 3:]
    _, cost = hungarian(1 - c)
    assert cost / 3 < 0.1
    assert np.allclose(f.w.sum(axis=0), 1) and np.allclose(f.h_numpy().sum(axis=0), 1, atol=1e-6)
    x = a.to_numpy()
    assert abs(((x - full(f)) ** 2).sum() - f.misc["loss"]) < 1e-6 * (x**2).sum() + 1e-9
    assert abs(f.evaluate(a) * x.size - f.misc["loss"]) < 1e-6 * (x**2).sum() + 1e-9


def test_driver_and_tasks_agree(spark, planted):
    a = planted[0]
    for kw in ({}, {"loss": "kl"}, {"mask": "zeros"}, {"test_fraction": 0.1}, {"l1": (0.0, 0.01), "l2": (0.1, 0.0)}):
        x, y = (nmf(a, 2, maxit=4, local_nnz=n, tol=0.0, **kw) for n in (10**9, 0))
        assert np.allclose(x.misc["train_loss"], y.misc["train_loss"]), kw
        assert np.allclose(x.w, y.w), kw


def test_missing_and_masked_entries_are_not_fitted(spark, planted):
    x = planted[0].to_numpy()
    y = x.copy()
    y[2, 3], y[5, 6] = np.nan, np.nan
    f = nmf(MatrixFrame.from_numpy(spark, y), 3, maxit=40)
    assert abs(full(f)[2, 3] - x[2, 3]) < 0.5 * x.mean()
    z = x.copy()
    z[2, 3] = 1000 * x.max()
    mask = spark.createDataFrame([(2, 3)], "i long, j long")
    g = nmf(MatrixFrame.from_numpy(spark, z), 3, maxit=40, mask=mask)
    assert abs(full(g)[2, 3] - x[2, 3]) < 0.5 * x.mean()


def test_configuration_errors():
    for bad in ({"k": 0}, {"l1": 1.0}, {"l2": -1}, {"test_fraction": 1.0}, {"norm": "L3"}, {"solver": "cholesky", "loss": "kl"}, {"zi": "both"}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(TypeError):
        nmf(None, 2, no_such=1)


def test_model_methods(spark, planted):
    a = planted[0]
    f = nmf(a, 3, maxit=10)
    assert f.shape == (30, 40, 3) and f["w"] is f.w and f.LOSS_TYPE == "mse" if hasattr(f, "LOSS_TYPE") else True
    assert np.allclose(f.factors([2, 0]).d, f.d[[2, 0]]) and np.allclose(f.t().w, f.h_numpy())
    rec = f.reconstruct().toPandas()
    out = np.zeros((30, 40))
    out[rec["i"], rec["j"]] = rec["v"]
    assert np.allclose(out, full(f))
    g = f.factors([2, 0, 1])
    assert np.allclose(g.align(f).w, f.w)
    h = np.zeros((40, 3))
    p = f.predict(a).toPandas()
    h[p["j"]] = np.stack(p["h"])
    assert (h >= 0).all() and ((a.to_numpy() - f.w @ h.T) ** 2).sum() <= f.misc["loss"] * 1.001
    by_h = nnls_fit(a, h=f.h_numpy()).toPandas()
    assert len(by_h) == 30


@BOTH
@pytest.mark.parametrize("method", [m for m in METHODS if m not in ("auto", "deflation")])
def test_svd_against_numpy(spark, method, local):
    x = np.random.default_rng(1).random((18, 25))
    x[x < 0.5] = 0
    a = MatrixFrame.from_numpy(spark, x)
    s = svd(a, 4, method=method, local_nnz=local)
    assert np.allclose(s.d, np.linalg.svd(x, compute_uv=False)[:4], atol=1e-4)
    assert np.allclose(s.v_numpy().T @ s.v_numpy(), np.eye(4), atol=1e-5)


def test_pca_scale_deflation_and_constraints(spark):
    x = np.random.default_rng(3).random((10, 16))
    a = MatrixFrame.from_numpy(spark, x)
    c = x - x.mean(axis=1, keepdims=True)
    assert np.allclose(pca(a, 3).d, np.linalg.svd(c, compute_uv=False)[:3])
    z = c / x.std(axis=1, keepdims=True)
    s = pca(a, 10, scale=True)
    assert np.allclose(s.d, np.linalg.svd(z, compute_uv=False)[:10], atol=1e-6)
    rec = s.reconstruct().toPandas()
    out = np.zeros_like(x)
    out[rec["i"], rec["j"]] = rec["v"]
    assert np.allclose(out, x, atol=1e-6)
    assert np.allclose(svd(a, 3, method="deflation", maxit=2000, tol=1e-12).d, np.linalg.svd(x, compute_uv=False)[:3], atol=1e-3)
    n = svd(a, 2, nonneg=True)
    assert n.u.min() >= 0 and n.v_numpy().min() >= 0
    with pytest.raises(ValueError):
        svd(a, 2, method="lanczos", l1=0.1)


def test_splits_and_trees(spark):
    rng = np.random.default_rng(0)
    x = np.zeros((6, 40))
    for c in range(4):
        x[c, c * 10 : (c + 1) * 10] = 5
    x += rng.random(x.shape) * 0.1
    s = split_dense(x)
    assert s.size0 + s.size1 == 40 and all(len(set(s.cluster[c * 10 : (c + 1) * 10])) == 1 for c in range(4))
    leaves = dclust(MatrixFrame.from_numpy(spark, x), min_samples=5).toPandas()
    assert leaves["size"].sum() == 40 and sorted(sum((list(v) for v in leaves["samples"]), [])) == list(range(40))
    assert tree_table(dclust(MatrixFrame.from_numpy(spark, x), min_samples=5))["size"].max() == 40
    c = consensus_nmf(MatrixFrame.from_numpy(spark, x.T), 4, reps=3, maxit=15)
    assert len(set(c.clusters)) == 4 and c.summary()["max"] <= 1


def test_graphs(spark, planted):
    a = planted[0]
    one = G.factor_input(a, "a")
    r = G.fit(G.factor_net(one, G.nmf_layer(one, 3, name="only"), G.GraphConfig(maxit=10)))
    assert np.allclose(r["only"].w, nmf(a, 3, maxit=10).w)
    both = nmf({"x": a, "y": a}, 2, maxit=5)
    assert {k: v.shape for k, v in both.modalities["L1"].items()} == {"x": (30, 2), "y": (30, 2)}
    first = G.nmf_layer(one, 4, G.H(l1=0.01), name="first")
    net = G.factor_net(one, G.nmf_layer(first, 2, name="second"), G.GraphConfig(outer=2, init_iterations=4))
    deep = G.fit(net)
    assert deep["second"].shape == (4, 40, 2) and deep.predict(a).count() == 40
    l, m = G.nmf_layer(one, 2, name="l"), G.nmf_layer(one, 2, name="m")
    z = spark.range(40).select(F.col("id").alias("j"), F.array(F.lit(1.0)).alias("z"))
    for node, rows in ((G.factor_concat(l, m), 4), (G.factor_add(l, m), 2), (G.factor_condition(l, z, 1), 3)):
        out = G.fit(G.factor_net(one, G.nmf_layer(node, 1, name="top"), G.GraphConfig(outer=1, init_iterations=3)))
        assert out["top"].w.shape == (rows, 1)
    with pytest.raises(ValueError):
        G.factor_net([one, G.factor_input(a, "unused")], first)
    log = G.TrainingLogger()
    nmf(a, 2, maxit=3, on_iteration=log)
    assert len(log.to_pandas()) == 3
    table, best = G.cross_validate_graph(lambda p: G.factor_net(one, G.nmf_layer(one, p["k"]), G.GraphConfig(maxit=4)), {"k": [1, 3]})
    assert best["k"] == 3 and len(table) == 2


def test_targets_and_refinement(spark, planted):
    f = nmf(planted[0], 3, maxit=10)
    labels = spark.range(40).select(F.col("id").alias("j"), F.when(F.col("id") > 2, (F.col("id") % 2).cast("string")).alias("label"))
    t = target(f.h, labels, 3).toPandas().set_index("j")["t"]
    assert np.allclose(t[0], 0) and np.allclose(np.asarray(t[3]) + np.asarray(t[4]), 0, atol=1e-12)
    out = refine(f, planted[0], labels, cycles=2, whiten=True)
    assert out.h.count() == 40 and out.h_numpy().min() >= 0


def test_cross_validation_finds_the_rank(spark):
    a, _, _ = simulate_nmf(spark, 30, 40, 2, noise=0.1, dropout=0.0, seed=3)
    t = nmf(a, [1, 2, 5], maxit=30, test_fraction=0.15, cv_seeds=[1]).toPandas().set_index("k")["test_mse"]
    assert t[2] < t[1]
    f, table = auto_rank(a, Config(maxit=15))
    assert f.k in table["k"].tolist()


def test_other_losses_zero_inflation_and_swimmer(spark):
    rng = np.random.default_rng(4)
    x = rng.poisson(rng.random((15, 3)) @ rng.random((3, 25)) * 4).astype(float)
    a = MatrixFrame.from_numpy(spark, x)
    for kw in ({"loss": "kl"}, {"loss": "gp"}, {"loss": "nb"}, {"loss": "mae"}, {"robust": True}):
        h = nmf(a, 2, maxit=15, **kw).misc["train_loss"]
        assert np.isfinite(h).all() and h[-1] <= h[0] * 1.001, kw
    z = nmf(a, 2, maxit=4, loss="nb", zi="col")
    assert z.misc["pi_col"].shape == (25,)
    s, limbs = simulate_swimmer(spark, 8)
    assert s.m == 1024 and limbs.shape == (8, 4)


def test_online_updates_once_a_batch(spark, planted):
    a, w, _ = planted
    o = OnlineNMF(w + 0.01)
    first = o.update(a, 1).copy()
    assert np.allclose(o.update(a, 1), first) and (first >= 0).all()
    m = NMF(first, np.ones(3), project(a, first), 40)
    assert m.evaluate(a) < a.to_numpy().var()
    assert factor_frame(spark, first).count() == 30


def test_online_updates_go_on_after_a_restart(spark, planted, tmp_path):
    a, w, _ = planted
    for part in range(2):
        a.entries.where(f"j % 2 = {part}").withColumn("j", F.col("j") + 10**12).coalesce(1).write.parquet(f"{tmp_path}/in{part}")
    stream = lambda: spark.readStream.schema("i long, j long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    whole, seen = OnlineNMF(w + 0.01), []
    whole.attach(stream(), 30, f"{tmp_path}/c1", lambda _, batch: seen.append(batch)).awaitTermination()
    assert seen == [0, 1] and (whole.last, whole.saved) == (1, 2)
    again = OnlineNMF(w + 5.0, path=f"{tmp_path}/c1_sums")
    assert again.restore(spark) and (again.last, again.saved) == (1, 2)
    assert np.array_equal(again.w, whole.w) and np.array_equal(again.b, whole.b) and np.array_equal(again.gram, whole.gram)
    spark.read.parquet(f"{tmp_path}/c1_sums/0").limit(5).toPandas().to_parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{tmp_path}/part.parquet").write.mode("overwrite").parquet(f"{tmp_path}/c1_sums/0")  # cut off while it was written
    older = OnlineNMF(w + 5.0, path=f"{tmp_path}/c1_sums")
    assert older.restore(spark) and older.last == 0
    assert not OnlineNMF(w, path=f"{tmp_path}/none").restore(spark)
    with pytest.raises(ValueError):
        OnlineNMF(w[:5], path=f"{tmp_path}/c1_sums").restore(spark)


def test_projection_of_a_stream_keeps_large_ids(spark, planted, tmp_path):
    a, w, _ = planted
    a.entries.withColumn("j", F.col("j") * 10**10 + 7).write.parquet(f"{tmp_path}/in")
    project_stream(spark.readStream.schema("i long, j long, v double").parquet(f"{tmp_path}/in"), w, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {r.j: r.h for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.j * 10**10 + 7: r.h for r in project(a, w).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[j], want[j]) for j in want)


def test_auc_with_distinct_scores_and_ties(spark):
    rng = np.random.default_rng(4)
    for score in (rng.normal(size=500), rng.integers(0, 9, 500).astype(float)):
        pos = rng.random(500) < 0.3
        df = spark.createDataFrame([(i, float(s), bool(p)) for i, (s, p) in enumerate(zip(score, pos))], "id long, score double, positive boolean")
        d = score[pos][:, None] - score[~pos][None, :]
        assert abs(auc(df).first()[0] - ((d > 0) + (d == 0) / 2).mean()) < 1e-12
        order = np.lexsort((np.arange(500), -score))
        above = np.cumsum(pos[order])[~pos[order]].sum()
        assert abs(auc(df, midrank=False).first()[0] - above / (pos.sum() * (~pos).sum())) < 1e-12


def test_a_given_h_is_fitted_in_tasks(spark, planted):
    a, h = planted[0], np.random.default_rng(2).random((40, 2))
    here, there = (nmf(a, 2, maxit=2, tol=0.0, h_init=h, local_nnz=n) for n in (10**6, 0))
    assert np.allclose(here.w, there.w) and np.allclose(here.d, there.d)


def test_masks_stay_with_the_samples_in_tasks(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((7, 23)) < 0.6, rng.random((7, 23)), 0.0)
    x[2, 3] = np.nan
    a = MatrixFrame.from_numpy(spark, x)
    mask = spark.createDataFrame([(i, j) for i in range(7) for j in range(23) if (i * 3 + j) % 5 == 0] * 2 + [(1, 99)], "i long, j long")
    for what in (mask, ("zeros", mask)):
        here = nmf(a, 2, maxit=3, tol=0.0, mask=what, local_nnz=10**6)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(passes, "PART_VALUES", 5)
            there = nmf(a, 2, maxit=3, tol=0.0, mask=what, local_nnz=0)
            assert isinstance(Fit(a, Config(k=2, mask=what, local_nnz=0)).plan.mask, bool)  # nothing of the mask's length on the driver
        assert np.allclose(here.w, there.w) and np.allclose(here.d, there.d) and np.allclose(here.h_numpy(), there.h_numpy())
        held = [nmf(a, 2, maxit=3, tol=0.0, mask=what, test_fraction=0.2, local_nnz=n) for n in (10**6, 0)]
        assert np.allclose(held[0].misc["test_history"], held[1].misc["test_history"])


def test_splits_in_tasks_and_pairs_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.where(rng.random((6, 40)) < 0.7, rng.random((6, 40)), 0.0)
    x[:3, :15] += 3
    want = split_dense(x)
    for nnz in (10**6, 0):  # a matrix over the driver's bound was an error
        s = bipartition(MatrixFrame.from_numpy(spark, x), local_nnz=nnz)
        assert (s.cluster == want.cluster).all() and s.iterations == want.iterations and (s.samples == np.arange(40)).all()
        assert np.allclose(s.v, want.v) and np.allclose(s.center0, want.center0) and np.allclose(s.center1, want.center1) and np.isclose(s.dist, want.dist)
    some = [3, 1, 20, 39, 5, 22]
    s, want = bipartition(MatrixFrame.from_numpy(spark, x), some, local_nnz=0), split_dense(x[:, some])
    assert (s.cluster == want.cluster).all() and (s.samples == np.array(some)).all()
    rows = [(r, i, (i * r) % 4 if i % 7 else None) for r in range(1, 4) for i in range(0, 90, 2)] + [(1, 4, 0), (2, 6, 12), (2, 8, 12)]
    assign = spark.createDataFrame(rows, "rep long, i long, cluster long")
    monkeypatch.setattr(cluster, "PAIR_ROWS", 50)
    one, two = (sorted(map(tuple, connectivity(assign, 3, held).collect())) for held in (10**6, 0))
    assert one == two and len(one) > 400


def test_expected_zeros_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((9, 30)) < 0.3, 2.0, 0.0)
    a, w, h = MatrixFrame.from_numpy(spark, x), rng.random((9, 2)), rng.random((30, 2))
    p = np.exp(-(w * np.array([2.0, 3.0])) @ h.T)
    row = np.maximum(((x == 0).sum(axis=1) - p.sum(axis=1)) / 30, 0)
    col = np.maximum(((x == 0).sum(axis=0) - p.sum(axis=0)) / 9, 0)
    model = NMF(w, np.array([2.0, 3.0]), factor_frame(spark, h), 30)
    for held in (4, 27, 10**6):
        monkeypatch.setattr(dispersion, "ZERO_VALUES", held)
        z = dispersion.zero_inflation(a, model)
        assert np.isclose(z["excess"], row.mean()) and np.isclose(z["row_variance"], row.var(ddof=1)) and np.isclose(z["col_variance"], col.var(ddof=1))


def test_trees_do_not_depend_on_where_clusters_are_split(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((6, 60)) < 0.8, rng.random((6, 60)), 0.0)
    for c in range(4):
        x[c, c * 15 : (c + 1) * 15] += 4
    x[:, 7] = 0.0  # a sample without entries
    a = MatrixFrame.from_numpy(spark, x)

    def tree(path: str, cols: np.ndarray) -> dict:
        s = split_dense(x[:, cols], calc_dist=False) if len(cols) >= 8 else None
        if s is None or min(s.size0, s.size1) < 4:
            return {path: cols.tolist()}
        return tree(path + "0", cols[s.cluster == 0]) | tree(path + "1", cols[s.cluster == 1])

    want = tree("", np.arange(60))
    assert len(want) > 3
    for task, whole in ((10**6, 10**6), (10**6, 0), (100, 60)):
        got = {r["id"]: r for r in dclust(a, min_samples=4, task_entries=task, tree_entries=whole).collect()}
        assert {k: list(r["samples"]) for k, r in got.items()} == want
        assert all(np.allclose(r["center"], x[:, want[k]].mean(axis=1)) for k, r in got.items())
