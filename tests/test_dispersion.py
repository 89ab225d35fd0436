import numpy as np
import pytest

from factorlake.operators.nmf import nmf
from factorlake.sources.matrix import MatrixFrame


def counts(size, m=40, n=60, seed=1):
    rng = np.random.default_rng(seed)
    mu = rng.gamma(2, 1, (m, 2)) @ rng.gamma(2, 1, (2, n))
    return rng.poisson(mu if size is None else rng.gamma(size, mu / size)).astype(float)


@pytest.fixture(scope="module")
def wide(spark):
    return MatrixFrame.from_numpy(spark, counts(2.0))


def test_nb_size_follows_the_data(spark, wide):
    by_mode = {x: nmf(wide, 2, loss="nb", maxit=15, dispersion=x).misc for x in ("per_row", "global")}
    assert by_mode["per_row"]["size"].shape == (40,) and (by_mode["per_row"]["size"] >= 0.01).all()
    assert len(set(by_mode["global"]["size"])) == 1 and 0.5 < by_mode["global"]["size"][0] < 8
    poisson = nmf(MatrixFrame.from_numpy(spark, counts(None)), 2, loss="nb", maxit=15, dispersion="global").misc["size"][0]
    assert poisson > 5 * by_mode["global"]["size"][0]
    assert "size" not in nmf(wide, 2, loss="nb", maxit=5, dispersion="none").misc
    assert np.isfinite(nmf(wide, 2, loss="nb", maxit=5, dispersion="per_col").misc["loss"])


def test_gp_theta_modes(spark, wide):
    by_mode = {x: nmf(wide, 2, loss="gp", maxit=10, dispersion=x).misc for x in ("per_row", "global")}
    assert (by_mode["per_row"]["theta"] >= 0).all() and (by_mode["per_row"]["theta"] <= 5).all() and by_mode["per_row"]["theta"].max() > 0
    assert len(set(by_mode["global"]["theta"])) == 1
    assert "theta" not in nmf(wide, 2, loss="gp", maxit=5, dispersion="none").misc
    assert np.isfinite(nmf(wide, 2, loss="gp", maxit=5, dispersion="per_col").misc["loss"])


@pytest.mark.parametrize("kw", [{"loss": "nb", "dispersion": "per_row"}, {"loss": "gp", "dispersion": "global"}, {"loss": "gamma", "dispersion": "per_row"}, {"l21": (0.1, 0.2)}, {"mask": "zeros"}, {"test_fraction": 0.2}, {"loss": "nb", "dispersion": "per_col"}])
def test_tasks_and_driver_agree(wide, kw):
    a, b = (nmf(wide, 3, maxit=4, tol=0.0, local_nnz=x, **kw) for x in (10**9, 0))
    assert np.allclose(a.w, b.w, atol=1e-5) and np.allclose(a.d, b.d, rtol=1e-4) and np.allclose(a.h_numpy(), b.h_numpy(), atol=1e-5)
    for x in ("size", "theta", "phi"):
        assert (x in a.misc) == (x in b.misc) and (x not in a.misc or np.allclose(a.misc[x], b.misc[x], rtol=1e-3))


def test_l21_on_h_empties_factors(spark):
    rng = np.random.default_rng(42)
    a = MatrixFrame.from_numpy(spark, np.abs(rng.normal(1, 0.5, (60, 80))))
    plain, heavy = (nmf(a, 4, maxit=60, tol=1e-6, l21=(0.0, x)) for x in (0.0, 0.5))
    zero = lambda f: (np.linalg.norm(f.h_numpy(), axis=1) < 0.01).sum()
    assert zero(heavy) >= zero(plain) and not np.allclose(plain.w, heavy.w)


def test_start_from_h_and_symmetric(spark):
    rng = np.random.default_rng(3)
    w, h = rng.random((30, 3)), rng.random((40, 3))
    a = MatrixFrame.from_numpy(spark, w @ h.T)
    for start in (h, h.T):
        assert nmf(a, 3, maxit=1, h_init=start).misc["loss"] < 1e-6 * a.to_numpy().__pow__(2).sum()
    with pytest.raises(ValueError):
        nmf(a, 3, h_init=h[:, :2])
    s = nmf(MatrixFrame.from_numpy(spark, w @ w.T), 3, maxit=200, tol=1e-9, symmetric=True)
    assert np.allclose(s.h_numpy(), s.w)
