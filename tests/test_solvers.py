import itertools
import math

import numpy as np
import pytest

from factorlake.functions.losses import Loss, values, weights
from factorlake.functions.rng import held_out, r_binom, r_sample, r_sparsematrix, uniform
from factorlake.operators.solve import average_linkage, bipartite_match, cophenetic_correlation, cut_tree, hungarian, nnls, nnls_each


@pytest.mark.parametrize("seed", range(5))
def test_nnls_satisfies_the_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    w, b0 = rng.random((30, 5)), rng.normal(size=(30, 12))
    g, b = w.T @ w, w.T @ b0
    x = nnls(g, b)
    grad = g @ x - b
    assert (x >= 0).all() and (grad[x > 1e-9].__abs__() < 1e-5).all() and (grad[x == 0] > -1e-6).all()
    assert np.allclose(nnls_each(np.repeat(g[None], 12, 0), b.T), x.T, atol=1e-6)
    assert (nnls(g, b, upper=0.05) <= 0.05).all()
    assert np.allclose(nnls(g, b, nonneg=False, sweeps=5000, tol=1e-12), np.linalg.solve(g, b), atol=1e-5)
    assert (nnls(g, b, "cholesky") >= 0).all()


def test_hungarian_against_all_permutations():
    rng = np.random.default_rng(1)
    for n, m in ((4, 4), (3, 6), (6, 3), (1, 1), (5, 5)):
        c = rng.random((n, m))
        a = c if n <= m else c.T
        best = min(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
        assert abs(hungarian(c)[1] - best) < 1e-9
    assert bipartite_match([[-5.0, 1.0], [1.0, 2.0]])["cost"] == 2.0


def test_linkage():
    x = np.array([0.0, 0.1, 5.0, 5.2, 9.0])
    d = np.abs(x[:, None] - x[None, :])
    m = average_linkage(d)
    assert cut_tree(m, 3).tolist() == [1, 1, 2, 2, 3] and cut_tree(m, 1).tolist() == [1] * 5
    assert 0.8 < cophenetic_correlation(m, d) <= 1


def test_losses_have_their_least_value_at_the_observation():
    y = np.array([0.5, 1.0, 4.0, 20.0])
    for name in ("mse", "mae", "huber", "kl", "gamma", "inverse_gaussian", "tweedie"):
        at = values(y, y, Loss(name))
        for f in (0.7, 1.4):
            assert (values(y, y * f, Loss(name)) > at - 1e-12).all(), name
        assert (weights(y, y, Loss(name)) > 0).all()
    nb = values(np.array([3.0]), np.array([2.0]), Loss("nb", size=5.0))[0]
    want = -(math.lgamma(8) - math.lgamma(5)) - 5 * math.log(5 / 7) - 3 * math.log(2 / 7)
    assert abs(nb - want) < 1e-9
    with pytest.raises(ValueError):
        Loss("no such loss")


def test_random_numbers_are_functions_of_their_index():
    i, j = np.meshgrid(np.arange(300), np.arange(200))
    a = held_out(7, i, j, 0.1)
    assert (a == held_out(7, i, j, 0.1)).all() and 0.09 < a.mean() < 0.11
    assert abs(uniform(3, np.arange(20000)).mean() - 0.5) < 0.01
    assert sorted(r_sample(10).tolist()) == list(range(10))
    assert (r_binom(50, 10, 1.0) == 10).all() and (r_sparsematrix(20, 20, 0.0) == 0).all()
