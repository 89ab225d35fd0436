import numpy as np
import pytest

from factorlake.sources import store
from factorlake.sources.matrix import MatrixFrame


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(2)
    a = np.round(rng.random((12, 20)) * 9, 2)
    a[rng.random(a.shape) < 0.6] = 0
    a[3], a[:, 5] = 0, 0
    return a


def test_round_trip_and_slices(spark, x, tmp_path):
    a = MatrixFrame.from_numpy(spark, x)
    assert np.allclose(a.to_numpy(), x) and np.allclose(a.t().to_numpy(), x.T)
    assert np.allclose(a.slice([4, 1, 4], [0, 19]).to_numpy(), x[[4, 1, 4]][:, [0, 19]])
    with pytest.raises(IndexError):
        a.slice(rows=[12])
    path = f"file://{tmp_path}/m"
    obs = spark.createDataFrame([(i, f"g{i}", i % 2 == 0) for i in range(12)], "i long, gene string, even boolean")
    head = store.write(MatrixFrame(a.entries, 12, 20, obs), path, include_transpose=True, chunk_cols=6)
    assert head["nnz"] == (x != 0).sum() and head["has_transpose"] and head["has_obs"] and not head["has_var"]
    assert np.allclose(store.read(spark, path).to_numpy(), x)
    assert np.allclose(store.read(spark, path, [7, 2]).to_numpy(), x[:, [7, 2]])
    assert np.allclose(store.slice_rows(spark, path, [9, 0]).to_numpy(), x[[9, 0]])
    assert np.allclose(store.read_transpose(spark, path).to_numpy(), x.T)
    assert np.allclose(store.read(spark, path).filter_rows("even").to_numpy(), x[::2])
    with pytest.raises(ValueError):
        store.read(spark, path).filter_rows("gene = 'none'")
    assert store.read_var(spark, path).count() == 0 and store.read_obs(spark, path).count() == 12
    assert store.chunk_ranges(20, 6) == [(1, 6), (7, 12), (13, 18), (19, 20)]


def test_statistics_cover_empty_rows_and_columns(spark, x):
    a = MatrixFrame.from_numpy(spark, x)
    c = a.column_stats().orderBy("j").toPandas()
    assert np.allclose(c["mean"], x.mean(axis=0)) and np.allclose(c["sd"], x.std(axis=0)) and (c["zeros"] == (x == 0).sum(axis=0)).all()
    assert np.allclose(a.row_stats().orderBy("i").toPandas()["total"], x.sum(axis=1))


def test_binding_precision_and_missing(spark, x, tmp_path):
    a = MatrixFrame.from_numpy(spark, x)
    assert np.allclose(MatrixFrame.cbind([a, a]).to_numpy(), np.hstack([x, x]))
    assert np.allclose(MatrixFrame.rbind([a, a]).to_numpy(), np.vstack([x, x]))
    with pytest.raises(ValueError):
        MatrixFrame.cbind([a, a.t()])
    for precision, tol in (("float", 1e-6), ("fp16", 1e-2), ("quant8", 0.02)):
        path = f"file://{tmp_path}/{precision}"
        store.write(a, path, precision=precision)
        assert np.abs(store.read(spark, path).to_numpy() - x).max() <= tol, precision
    y = x.copy()
    y[0, 0], y[1, 1] = np.nan, -1
    assert MatrixFrame.from_numpy(spark, y).validate() == {"nnz": int(((y != 0) | np.isnan(y)).sum()), "missing": 1, "negative": 1}


def test_readers(spark, x, tmp_path):
    (tmp_path / "a.csv").write_text("name," + ",".join(f"c{j}" for j in range(20)) + "\n" + "\n".join(f"r{i}," + ",".join(map(str, r)) for i, r in enumerate(x)))
    a = store.load(spark, f"{tmp_path}/a.csv")
    assert np.allclose(a.to_numpy(), x) and a.row_names.count() == 12
    i, j = np.nonzero(x)
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n" + f"12 20 {len(i)}\n" + "\n".join(f"{p + 1} {q + 1} {x[p, q]}" for p, q in zip(i, j)))
    assert np.allclose(store.load(spark, f"{tmp_path}/a.mtx").to_numpy(), x)
    with pytest.raises(ValueError):
        store.load(spark, "a.xyz")
    with pytest.raises(ImportError):
        store.load(spark, f"{tmp_path}/a.h5")


def test_keys_become_dense_numbers(spark):
    df = spark.createDataFrame([("b", 7, 1.0), ("a", 3, 2.0), ("b", 3, 4.0), ("b", 7, 1.0)], "r string, c long, v double")
    a = MatrixFrame.from_keys(df, "r", "c", "v")
    assert np.allclose(a.to_numpy(), [[2, 0], [4, 2]])
    assert [r.name for r in a.row_names.orderBy("i").collect()] == ["a", "b"]


def test_duplicates_are_summed(spark):
    a = MatrixFrame.from_long(spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i long, j long, v double"))
    assert a.to_numpy().tolist() == [[3.0]]
