"""Least squares against numpy."""
import numpy as np
import pytest

from terrapanel.operators.linear import NormalLinear, pivoted_solve
from terrapanel.operators.models import assemble, load_models, save_model


def frame(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), None if v is None else float(v)) for r, v in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", label double")
    return assemble(df.repartition(3), names)


def test_equals_numpy(spark, tmpdir_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [1, 100, 0.01, 1] + [0, 1e6, 5, 0]
    y = x @ [2.0, -0.5, 30.0, 0.0] + 7 + rng.normal(size=300)
    df = frame(spark, x, y)
    model = NormalLinear().fit(df)
    want, *_ = np.linalg.lstsq(np.column_stack([x - x.mean(0), np.ones(300)]), y, rcond=None)
    assert model.getOrDefault("coefficients") == pytest.approx(want[:4].tolist(), rel=1e-6)
    got = {r.f0: r.prediction for r in model.transform(df).collect()}
    assert [got[v] for v in x[:, 0]] == pytest.approx((np.column_stack([x - x.mean(0), np.ones(300)]) @ want).tolist(), rel=1e-6)
    save_model(model, f"{tmpdir_path}/m/linear")
    assert load_models(spark, f"{tmpdir_path}/m")["linear"].getOrDefault("coefficients") == model.getOrDefault("coefficients")


def test_collinear_and_constant_columns_get_zero(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=200), rng.normal(size=200)
    x = np.column_stack([a, 2 * a - 3, np.full(200, 1234.5), b, a + b])
    y = 3 * a - b + 1
    model = NormalLinear().fit(frame(spark, x, y))
    c = np.array(model.getOrDefault("coefficients"))
    assert (c != 0).sum() == 2 and c[2] == 0
    assert np.allclose(x @ c + model.getOrDefault("intercept"), y)


def test_missing_values_and_no_rows(spark):
    x = np.array([[1.0, 2.0], [2.0, 1.0], [3.0, 5.0], [4.0, 4.0], [np.nan, 1.0], [9.0, 9.0]])
    df = frame(spark, x, [3.0, 3.0, 8.0, 8.0, 100.0, None])
    model = NormalLinear().fit(df)
    assert model.getOrDefault("coefficients") == pytest.approx([1.0, 1.0]) and model.getOrDefault("intercept") == pytest.approx(0.0)
    with pytest.raises(ValueError):
        NormalLinear().fit(df.limit(0))


def test_solve_of_a_singular_matrix():
    g = np.array([[2.0, 2.0, 0.0], [2.0, 2.0, 0.0], [0.0, 0.0, 0.0]])
    assert pivoted_solve(g, np.array([4.0, 4.0, 0.0])).tolist() == pytest.approx([2.0, 0.0, 0.0])
