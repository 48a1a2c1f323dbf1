"""Fits by conjugate gradients against dense solves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoplane.plans import gp, iterative, models
from isoplane.sources.models import ModelStore
from isoplane.spec import AnalysisSpec, KernelConfig

KERNELS = [KernelConfig(constant=1.3), KernelConfig(kernel_type="matern", nu=0.5), KernelConfig(kernel_type="matern", nu=1.5),
           KernelConfig(kernel_type="matern", nu=2.5, white_noise=True, noise_level=0.01), KernelConfig(kernel_type="rq", rq_alpha=0.7)]

CASES = [(KERNELS[0], False), (KERNELS[1], True), (KERNELS[2], False), (KERNELS[3], True), (KERNELS[3], False), (KERNELS[4], True)]


def data(n, seed=1, width=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * 2
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] + rng.normal(0, 0.2, n)
    return x, (y - y.mean()) / y.std(), rng.uniform(0.01, 0.2, n), rng.integers(1, 9, n).astype(float)


@pytest.mark.parametrize("kernel, rows", CASES)
def test_fit_equals_the_factored_one(spark, kernel, rows):
    x, y, noise, counts = data(300)
    given = dict(noise=0.05, counts=counts, within=3.0) if rows else dict(noise=noise)
    want = gp.solve(kernel, x, y, y_mean=0.2, y_scale=1.5, **given)
    got = iterative.solve_iterative(spark, kernel, x, y, y_mean=0.2, y_scale=1.5, rank=30, **given)
    at = data(40, 9)[0]
    for a, b, tolerance in zip(gp.evaluate(got, at), gp.evaluate(want, at), (1e-6, 1e-4)):
        assert a == pytest.approx(b, abs=tolerance)
    assert got.lml == pytest.approx(want.lml, rel=0.02, abs=8.0)
    whole = iterative.solve_iterative(spark, kernel, x, y, y_mean=0.2, y_scale=1.5, rank=300, **given)
    assert whole.lml == pytest.approx(want.lml, rel=1e-6, abs=1e-4)


@pytest.mark.parametrize("kernel, rows", CASES)
def test_gradient_is_the_dense_one(spark, kernel, rows):
    x, y, noise, counts = data(200)
    given = (0.05, counts, 3.0) if rows else (noise, None, 0.0)
    _, want = gp.likelihood_slope(kernel, x, y, *given)
    *_, got = iterative.fit(spark, kernel, x, y, *given, rank=60, probes=200, gradient=True)
    assert got == pytest.approx(want, abs=0.05 * np.abs(want).max() + 0.5)


def test_many_blocks(spark, monkeypatch):
    """Products over several blocks of rows against a dense factor."""
    monkeypatch.setattr(iterative, "ROWS", 256)
    kernel = KernelConfig(kernel_type="matern", nu=1.5)
    x, y, noise, _ = data(1_500, 4)
    lower = np.linalg.cholesky(gp.kernel_block(kernel.params(2), x, x) + np.diag(noise))
    weights = np.linalg.solve(lower.T, np.linalg.solve(lower, y))
    lml = -0.5 * y @ weights - np.log(np.diag(lower)).sum() - 750 * np.log(2 * np.pi)
    got = iterative.solve_iterative(spark, kernel, x, y, noise)
    at = data(10, 6)[0]
    k = gp.kernel_block(kernel.params(2), at, x)
    mean, std = gp.evaluate(got, at)
    half = np.linalg.solve(lower, k.T)
    assert mean == pytest.approx(k @ weights, abs=1e-6)
    assert std == pytest.approx(np.sqrt(1 - (half * half).sum(0)), abs=1e-4)
    assert got.lml == pytest.approx(lml, rel=0.05)


def test_no_noise_and_repeated_points(spark):
    """Noise of zero is raised to a share of the amplitude; equal points with noise are no problem."""
    x = np.repeat(np.linspace(-1, 1, 6), 3)[:, None]
    y = np.sin(2 * x[:, 0])
    kernel = KernelConfig()
    got = iterative.solve_iterative(spark, kernel, x, y, np.zeros(18))
    assert gp.evaluate(got, x)[0] == pytest.approx(y, abs=1e-3)
    one = iterative.solve_iterative(spark, kernel, x[:1], y[:1], np.array([0.1]))
    assert gp.evaluate(one, x[:1])[0] == pytest.approx(y[:1] / 1.1)


def test_steps_run_out(spark):
    x, y, noise, _ = data(50)
    a = gp.kernel_block(KernelConfig().params(2), x, x) + np.diag(noise)
    with pytest.raises(ValueError, match="did not converge in 2 steps"):
        gp.conjugate_gradients(lambda v: a @ v, lambda v: v, y[:, None], 1e-9, 2)


def test_model_by_iteration(spark, tmp_path):
    """As a method of the model: same table as the factored fit, tuned, limited, stored."""
    df = spark.range(600).select(
        (F.col("id") % 23 / 7.0).alias("a"), (F.col("id") % 13 / 3.0).alias("b"),
        (F.sin(F.col("id") % 23 / 7.0) + F.col("id") % 13 / 20.0 + F.col("id") % 7 / 30.0).alias("y"))
    spec = AnalysisSpec(("a", "b"), "y", mode="mean")
    kernel = KERNELS[2]
    exact = models.fit_model(df, spec, kernel, tune=False)
    fitted = models.fit_model(df, spec, kernel, tune=False, method="iterative", solver_options={"rank": 20})
    assert fitted.method == "iterative" and len(fitted.solution.points) == 299
    both = models.predict_rows(exact, models.predict_rows(fitted, df), mean="m", std="s").select("pred_mean", "pred_std", "m", "s").toPandas()
    assert both.pred_mean.to_numpy() == pytest.approx(both.m.to_numpy(), abs=1e-5)
    assert both.pred_std.to_numpy() == pytest.approx(both.s.to_numpy(), abs=1e-4)
    tuned = models.fit_model(df, spec, kernel, method="iterative", solver_options={"rank": 299, "probes": 4}, search_options={"max_steps": 8})
    assert tuned.solution.lml > exact.solution.lml
    with pytest.raises(ValueError, match="more than max_points, 100"):
        models.fit_model(df, spec, kernel, tune=False, method="iterative", max_points=100)
    store = ModelStore(str(tmp_path), "t")
    store.save(fitted)
    again = store.load(spark, "mean")
    assert np.allclose(gp.evaluate(again.solution, fitted.solution.points[:5]), gp.evaluate(fitted.solution, fitted.solution.points[:5]))
