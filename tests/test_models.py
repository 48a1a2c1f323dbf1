"""Fits against a dense row-level reference written out in numpy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from isoplane.functions.kernels import kernel_block, kernel_column, kernel_profile, squared_distance
from isoplane.plans import blocks, frames, gp, models, scoring, sparse
from isoplane.plans.search import candidate_frame, score_candidates, search
from isoplane.sources.models import ModelStore
from isoplane.spec import AnalysisSpec, KernelConfig

KERNELS = [KernelConfig(), KernelConfig(kernel_type="matern", nu=0.5), KernelConfig(kernel_type="matern", nu=1.5, constant=2.0),
           KernelConfig(kernel_type="matern", nu=2.5, white_noise=True, noise_level=0.01),
           KernelConfig(kernel_type="rq", rq_alpha=0.7)]


def dense_kernel(k, a, b):
    scale = np.broadcast_to(k.length_scale, a.shape[1])
    d = np.sqrt((((a[:, None] - b[None]) / scale) ** 2).sum(-1))
    base = {"rbf": lambda: np.exp(-d ** 2 / 2), "rq": lambda: (1 + d ** 2 / (2 * k.rq_alpha)) ** -k.rq_alpha,
            "matern": lambda: {0.5: np.exp(-d), 1.5: (1 + 3 ** 0.5 * d) * np.exp(-3 ** 0.5 * d),
                               2.5: (1 + 5 ** 0.5 * d + 5 * d ** 2 / 3) * np.exp(-5 ** 0.5 * d)}[k.nu]}[k.kernel_type]()
    return base if k.white_noise else k.constant * base


def dense_fit(k, x, y, alpha, at):
    """Mean, std and likelihood of a GP on all rows, target normalised."""
    white = k.noise_level if k.white_noise else 0.0
    m, s = y.mean(), y.std() or 1.0
    t = (y - m) / s
    K = dense_kernel(k, x, x) + np.diag(np.broadcast_to(alpha + white, len(x)))
    ks = dense_kernel(k, at, x)
    mean = ks @ np.linalg.solve(K, t)
    var = (1.0 if k.white_noise else k.constant) + white - np.einsum("ij,ji->i", ks, np.linalg.solve(K, ks.T))
    lml = -0.5 * t @ np.linalg.solve(K, t) - 0.5 * np.linalg.slogdet(K)[1] - len(x) / 2 * np.log(2 * np.pi)
    return mean * s + m, np.sqrt(np.maximum(var, 0)) * s, lml


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 160
    out = pd.DataFrame({"a": rng.integers(0, 5, n) * 1.5, "b": 10.0 ** rng.integers(0, 3, n), "c": rng.choice(["u", "v"], n)})
    out["y"] = np.sin(out.a) + 0.3 * np.log10(out.b) + (out.c == "u") * 0.5 + rng.normal(0, 0.2, n) + 5
    return out


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5).cache()


def scale(v):
    return (v - v.mean()) / (v.std(ddof=0) or 1.0)


def design_matrix(pdf):
    return np.column_stack([scale(pdf.a), scale(np.log10(pdf.b)), pdf.c == "u", pdf.c == "v"]).astype(float)


ROW = AnalysisSpec(("a", "b"), "y", ("c",), mode="mean", log_cols=("b",))
REP = AnalysisSpec(("a", "b"), "y", ("c",), mode="std", log_cols=("b",), noise="sem")


@pytest.mark.parametrize("kernel", KERNELS)
def test_row_model_equals_the_dense_fit(df, pdf, kernel):
    model = models.fit_model(df, ROW, kernel, tune=False)
    x, y = design_matrix(pdf), scale(pdf.y).to_numpy()
    mean, std, lml = dense_fit(kernel, x, y, 0.05, x)
    got = models.predict_rows(model, df, unscale=False).toPandas().sort_values(["a", "b", "c", "y"])
    order = pdf.sort_values(["a", "b", "c", "y"]).index
    assert got.pred_mean.to_numpy() == pytest.approx(mean[order], abs=1e-7)
    assert got.pred_std.to_numpy() == pytest.approx(std[order], abs=1e-6)
    assert model.solution.lml == pytest.approx(lml, rel=1e-9)
    row = models.training_metrics(model, df, digits=None).first()
    assert row.r2 == pytest.approx(1 - ((y - mean) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row.mae == pytest.approx(np.abs(y - mean).mean()) and row.rmse == pytest.approx(np.sqrt(((y - mean) ** 2).mean()))


def summary(pdf):
    p = pdf.assign(y=scale(pdf.y), a=scale(pdf.a), b=scale(np.log10(pdf.b)), u=(pdf.c == "u") * 1.0, v=(pdf.c == "v") * 1.0)
    g = p.groupby(["a", "b", "u", "v"]).y.agg(["mean", "std", "count"]).reset_index()
    return g[g["count"] >= 2].reset_index(drop=True)


@pytest.mark.parametrize("statistic, noise", [("mean", "sem"), ("std", "std"), ("mean", "constant")])
def test_replicate_model(df, pdf, statistic, noise):
    kernel = KERNELS[2]
    spec = AnalysisSpec(("a", "b"), "y", ("c",), mode="std", statistic=statistic, log_cols=("b",), noise=noise)
    model = models.fit_model(df, spec, kernel, tune=False)
    g = summary(pdf)
    x, y = g[["a", "b", "u", "v"]].to_numpy(), g[statistic].to_numpy()
    alpha = {"std": g["std"] ** 2, "sem": g["std"] ** 2 / g["count"], "constant": 0.05 + 0 * g["std"]}[noise].to_numpy()
    mean, _, lml = dense_fit(kernel, x, y, alpha, x)
    assert model.solution.lml == pytest.approx(lml)
    row = models.training_metrics(model, digits=None).first()
    assert row.rmse == pytest.approx(np.sqrt(((y - mean) ** 2).mean()))


def test_sparse_is_exact_with_every_point(df):
    for spec in (ROW, REP):
        exact = models.fit_model(df, spec, KERNELS[2], tune=False)
        every = models.fit_model(df, spec, KERNELS[2], tune=False, method="sparse", inducing=500)
        assert every.solution.grow is not None
        assert every.solution.lml == pytest.approx(exact.solution.lml, abs=1e-5)
        a, b = (models.predict_rows(m, df).orderBy("a", "b", "c", "y").toPandas() for m in (exact, every))
        assert b.pred_mean.to_numpy() == pytest.approx(a.pred_mean.to_numpy(), abs=1e-6)
        assert b.pred_std.to_numpy() == pytest.approx(a.pred_std.to_numpy(), abs=1e-5)


def test_sparse_is_close_with_fewer_points(df):
    exact = models.fit_model(df, ROW, KERNELS[0], tune=False)
    few = models.fit_model(df, ROW, KERNELS[0], tune=False, method="sparse", inducing=20)
    assert (exact.method, few.method) == ("exact", "sparse") and len(few.solution.points) == 20
    assert few.solution.lml <= exact.solution.lml + 1e-6
    with pytest.raises(ValueError, match="more than max_support, 5"):
        models.fit_model(df, ROW, KERNELS[0], tune=False, max_support=5)
    with pytest.raises(ValueError, match="inducing must be between"):
        models.fit_model(df, ROW, KERNELS[0], tune=False, method="sparse", max_support=5, inducing=20)


def test_search_improves_and_repeats(df):
    start = models.fit_model(df, REP, KERNELS[2], tune=False)
    tuned = models.fit_model(df, REP, KERNELS[2])
    assert tuned.solution.lml > start.solution.lml
    assert models.fit_model(df.repartition(3), REP, KERNELS[2]).kernel.scales(4) == pytest.approx(tuned.kernel.scales(4))
    bounds = KERNELS[2].length_scale_bounds
    assert all(bounds[0] - 1e-9 <= s <= bounds[1] + 1e-9 for s in tuned.kernel.scales(4))
    few = models.fit_model(df, ROW, KERNELS[2], method="sparse", inducing=200)
    assert few.solution.lml > models.fit_model(df, ROW, KERNELS[2], tune=False).solution.lml


def test_start_outside_the_bounds_is_clipped(spark):
    x = np.linspace(-1, 1, 8)[:, None]
    kernel = KernelConfig(length_scale=1.0, length_scale_bounds=(2.0, 10.0))
    best, lml = search(spark, kernel, x, np.sin(3 * x[:, 0]), 0.01 * np.ones(8), n=8, starts=2)
    assert 2.0 <= best.length_scale <= 10.0 and np.isfinite(lml)
    first = candidate_frame(spark, [0.5, 0.0], [(0.0, 1.0), (-1.0, 1.0)], 8, 1).toPandas()
    assert len(first) == 9 and first.candidate_id.tolist() == list(range(9))


def test_block_models(spark, pdf):
    g = pdf.groupby(["c", "a"]).y.agg(["mean", "std", "count"]).reset_index()
    df = spark.createDataFrame(g)
    with pytest.raises(ValueError, match="more than max_support, 3"):
        blocks.block_models(df, "c", ["a"], "mean", KERNELS[2], noise="sem", max_support=3)
    for method in ("exact", "sparse"):
        with pytest.raises(ValueError, match="missing inputs, values or noise"):
            blocks.block_models(df.withColumn("std", F.when(F.col("a") > df.agg(F.min("a")).first()[0], F.col("std"))),
                                "c", ["a"], "mean", KERNELS[2], noise="sem", method=method)
    for options in ({}, {"method": "sparse", "inducing": 50}):
        got = blocks.block_models(df, "c", ["a"], "mean", KERNELS[2], noise="sem", **options).toPandas()
        for c, block in g.groupby("c"):
            x = block[["a"]].to_numpy()
            mean, std, lml = dense_fit(KERNELS[2], x, block["mean"].to_numpy(), (block["std"] ** 2 / block["count"]).to_numpy(), x)
            mine = got[got.c == c].sort_values("a")
            assert mine.fit_mean.to_numpy() == pytest.approx(mean, abs=1e-6)
            assert mine.fit_std.to_numpy() == pytest.approx(std, abs=1e-5)
            assert mine.lml.iloc[0] == pytest.approx(lml, abs=1e-5)


def test_curves(df, pdf):
    model = models.fit_model(df, ROW, KERNELS[2], tune=False)
    curve = frames.curve_1d(model, "b", n=50).toPandas()
    assert curve.combo.unique().tolist() == ["All", "c=u", "c=v"] and set(curve.label) == {"y"}
    assert curve[curve.combo_id == 0].x.to_numpy() == pytest.approx(np.geomspace(1, 100, 50))
    assert ((curve["mean"] >= curve.lower) & (curve["mean"] <= curve.upper)).all()
    x = np.column_stack([np.full(50, (pdf.a.median() - pdf.a.mean()) / pdf.a.std(ddof=0)),
                         (np.linspace(0, 2, 50) - np.log10(pdf.b).mean()) / np.log10(pdf.b).std(ddof=0), np.ones(50), np.zeros(50)])
    mean, std, _ = dense_fit(KERNELS[2], design_matrix(pdf), scale(pdf.y).to_numpy(), 0.05, x)
    sd = pdf.y.std(ddof=0)
    mine = curve[curve.combo == "c=u"].sort_values("point_id")
    assert mine["mean"].to_numpy() == pytest.approx(mean * sd + pdf.y.mean(), abs=1e-6)
    assert mine.upper.to_numpy() == pytest.approx((mean + 1.96 * std) * sd + pdf.y.mean(), abs=1e-5)
    scatter = frames.scatter_1d(model, "b", df).toPandas()
    assert len(scatter) == 2 * len(pdf) and (scatter.combo == "c=u").sum() == (pdf.c == "u").sum()
    with pytest.raises(ValueError, match="not a numeric input"):
        frames.curve_1d(model, "c")


def test_spread_curves_follow_the_flag(df, pdf):
    spec = AnalysisSpec(("a",), "y", mode="std", statistic="std", noise="constant")
    model = models.fit_model(df, spec, KERNELS[2], tune=False)
    sd = pdf.y.std(ddof=0)
    plain, asked, moved = (frames.curve_1d(model, "a", 20, **o).orderBy("point_id").toPandas()["mean"].to_numpy()
                           for o in ({}, {"unscale_std": True}, {"unscale_std": True, "shift": True}))
    assert asked == pytest.approx(plain * sd) and moved == pytest.approx(plain * sd + pdf.y.mean())
    both = frames.pair_curves(frames.curve_1d(model, "a", 20), frames.curve_1d(models.fit_model(df, ROW, KERNELS[2], tune=False), "a", 20))
    rows = both.toPandas()
    assert len(rows) == 60 and rows.std_mean.isna().sum() == 40


def test_surfaces(df, pdf):
    model = models.fit_model(df, REP, KERNELS[2], tune=False)
    plain = frames.surface_2d(model, "a", "b", n=12).orderBy("point_id").toPandas()
    unscaled = frames.surface_2d(model, "a", "b", n=12, unscale_std=True).orderBy("point_id").toPandas()
    assert len(plain) == 144
    assert unscaled["std"].to_numpy() == pytest.approx(plain["std"].to_numpy() * pdf.y.std(ddof=0))
    assert frames.surface_2d(model, "a", "b", n=4, floor=1e9).toPandas()["mean"].eq(1e9).all()
    assert frames.scatter_2d(model, "a", "b").count() == len(summary(pdf))


def test_both_models_share_one_summary(df):
    std, row = models.fit_both(df, REP, ROW, kernel={"std": KERNELS[2], "mean": KERNELS[0]}, tune=False)
    assert std.conditions is row.conditions
    assert (std.kernel, row.kernel) == (KERNELS[2], KERNELS[0])


def test_store(spark, df, tmp_path):
    store = ModelStore(str(tmp_path), "first")
    for spec, options in ((ROW, {}), (REP, {"method": "sparse", "inducing": 12})):
        model = models.fit_model(df, spec, KERNELS[2], tune=False, **options)
        store.save(model)
        loaded = store.load(spark, spec.mode)
        assert loaded.spec == model.spec and loaded.kernel == model.kernel
        a, b = (models.predict_rows(m, df).orderBy("a", "b", "c", "y").toPandas() for m in (model, loaded))
        pd.testing.assert_frame_equal(a, b)
        assert frames.curve_1d(loaded, "a", 5).count() == 15
    with pytest.raises(ValueError, match="no mean model stored"):
        ModelStore(str(tmp_path), "second").load(spark, "mean")


def test_scoring(df):
    model = models.fit_model(df, AnalysisSpec(("a", "b"), "y", mode="mean"), KernelConfig.design_default(), tune=False, constant=1e-6)
    scored = scoring.score_design(model, 200, {"a": (0, 6), "b": (1, 100)}, hi=5.0)
    pdf = scored.toPandas()
    assert (pdf.predicted == pdf.score.clip(0, 5.0)).all() and (pdf.upper_bound <= 5.0).all()
    assert pdf.lower_bound.to_numpy() == pytest.approx((pdf.score - 1.96 * pdf.uncertainty).clip(0, 5.0).to_numpy())
    ranked = scoring.sorted_scores(scored).orderBy("rank").toPandas()
    assert ranked.score.is_monotonic_increasing and ranked["rank"].tolist() == list(range(1, 201))
    top = scoring.top2_scatter(scored, ["a", "b"]).toPandas()
    assert top.is_best.sum() == 1 and top[top.is_best].score.iloc[0] == pdf.score.max()


def test_inputs_that_cannot_be_fitted(spark):
    rows = [(1.0, 2.0), (1.0, 3.0), (2.0, None), (2.0, 4.0), (None, 1.0), (3.0, 9.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    std = AnalysisSpec(("x",), "y", noise="std")
    with pytest.raises(ValueError, match="missing"):
        models.fit_model(df, std, tune=False)
    with pytest.raises(ValueError, match="missing"):
        models.fit_model(df, AnalysisSpec(("x",), "y", mode="mean"), tune=False)
    assert len(models.fit_model(df.where("x = 1 or x is null or x = 3"), std, tune=False).solution.points) == 1
    with pytest.raises(ValueError, match="fewer than two rows"):
        models.fit_model(df.where("x = 3"), std, tune=False)
    with pytest.raises(ValueError, match="not positive"):
        models.fit_model(df.na.fill(-1.0), AnalysisSpec(("x",), "y", log_cols=("x",)), tune=False)
    with pytest.raises(ValueError, match="missing columns"):
        models.fit_model(df, AnalysisSpec(("z",), "y"), tune=False)
    with pytest.raises(ValueError, match="noise must be"):
        gp.noise_column("other")


def test_missing_category_and_repeated_values(spark):
    rows = [("u", 1.0, 2.0), ("u", 1.0, 2.0), (None, 1.0, 3.0), (None, 1.0, 3.5), ("v", 2.0, 1.0), ("v", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    spec = AnalysisSpec(("x",), "y", ("c",), noise="std")
    model = models.fit_model(df, spec, KERNELS[0], tune=False)
    assert len(model.solution.points) == 3 and [c["label"] for c in model.combos] == ["c=nan", "c=u", "c=v"]
    assert models.training_frame(model).count() == 3
    flat = models.fit_model(df.withColumn("x", F.lit(7.0)), AnalysisSpec(("x",), "y", noise="constant"), KERNELS[0], tune=False)
    assert flat.scalers["x"] == (7.0, 1.0)


def test_predictions_with_a_missing_input_are_null(df):
    model = models.fit_model(df, ROW, KERNELS[0], tune=False)
    out = models.predict_rows(model, df.limit(1).withColumn("a", F.lit(None).cast("double"))).first()
    assert out.pred_mean is None and out.pred_std is None


def test_singular_matrices_get_jitter():
    lower, jitter = gp.cholesky(np.ones((4, 4)))
    assert jitter > 0 and np.isfinite(lower).all()


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.01, 1.0), st.integers(2, 6))
def test_collapse_identity(seed, noise, m):
    """n rows over m inputs and m collapsed points give the same model and likelihood."""
    rng = np.random.default_rng(seed)
    idx = np.concatenate([np.arange(m), rng.integers(0, m, 20)])
    base, y = rng.normal(size=(m, 2)), rng.normal(size=m + 20)
    kernel = KERNELS[2]
    mean, std, lml = dense_fit(kernel, base[idx], y, noise, base)
    t = (y - y.mean()) / y.std()
    counts = np.bincount(idx).astype(float)
    centre = np.bincount(idx, t) / counts
    within = ((t - centre[idx]) ** 2).sum()
    fitted = gp.solve(kernel, base, centre, noise, counts, within, 0.0, 1.0)
    got_mean, got_std = gp.evaluate(fitted, base)
    assert got_mean * y.std() + y.mean() == pytest.approx(mean, abs=1e-7)
    assert got_std * y.std() == pytest.approx(std, abs=1e-6)
    assert fitted.lml == pytest.approx(lml, abs=1e-6)


def test_kernel_columns_agree_with_blocks(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(6, 2)), rng.normal(size=(4, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double")
    for kernel in KERNELS:
        block = kernel_block(kernel.params(2), x, z)
        assert block == pytest.approx(dense_kernel(kernel, x, z))
        got = df.orderBy("i").select(kernel_profile(kernel, z.tolist())(F.struct("a", "b")).alias("k")).collect()
        assert np.array([r.k for r in got]) == pytest.approx(block)
        one = kernel_column(kernel, squared_distance([F.col("a"), F.col("b")], z[0].tolist(), kernel.scales(2)))
        assert [r.k for r in df.orderBy("i").select(one.alias("k")).collect()] == pytest.approx(block[:, 0])


def test_likelihood_candidates(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(12, 1)), rng.normal(size=12)
    frame = spark.createDataFrame([(i, [float(np.log(s)), 0.0]) for i, s in enumerate((0.5, 2.0))],
                                  "candidate_id long, theta array<double>")
    for r in score_candidates(frame, KERNELS[0], x, y, 0.1 * np.ones(12)).collect():
        t = (y - 0) / 1
        K = dense_kernel(KernelConfig(length_scale=float(np.exp(r.theta[0]))), x, x) + 0.1 * np.eye(12)
        assert r.lml == pytest.approx(-0.5 * t @ np.linalg.solve(K, t) - 0.5 * np.linalg.slogdet(K)[1] - 6 * np.log(2 * np.pi))


def test_condition_collapse(spark, df, pdf):
    got = gp.condition_collapse(df, ["a"], "y").orderBy("a").toPandas()
    g = pdf.groupby("a").y
    assert got["within"].to_numpy() == pytest.approx((g.var(ddof=0) * g.count()).to_numpy())
    assert got["noise"].to_numpy() == pytest.approx((0.05 / g.count()).to_numpy())


def test_gram_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(300, 2)), rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(v), 0.5) for r, v in zip(x, y)], "f0 double, f1 double, y double, noise double")
    z = x[:7]
    k = kernel_block(KERNELS[0].params(2), x, z)
    for parts in (1, 13):
        (gram, b, yy, log_noise, rows), = sparse.gram_sums(df.repartition(parts), ["f0", "f1"], z, [KERNELS[0].params(2)])
        assert gram == pytest.approx(2 * k.T @ k) and b == pytest.approx(2 * k.T @ y)
        assert (yy, log_noise, rows) == pytest.approx((2 * y @ y, 300 * np.log(0.5), 300))


def test_rows_need_no_collapse_for_inducing_points(df):
    options = {"tune": False, "method": "sparse", "inducing": 15}
    grouped = models.fit_model(df, ROW, KERNELS[2], **options)
    single = models.fit_model(df, ROW, KERNELS[2], collapse=False, **options)
    assert single.solution.lml == pytest.approx(grouped.solution.lml)
    assert single.solution.weights == pytest.approx(grouped.solution.weights, rel=1e-6)
    with pytest.raises(ValueError, match="collapse=False"):
        models.fit_model(df, REP, KERNELS[2], collapse=False, **options)


def test_inducing_points_are_the_smallest_hashes(spark):
    df = spark.range(5000).select((F.col("id") % 3000).cast("double").alias("f0"))
    got = sparse.choose_inducing(df, ["f0"], 40)
    want = df.distinct().orderBy(F.xxhash64("f0", F.lit(42))).limit(40).collect()
    assert got[:, 0].tolist() == [r.f0 for r in want]
    assert len(sparse.choose_inducing(df.limit(30), ["f0"], 40)) == 30
    hot = df.withColumn("f0", F.when(F.col("f0") > 20, 1.0).otherwise(F.col("f0")))
    assert len(sparse.choose_inducing(hot, ["f0"], 15)) == 15


def test_the_method_never_changes_with_the_size(spark):
    df = spark.range(2001).select((F.col("id") / 100).alias("a"), F.lit("u").alias("b"), F.lit("x").alias("c"),
                                  F.sin(F.col("id") / 100).alias("y"))
    spec = AnalysisSpec(("a",), "y", mode="mean")
    with pytest.raises(ValueError, match="2001 conditions, more than max_support, 2000"):
        models.fit_model(df, spec, KERNELS[0], tune=False)
    assert models.fit_model(df, spec, KERNELS[0], tune=False, max_support=2500).method == "exact"


def test_dropped_conditions_are_reported(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 1.0), (2.0, 1.5), (3.0, 1.0), (None, 1.0)], "a double, y double")
    spec = AnalysisSpec(("a",), "y", mode="std", noise="constant")
    with pytest.warns(UserWarning, match="1 conditions with a single row and 1 with missing inputs"):
        models.fit_model(df, spec, KERNELS[0], tune=False)


def test_a_search_that_runs_out_of_steps_warns(df):
    with pytest.warns(UserWarning, match="without converging"):
        models.fit_model(df, ROW, KERNELS[2], search_options={"max_steps": 3})


def test_ten_inputs_converge():
    from isoplane.plans.search import climb
    rng = np.random.default_rng(1)
    best = rng.uniform(-1, 1, 10)
    low, high = np.full(10, -2.0), np.full(10, 2.0)
    curve = np.arange(1, 11)
    theta, value, done = climb(lambda t: (-((t - best) ** 2 * curve).sum(), -2 * (t - best) * curve), np.zeros(10), low, high)
    assert done and np.abs(theta - best).max() < 1e-5


def test_white_noise_is_searched_in_one_pass_per_round(df, monkeypatch):
    passes = []
    real = sparse.gram_sums
    monkeypatch.setattr(sparse, "gram_sums", lambda *a, **k: passes.append(len(a[3])) or real(*a, **k))
    kernel = KernelConfig(white_noise=True, noise_level=0.1)
    models.fit_model(df, ROW, kernel, method="sparse", inducing=10, search_options={"rounds": 2})
    assert len(passes) <= 3 and passes[-1] == 1


def test_many_levels_fit(spark):
    rows = [(float(i % 7), f"level{i % 250:03d}", float(i % 13)) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, c string, y double")
    spec = AnalysisSpec(("a",), "y", cat_cols=("c",), mode="mean")
    with pytest.raises(ValueError, match="more than 200 levels"):
        models.fit_model(df, spec, KERNELS[0], tune=False)
    assert len(models.fit_model(df, spec, KERNELS[0], tune=False, max_levels=300, max_support=3000).levels["c"]) == 250


def test_scatter_meets_combinations_by_value(spark):
    import datetime
    import decimal
    stamps = [datetime.datetime(2024, 1, 1, 0, 0, 0, 250_000 * (k % 4)) for k in range(12)]
    cases = {"t timestamp": stamps, "s string": [None, "nan", "a, b=c", "x"] * 3, "b boolean": [True, False, None] * 4,
             "d decimal(10,2)": [decimal.Decimal(k % 3) for k in range(12)], "f double": [1e7, 0.1, 3.0] * 4,
             "day date": [datetime.date(2024, 1, 1 + k % 3) for k in range(12)]}
    for column, values in cases.items():
        name = column.split()[0]
        df = spark.createDataFrame([(float(k), v, float(k % 5)) for k, v in enumerate(values)], f"a double, {column}, y double")
        model = models.fit_model(df, AnalysisSpec(("a",), "y", cat_cols=(name,), mode="mean"), KERNELS[0], tune=False)
        drawn = frames.scatter_1d(model, "a", df).toPandas()
        assert len(drawn) == 24 and (drawn.combo == "All").sum() == 12, column
        assert (drawn[drawn.combo_id > 0].groupby("combo_id").size().sort_index().tolist()
                == [sum(v == c["values"][name] for v in values) for c in model.combos]), column


def test_search_reaches_the_optimum(spark):
    """Against a fine grid over both parameters; one optimum inside, one on a bound."""
    rng = np.random.default_rng(11)
    x = np.sort(rng.uniform(-2, 2, 25))[:, None]
    for y, bounds in ((np.sin(2 * x[:, 0]), (0.1, 10.0)), (np.sin(6 * x[:, 0]), (2.0, 10.0))):
        y = (y + rng.normal(0, 0.1, 25)) / 0.7
        kernel = KernelConfig(length_scale_bounds=bounds)
        best, lml = search(spark, kernel, x, y, 0.02 * np.ones(25))
        grid = max(gp.log_likelihood(KernelConfig(length_scale=a, constant=c).params(1), x, y, 0.02 * np.ones(25))[0]
                   for a in np.geomspace(*bounds, 60) for c in np.geomspace(1e-2, 1e2, 60))
        assert lml >= grid - 1e-6
        assert bounds[0] - 1e-9 <= best.length_scale <= bounds[1] + 1e-9


def test_inputs_named_like_our_own_columns(spark, pdf):
    """Features and targets may carry any name, spaces, dots and ours included."""
    plain = spark.createDataFrame(pdf)
    odd = plain.toDF("x", "y", "mean", "lambda max. (nm)")
    spec = AnalysisSpec(("x", "y"), "lambda max. (nm)", ("mean",), mode="mean", log_cols=("y",))
    for one, other in ((ROW, spec), (REP, AnalysisSpec(spec.num_cols, spec.target, spec.cat_cols, log_cols=("y",), noise="sem"))):
        a, b = models.fit_model(plain, one, KERNELS[2], tune=False), models.fit_model(odd, other, KERNELS[2], tune=False)
        assert a.solution.lml == pytest.approx(b.solution.lml)
        assert [tuple(r) for r in models.training_metrics(a, plain).collect()] == [tuple(r) for r in models.training_metrics(b, odd).collect()]
        ca, cb = frames.curve_1d(a, "b", 9).toPandas(), frames.curve_1d(b, "y", 9).toPandas()
        assert cb["mean"].to_numpy() == pytest.approx(ca["mean"].to_numpy())
        sa, sb = frames.surface_2d(a, "a", "b", 5).toPandas(), frames.surface_2d(b, "x", "y", 5).toPandas()
        assert sb["std"].to_numpy() == pytest.approx(sa["std"].to_numpy())
        assert frames.scatter_1d(b, "x", odd).count() == frames.scatter_1d(a, "a", plain).count()
        assert frames.scatter_2d(b, "x", "y", odd).columns == ["x", "y", "z"]
    counts = AnalysisSpec(("count", "std", "within"), "n_valid", mode="mean")
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.integers(0, 3, (40, 4))], "count double, std double, within double, n_valid double")
    model = models.fit_model(df, counts, KERNELS[0], tune=False)
    assert models.predict_rows(model, df).count() == 40 and frames.curve_1d(model, "count", 4).count() == 4


def test_design_job(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.uniform([60, 12, 300], [100, 24, 700], (40, 3))
    y = 50 + 30 * np.sin((x[:, 0] - 60) / 20) + 0.5 * x[:, 1]
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)] + [(70.0, None, 400.0, 1.0)]
    df = spark.createDataFrame(rows, "temp double, time double, stir double, yield double")
    path = str(tmp_path / "design.csv")
    out = scoring.design_job(df, ["temp", "time", "stir"], "yield", {"temp": (60, 100), "time": (12, 24), "stir": (300, 700)},
                             n=120, path=path)
    assert out["training"].first()["count"] == 40 and out["scored"].count() == 120
    scored = out["scored"].toPandas()
    truth = 50 + 30 * np.sin((scored.temp - 60) / 20) + 0.5 * scored.time
    assert np.abs(scored.score - truth).max() < 3
    assert out["best"].first().score == scored.score.max() and out["top"].count() == 10
    assert [r.parameter for r in out["importance"].orderBy(F.desc("correlation")).limit(1).collect()] == ["temp"]
    assert sum(r["count"] for r in out["score_histogram"].collect()) == 120
    bins = [r["count"] for r in out["parameter_histograms"]["stir"].collect()]
    assert sum(bins) == 120 and set(bins) <= {5, 6, 7}
    assert out["sorted"].count() == 120 and out["top2"].where("is_best").count() == 1
    saved = spark.read.option("header", True).csv(path)
    assert saved.count() == 120 and "predicted" in saved.columns and "score" not in saved.columns
    with pytest.raises(ValueError, match="missing columns"):
        scoring.design_job(df, ["temp", "ph"], "yield", {})


def test_large_blocks_in_chunks(spark, monkeypatch):
    """Hot and small blocks side by side; chunks change nothing, and all points inducing is exact."""
    rng = np.random.default_rng(6)
    rows = [(b, float(i) / 10, float(j), float(np.sin(i / 10) + j + rng.normal(0, 0.1)), 0.1, 3)
            for b, n in (("hot", 30), ("large", 12), ("small", 4)) for i in range(n) for j in range(2)]
    df = spark.createDataFrame(rows, "b string, p double, q double, y double, std double, count int")
    pdf = df.toPandas()

    def fitted(**options):
        return blocks.block_models(df, "b", ["p", "q"], "y", KERNELS[2], **options).toPandas().sort_values(["b", "p", "q"])

    exact, every = fitted(), fitted(method="sparse", inducing=100)
    assert len(every) == len(pdf) and every.columns.tolist() == exact.columns.tolist()
    for column, tolerance in (("fit_mean", 1e-6), ("fit_std", 1e-5), ("lml", 1e-5)):
        assert every[column].to_numpy() == pytest.approx(exact[column].to_numpy(), abs=tolerance)
    few = fitted(method="sparse", inducing=9)
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 7)
    for wanted, options in ((every, {"inducing": 100}), (few, {"inducing": 9})):
        chunked = fitted(method="sparse", **options)
        assert chunked.fit_mean.to_numpy() == pytest.approx(wanted.fit_mean.to_numpy(), abs=1e-6)
        assert chunked.fit_std.to_numpy() == pytest.approx(wanted.fit_std.to_numpy(), abs=1e-5)


def test_store_keeps_dates_and_the_last_whole_model(spark, tmp_path):
    import datetime
    import decimal
    rows = [(float(k % 4), datetime.date(2024, 1, 1 + k % 3), decimal.Decimal(k % 2), float(k % 5)) for k in range(24)]
    df = spark.createDataFrame(rows, "a double, day date, d decimal(8,2), y double")
    spec = AnalysisSpec(("a",), "y", cat_cols=("day", "d"), mode="mean")
    store = ModelStore(str(tmp_path), "one")
    store.save(models.fit_model(df, spec, KERNELS[0], tune=False))
    second = models.fit_model(df, spec, KERNELS[2], tune=False)
    store.save(second)
    loaded = store.load(spark, "mean")
    assert loaded.levels == second.levels and loaded.kernel == second.kernel
    assert [c["values"] for c in loaded.combos] == [c["values"] for c in second.combos]
    a, b = ([r.pred_mean for r in models.predict_rows(m, df).orderBy("a", "day", "d", "y").collect()] for m in (second, loaded))
    assert a == pytest.approx(b)
    with pytest.raises(ValueError, match="fit one first"):
        store.load(spark, "std")


def test_surfaces_by_combination(df):
    spec = AnalysisSpec(("a", "b"), "y", cat_cols=("c",), mode="mean")
    model = models.fit_model(df, spec, KERNELS[2], tune=False)
    every = frames.surface_2d(model, "a", "b", 6, by_combo=True).toPandas()
    assert every.columns.tolist() == ["combo_id", "combo", "point_id", "x", "y", "mean", "std"]
    assert len(every) == 36 * (len(model.combos) + 1)
    plain = frames.surface_2d(model, "a", "b", 6).toPandas().sort_values("point_id")
    whole = every[every.combo_id == 0].sort_values("point_id")
    assert whole["mean"].to_numpy() == pytest.approx(plain["mean"].to_numpy()) and whole.combo.unique().tolist() == ["All"]
    other = frames.surface_2d(model, "a", "b", 2, by_combo=True)
    pairs = frames.pair_surfaces(other, other)
    assert pairs.count() == other.count() and pairs.where("std_mean <> row_mean or std_combo <> row_combo").count() == 0


def test_codes_equal_columns_of_one_scale(spark, df, pdf):
    """Missing and repeated categories included; unseen levels and many levels work without a list of them."""
    some = spark.createDataFrame(pdf.assign(c=pdf.c.where(pdf.index % 11 > 0, None), d=[f"d{i % 3}" for i in pdf.index]))
    for spec in (AnalysisSpec(("a", "b"), "y", cat_cols=("c", "d"), mode="mean"), AnalysisSpec(("a",), "y", cat_cols=("c",), noise="constant")):
        plain = models.fit_model(some, spec, KERNELS[2], tune=False)
        coded = models.fit_model(some, spec, KERNELS[2], tune=False, encoding="codes")
        assert coded.controls == [*spec.num_cols, *spec.cat_cols] and len(plain.controls) > len(coded.controls)
        assert coded.solution.lml == pytest.approx(plain.solution.lml)
        a, b = (models.predict_rows(m, some).orderBy("a", "b", "c", "y").toPandas() for m in (plain, coded))
        assert b.pred_mean.to_numpy() == pytest.approx(a.pred_mean.to_numpy(), abs=1e-8)
        assert b.pred_std.to_numpy() == pytest.approx(a.pred_std.to_numpy(), abs=1e-6)
    tuned = models.fit_model(some, spec, KERNELS[2], encoding="codes")
    assert tuned.solution.lml >= coded.solution.lml and len(tuned.kernel.length_scale) == 2
    new = models.predict_rows(coded, some.limit(1).withColumn("c", F.lit("never seen"))).first()
    assert np.isfinite(new.pred_mean) and new.pred_std > 0
    with pytest.raises(ValueError, match="encoding='one_hot'"):
        frames.curve_1d(coded, "a")


def test_ten_thousand_levels(spark):
    many = spark.range(20_000).select((F.col("id") % 10_000).cast("string").alias("c"), (F.col("id") % 7 / 7).alias("a"),
                                      (F.col("id") % 10_000 / 10_000 + F.col("id") % 7).alias("y"))
    spec = AnalysisSpec(("a",), "y", cat_cols=("c",), mode="mean")
    model = models.fit_model(many, spec, KERNELS[0], tune=False, method="sparse", inducing=50, encoding="codes")
    assert len(model.controls) == 2 and np.isfinite(model.solution.lml)
    assert models.predict_rows(model, many).where("pred_mean is null").count() == 0
