"""Models of blocks against models of each block's rows alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoplane.plans import block_fits, models
from isoplane.spec import AnalysisSpec, KernelConfig

M32 = KernelConfig(kernel_type="matern", nu=1.5)
SPECS = [AnalysisSpec(("a", "b"), "y", cat_cols=("c",), mode="mean", log_cols=("b",)),
         AnalysisSpec(("a", "b"), "y", cat_cols=("c",), mode="std", noise="sem", log_cols=("b",)),
         AnalysisSpec(("a",), "y", mode="std", statistic="std", noise="constant")]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(2)
    n = 420
    pdf = pd.DataFrame({"g": rng.choice(["p", "q", "r"], n, p=[0.7, 0.2, 0.1]), "a": rng.integers(0, 4, n) * 1.5,
                        "b": 10.0 ** rng.integers(0, 2, n), "pred": "mine"})
    pdf["c"] = np.where(pdf.g == "p", rng.choice(["u", "v"], n), "v")
    pdf["y"] = np.sin(pdf.a) * (1 + (pdf.g == "q")) + (pdf.c == "u") + rng.normal(0, 0.3, n)
    return spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("spec", SPECS, ids=["rows", "means", "spreads"])
def test_blocks_equal_models_of_their_rows(df, spec):
    table = block_fits.fit_blocks(df, "g", spec, M32, tune=False).cache()
    got = block_fits.predict_blocks(table, df, "g", spec).toPandas()
    assert len(got) == 420 and set(got.columns) == {*df.columns, "pred_mean", "pred_std"}
    for g in "pqr":
        own = df.where(F.col("g") == g)
        model = models.fit_model(own, spec, M32, tune=False)
        want = models.predict_rows(model, own).toPandas()
        keys = ["a", "b", "c", "y"]
        x, y = (t.sort_values(keys).reset_index(drop=True) for t in (got[got.g == g], want))
        assert x.pred_mean.to_numpy() == pytest.approx(y.pred_mean.to_numpy(), abs=1e-7)
        assert x.pred_std.to_numpy() == pytest.approx(y.pred_std.to_numpy(), abs=1e-6)
        assert table.where(F.col("g") == g).first().lml == pytest.approx(model.solution.lml, rel=1e-7)


def test_every_block_is_tuned_on_its_own(df):
    table = {r.g: r for r in block_fits.fit_blocks(df, "g", SPECS[0], M32, n=16, starts=2).collect()}
    for g in "pr":
        model = models.fit_model(df.where(F.col("g") == g), SPECS[0], M32, search_options={"n": 16, "starts": 2})
        assert table[g].lml == pytest.approx(model.solution.lml, abs=1e-4)
    assert table["p"].length_scale != table["r"].length_scale


def test_chunks_unknown_blocks_and_missing_inputs(spark, df, monkeypatch):
    table = block_fits.fit_blocks(df, "g", SPECS[0], M32, tune=False).cache()
    new = spark.createDataFrame([("p", 1.0, 5.0, "u"), ("p", 1.0, 5.0, "u"), ("p", 1.0, None, "u"), ("p", 1.0, -1.0, "u"), ("p", 2.0, 5.0, None),
                                 ("p", 2.0, 5.0, "new"), ("z", 1.0, 1.0, "u"), (None, 1.0, 1.0, "u")], "g string, a double, b double, c string")
    whole = block_fits.predict_blocks(table, new, "g", SPECS[0]).orderBy("g", "a", "b", "c").toPandas()
    monkeypatch.setattr(block_fits, "CHUNK_ROWS", 2)
    split = block_fits.predict_blocks(table, new, "g", SPECS[0]).orderBy("g", "a", "b", "c").toPandas()
    pd.testing.assert_frame_equal(whole, split)
    assert len(whole) == 8 and whole.pred_mean.notna().sum() == 4
    none = whole[(whole.a == 2.0)]
    assert none.pred_mean.nunique() == 1


def test_blocks_that_cannot_be_fitted(spark):
    rows = [("p", 1.0, 1.0), ("p", 1.0, 2.0), ("p", 2.0, 2.0), ("p", 2.0, 3.5), ("q", 1.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, y double")
    spec = AnalysisSpec(("a",), "y", noise="constant")
    assert [r.g for r in block_fits.fit_blocks(df, "g", spec, M32, tune=False).collect()] == ["p"]
    with pytest.raises(ValueError, match="max_support, 1, conditions in blocks {'p': 2}"):
        block_fits.fit_blocks(df, "g", spec, M32, tune=False, max_support=1)
    with pytest.raises(Exception, match="block 'q': has log columns"):
        bad = spark.createDataFrame([("q", 0.0, 1.0), ("q", 0.0, 2.0)], "g string, a double, y double")
        block_fits.fit_blocks(bad, "g", AnalysisSpec(("a",), "y", log_cols=("a",)), M32, tune=False).collect()
    empty = df.limit(0)
    assert block_fits.fit_blocks(empty, "g", spec, M32, tune=False).count() == 0
