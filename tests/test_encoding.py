import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from isoplane.operators import encoding as enc, scaling
from isoplane.functions.scalars import clip


@pytest.fixture(scope="module")
def cats(spark):
    rows = [("b", True, 1.0), ("a", False, 2.0), ("b", False, 3.0), (None, True, 4.0), ("b", True, 5.0)]
    return spark.createDataFrame(rows, "c string, f boolean, x double")


def test_one_hot(cats):
    out = enc.one_hot(cats, ["c", "f"])
    assert out.columns == ["x", "c_a", "c_b", "f_False", "f_True"]
    assert dict(out.dtypes)["c_a"] == "int"
    assert [tuple(r) for r in out.collect()] == [
        (1.0, 0, 1, 0, 1), (2.0, 1, 0, 1, 0), (3.0, 0, 1, 1, 0), (4.0, 0, 0, 0, 1), (5.0, 0, 1, 0, 1)]


def test_too_many_levels(cats):
    with pytest.raises(ValueError, match="levels in"):
        enc.one_hot(cats, ["x"], max_levels=2)


def test_combos(cats):
    got = [(r.combo_id, r.label, r.fixed) for r in enc.category_combos(cats, ["c", "f"]).collect()]
    assert [g[1] for g in got] == ["c=a, f=False", "c=b, f=False", "c=b, f=True", "c=nan, f=True"]
    assert got[0][2] == {"c_a": 1, "c_b": 0, "f_False": 1, "f_True": 0}
    assert got[3][2] == {"c_a": 0, "c_b": 0, "f_False": 0, "f_True": 1}
    assert [r.label for r in enc.category_combos(cats, ["c"], include_all=True).collect()][0] == "All"
    assert [(r.label, r.combo_id) for r in enc.category_combos(cats, [], include_all=True).collect()] == [(None, 0)]


def test_combo_rows(cats):
    assert cats.where(enc.matches({"c": None, "f": True})).count() == 1
    assert cats.where(enc.matches({"c": "b", "f": True})).count() == 2


def test_scaler_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, 12.5, None), (2.0, 12.5, 1.0), (4.0, 12.5, 3.0)], "a double, b double, c double")
    got = {r.column: (r.mean, r.scale) for r in scaling.fit_scaler(df, ["a", "b", "c"]).collect()}
    assert got["a"] == pytest.approx((7 / 3, np.std([1, 2, 4])))
    assert got["b"] == (12.5, 1.0) and got["c"] == (2.0, 1.0)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20))
def test_scaling_round_trip(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    back = scaling.unscale_columns(scaling.scale_columns(df, ["v"]), ["v"], df)
    assert [r.v for r in back.collect()] == pytest.approx(values, abs=1e-6, rel=1e-9)


def test_unscaling_a_spread_and_a_logged_target(spark):
    df = spark.createDataFrame([(2.0,)], "v double")
    row = df.select(scaling.unscaled(F.col("v"), (10.0, 3.0)).alias("a"),
                    scaling.unscaled(F.col("v"), (10.0, 3.0), spread=True).alias("b"),
                    scaling.unscaled(F.col("v"), (0.0, 1.0), exponentiate=True).alias("c"),
                    scaling.unscaled(F.col("v"), None).alias("d")).first()
    assert tuple(row) == pytest.approx((16.0, 6.0, np.exp(2.0), 2.0))


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (200.0,)], "v double")
    assert [r.c for r in df.select(clip(F.col("v"), 0.0, 100.0).alias("c")).collect()] == [None, 0.0, 100.0]
