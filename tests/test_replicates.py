import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoplane.operators import replicates as rep

ROWS = [("a", 1.0, 10.0), ("a", 1.0, 12.0), ("a", 1.0, 11.0), ("a", 2.0, 5.0), ("b", 1.0, 3.0), ("b", 1.0, None),
        ("b", None, 4.0), ("b", None, 4.5), (None, 3.0, 1.0), (None, 3.0, 2.0), ("b", 4.0, 7.0), ("b", 4.0, 7.0)]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, "blk string, x double, y double")


def test_groups(raw):
    got = {r.x: (r["mean"], r["std"], r["count"], r["n_valid"]) for r in rep.replicate_groups(raw, ["x"], "y").collect()}
    assert got[1.0] == pytest.approx((9.0, np.std([10, 12, 11, 3], ddof=1), 5, 4))
    assert got[3.0] == pytest.approx((1.5, np.std([1, 2], ddof=1), 2, 2))
    assert got[4.0] == (7.0, 0.0, 2, 2)
    assert set(got) == {1.0, 3.0, 4.0}


def test_null_measurement_counts_as_row(raw):
    row = rep.replicate_groups(raw.where("blk = 'b'"), ["x"], "y").where("x = 1").first()
    assert (row["mean"], row["std"], row["count"], row["n_valid"]) == (3.0, None, 2, 1)


def test_dropped(raw):
    assert [tuple(r) for r in rep.dropped_groups(raw, ["x"], "y").collect()] == [(2.0, 1)]


def test_missing_category_is_a_condition(raw):
    keys = {r.blk for r in rep.replicate_groups(raw, ["blk", "x"], "y", categories=["blk"]).collect()}
    assert keys == {"a", "b", None}
    assert {r.blk for r in rep.replicate_groups(raw, ["x"], "y", block="blk").collect()} == {"a", "b"}


def test_blocks_split(raw):
    out = rep.replicate_groups(raw, ["x"], "y", block="blk")
    parts = rep.split_blocks(out, "blk", ["a", "b"])
    assert parts["a"].count() == 1 and parts["b"].count() == 2
    assert out.columns[0] == "blk"


def test_key_digits(spark):
    df = spark.createDataFrame([(0.07, 1.0), (0.0699999999999999, 3.0)], "x double, y double")
    assert rep.replicate_groups(df, ["x"], "y").count() == 0
    assert rep.replicate_groups(df, ["x"], "y", key_digits=6).first()["mean"] == 2.0


def brute(pdf, sd):
    out = {}
    for key, g in pdf.groupby("x"):
        y = g.y
        if len(y) > 2 and y.std() > 0:
            y = y[np.abs(y - y.mean()) <= sd * y.std()]
        if len(y) >= 2:
            out[key] = (y.mean(), y.std(), len(y))
    return out


@pytest.mark.parametrize("sd", [0.9, 1.2, 2.0, 1e9])
def test_outlier_trim(spark, sd):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 12, 200).astype(float), "y": rng.normal(size=200)})
    pdf.loc[rng.integers(0, 200, 8), "y"] = np.nan
    pdf.loc[pdf.index[:9], "y"] = 50.0
    df = spark.createDataFrame([(a, None if np.isnan(b) else b) for a, b in pdf.itertuples(index=False)], "x double, y double")
    got = {r.x: (r["mean"], r["std"], r["count"]) for r in rep.replicate_groups(df, ["x"], "y", outlier_sd=sd).collect()}
    want = brute(pdf, sd)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], nan_ok=True)


def test_triplicates_are_never_trimmed(spark):
    df = spark.createDataFrame([(1.0, v) for v in (1.0, 1.1, 900.0)], "x double, y double")
    assert rep.replicate_groups(df, ["x"], "y", outlier_sd=1.16).first()["count"] == 3
    assert rep.flag_outliers(df, ["x"], "y", 1.16).where("is_outlier").count() == 0
    assert rep.flag_outliers(df, ["x"], "y", 1.15).where("is_outlier").count() == 1


def test_hot_and_cold_conditions_meet(spark, monkeypatch):
    """A table too large to broadcast: hot keys by broadcast, the others by shuffle."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1500, F.lit(0)).otherwise(F.col("id") % 700).cast("double").alias("x"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5).cast("string").alias("c"),
        (F.col("id") % 17).cast("double").alias("y")).repartition(6)
    whole = rep.flag_outliers(rows, ["x", "c"], "y", 1.0, categories=["c"])
    monkeypatch.setattr(rep, "BROADCAST_ROWS", 10)
    split = rep.flag_outliers(rows, ["x", "c"], "y", 1.0, categories=["c"])
    assert "BroadcastHashJoin" in split._jdf.queryExecution().executedPlan().toString()

    def key(r):
        return tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r)

    assert sorted(map(key, whole.collect())) == sorted(map(key, split.collect()))
    assert split.count() == 3000


def test_reserved_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "mean double, y double")
    with pytest.raises(ValueError, match="rename"):
        rep.replicate_groups(df, ["mean"], "y")


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (1.0, nan), (1.0, 4.0), (nan, 1.0), (nan, 2.0)], "x double, y double")
    assert [tuple(r) for r in rep.replicate_groups(df, ["x"], "y").collect()] == [(1.0, 3.0, pytest.approx(2 ** 0.5), 3, 2)]
