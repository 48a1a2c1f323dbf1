import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from isoplane.functions.formulas import derive_columns, log10_columns


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, 4.0, 0.0, "a", True), (-5, -2.5, 3.0, "b", False), (7, None, -3.0, None, True), (0, 9.0, 2.0, "a", False)]
    return spark.createDataFrame(rows, "i int, x double, z double, s string, b boolean").withColumnRenamed("z", "z z")


def values(df, name):
    return [r[name] for r in df.collect()]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and w is None) or g == pytest.approx(w)


@pytest.mark.parametrize("formula, want", [
    ("i / df['z z']", [None, -5 / 3, 7 / -3, 0.0]),
    ("i // 2", [0, -3, 3, 0]),
    ("i % -3", [-2, -2, -2, 0]),
    ("df['z z'] % 2", [0.0, 1.0, 1.0, 0.0]),
    ("i ** 2", [1.0, 25.0, 49.0, 0.0]),
    ("-x + 1", [-3.0, 3.5, None, -8.0]),
    ("np.sqrt(x)", [2.0, None, None, 3.0]),
    ("np.log10(i)", [0.0, None, math.log10(7), None]),
    ("np.arcsin(i)", [math.pi / 2, None, None, 0.0]),
    ("np.log1p(i)", [math.log(2), None, math.log(8), 0.0]),
    ("np.minimum(x, i)", [1.0, -5.0, None, 0.0]),
    ("np.clip(i, -1, 3)", [1, -1, 3, 0]),
    ("np.round(x)", [4.0, -2.0, None, 9.0]),
    ("np.round(x / 3, 1)", [1.3, -0.8, None, 3.0]),
    ("np.where((s == 'a') | (i > 5), x, -1)", [4.0, -1.0, None, 9.0]),
    ("b * 2 + 1", [3, 1, 3, 1]),
    ("x - np.mean(x)", [0.5, -6.0, None, 5.5]),
    ("(x - x.min()) / (x.max() - x.min())", [6.5 / 11.5, 0.0, None, 1.0]),
    ("x / x.std() * 0 + x.std()", [np.std([4, -2.5, 9], ddof=1)] * 2 + [None] + [np.std([4, -2.5, 9], ddof=1)]),
    ("np.std(x) + 0 * i", [np.std([4, -2.5, 9])] * 4),
    ("np.var(x - np.mean(x)) + 0 * i", [np.var([4, -2.5, 9])] * 4),
    ("np.median(x) + 0 * i", [4.0] * 4),
    ("x.median() + x.sum()", [14.5, 14.5, 14.5, 14.5]),
])
def test_values(frame, formula, want):
    close(values(derive_columns(frame, [f"out = {formula}"]), "out"), want)


@pytest.mark.parametrize("formula, want", [
    ("x > 3", [True, False, False, True]), ("x != 4", [False, True, True, True]),
    ("~(s == 'a')", [False, True, True, False]), ("np.isnan(x) | b", [True, False, True, False]),
    ("(i >= 0) & (x <= 5)", [True, False, False, False]),
])
def test_conditions(frame, formula, want):
    assert values(derive_columns(frame, [f"out = {formula}"]), "out") == want


def test_order_and_skipping(frame):
    out = derive_columns(frame, ["p = i * 2", "no formula", "q = p + p.max()", "r = q - q.mean()", "i = r * 0"])
    assert values(out, "q") == [16, 4, 28, 14]
    close(values(out, "r"), [0.5, -11.5, 12.5, -1.5])
    assert derive_columns(frame, None) is frame


@pytest.mark.parametrize("formula", [
    "i ^ 2", "nothing + 1", "__import__('os')", "x.__class__", "np.linalg.inv(x)", "open('f')", "1 < i < 3",
    "s + 1", "i and x", "np.log", "df.x", "x.apply(1)", "[1, 2]", "s == 1", "i if b else x", "lambda: 1", "1 +",
])
def test_rejected(frame, formula):
    with pytest.raises(ValueError, match="Error in expression"):
        derive_columns(frame, [f"out = {formula}"])


def test_power_hint(frame):
    with pytest.raises(ValueError, match=r"use \*\*"):
        derive_columns(frame, ["out = i ^ 2"])


def test_log_columns_reject_non_positive(spark):
    df = spark.createDataFrame([(10.0,), (0.0,)], "v double")
    with pytest.raises(ValueError, match="not positive"):
        log10_columns(df, ["v"])
    assert values(log10_columns(df.where("v > 0"), ["v"]), "v") == [1.0]


def test_large_integers_do_not_overflow(spark):
    df = spark.createDataFrame([(2_000_000_000,)], "i int")
    assert values(derive_columns(df, ["o = i * 4"]), "o") == [8_000_000_000]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.integers(-50, 50), b=st.integers(-50, 50))
def test_python_division_rules(spark, a, b):
    row = derive_columns(spark.createDataFrame([(a, b)], "a int, b int"), ["q = a // b", "m = a % b"]).first()
    assert (row.q, row.m) == ((a // b, a % b) if b else (None, None))


def test_the_whole_range_of_doubles_and_longs(spark):
    big, inf = 2 ** 53, float("inf")
    rows = [(1e300, big + 1, 7), (-1e300, -big - 1, -7), (float(big), big, 2), (big - 0.5, 2 ** 63 - 1, 10), (inf, -2 ** 63, 3),
            (-2.5, 9007199254740993, 1), (2.5, -9, 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "x double, k long, m long")
    out = derive_columns(df, ["fl = np.floor(x)", "ce = np.ceil(x)", "q = x // 1", "r = x % 7", "kq = k // m", "kr = k % m"]).collect()
    for (x, k, m), row in zip(rows, out):
        if x is None:
            assert list(row)[3:] == [None] * 6
            continue
        assert (row.fl, row.ce) == (float(np.floor(x)), float(np.ceil(x)))
        assert (row.q, row.r) == ((x // 1, x % 7) if not np.isinf(x) else (None, None))
        assert (row.kq, row.kr) == (k // m, k % m)


def test_rounding_leaves_large_values(spark):
    from isoplane.functions.scalars import rounded
    values = [1e12, -1e300, 2.0 ** 53 + 2, 0.125, -0.125, 1.005, float("inf"), None]
    out = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(
        rounded(F.col("v"), 8).alias("v")).collect()]
    assert out == values
    assert spark.range(1).select(rounded(F.lit(-0.125), 2).alias("v")).first().v == -0.13


def test_average_ranks(spark):
    """As pandas ranks: ties share the mean, missing values have none; ranks nest in other formulas."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 40, 500).astype(float), "f_rank": rng.normal(size=500), "i": range(500)})
    pdf.loc[::7, "x"] = None
    df = spark.createDataFrame(pdf).repartition(6)
    out = derive_columns(df, ["r = x.rank()", "s = (2 * f_rank).rank() / f_rank.rank().max()", "t = (x - x.mean()).rank() - r.rank().mean()",
                              "u = (-x.rank()).rank()"]).orderBy("i").toPandas()
    assert out.columns.tolist() == ["x", "f_rank", "i", "r", "s", "t", "u"] and len(out) == 500
    assert out.r.to_numpy() == pytest.approx(pdf.x.rank().to_numpy(), nan_ok=True)
    assert out.s.to_numpy() == pytest.approx((pdf.f_rank.rank() / 500).to_numpy())
    assert out.t.to_numpy() == pytest.approx((pdf.x.rank() - pdf.x.rank().rank().mean()).to_numpy(), nan_ok=True)
    assert out.u.to_numpy() == pytest.approx((-pdf.x.rank()).rank().to_numpy(), nan_ok=True)
    empty = derive_columns(df.limit(0), ["r = x.rank()"])
    assert empty.columns == ["x", "f_rank", "i", "r"] and empty.count() == 0
    nothing = derive_columns(df.where("isnan(x)"), ["r = x.rank()"])
    assert nothing.where("r is null").count() == nothing.count() > 0
    with pytest.raises(ValueError, match="rank"):
        derive_columns(df, ["r = np.rank(x)"])


def test_ranks_of_a_large_table_spread_frequent_values(spark, monkeypatch):
    from isoplane.operators import ranking, replicates
    monkeypatch.setattr(replicates, "BROADCAST_ROWS", 5)
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 50).alias("x"))
    got = ranking.with_average_rank(df, F.col("x"), "r").orderBy("id").toPandas()
    assert got.r.to_numpy() == pytest.approx(got.x.rank().to_numpy()) and len(got) == 2000
