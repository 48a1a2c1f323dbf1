import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoplane.operators import profiling as prof
from isoplane.operators.ranking import with_rank


def frame(spark, values, columns="v double"):
    return spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], columns)


@pytest.mark.parametrize("n", [1, 2, 7, 500, 501])
@pytest.mark.parametrize("shape", ["normal", "hot", "two"])
def test_medians_by_narrowing(spark, n, shape):
    rng = np.random.default_rng(n)
    v = rng.normal(size=n)
    if shape == "hot":
        v[: n // 3] = 0.1
    if shape == "two":
        v = np.where(v > 0, 1.0, 2.0)
    got = prof.exact_medians(frame(spark, v.tolist()), ["v"], bins=4)
    assert got["v"] == pytest.approx(np.median(v), abs=0)


def test_weighted_medians(spark):
    rng = np.random.default_rng(1)
    v, w = rng.integers(0, 60, 80).astype(float), rng.integers(1, 9, 80)
    df = frame(spark, list(zip(v.tolist(), w.tolist())), "v double, w int")
    want = np.median(np.repeat(v, w))
    assert prof.exact_medians(df, ["v"], "w")["v"] == want
    assert prof.exact_medians(df, ["v"], "w", bins=3)["v"] == want


def test_median_skips_missing(spark):
    assert prof.exact_medians(frame(spark, [1.0, None, 3.0]), ["v"])["v"] == 2.0


@pytest.mark.parametrize("bins", [1, 20, 30])
def test_histogram_matches_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    v = np.concatenate([rng.normal(size=300), np.linspace(-2, 2, bins + 1), [0.3] * 50]).tolist()
    got = prof.histogram(frame(spark, v), "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(v, bins)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.lo for r in got] == pytest.approx(edges[:-1]) and got[-1].hi == edges[-1]


def test_histogram_of_one_value(spark):
    got = prof.histogram(frame(spark, [3.0, 3.0, None]), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram([3.0, 3.0], 4)[0].tolist()
    assert (got[0].lo, got[-1].hi) == (2.5, 3.5)
    assert [r.band for r in prof.equal_bands(frame(spark, [3.0, 3.0]), "v").collect()] == [1, 1]


def test_correlation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2))
    y = x @ [2.0, -0.5] + rng.normal(size=50)
    rows = [(float(a), float(b), 1.0, float(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    got = prof.parameter_correlation(df, ["a", "b", "c"], "y")
    found = {r.parameter: r.correlation for r in got.collect()}
    assert found["a"] == pytest.approx(np.corrcoef(x[:, 0], y)[0, 1])
    assert found["b"] == pytest.approx(np.corrcoef(x[:, 1], y)[0, 1])
    assert found["c"] is None
    assert [r.parameter for r in prof.top_parameters(got, 3).collect()] == ["a", "b", "c"]


def test_ties_go_to_the_lowest_id(spark):
    df = spark.createDataFrame([(3, 100.0), (1, 100.0), (2, 99.0), (4, None)], "id int, s double")
    assert prof.best_row(df, "s", "id").first().id == 1
    assert [r.id for r in prof.top_rows(df, "s", "id", 3).collect()] == [1, 3, 2]


def test_metrics(spark):
    rng = np.random.default_rng(0)
    y, f = rng.normal(size=40), rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, f)], "y double, f double")
    row = prof.fit_metrics(df, "y", "f").first()
    assert row.r2 == pytest.approx(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert (row.mae, row.rmse) == pytest.approx((np.abs(y - f).mean(), np.sqrt(((y - f) ** 2).mean())))
    assert prof.fit_metrics(df, "y", "f", 4).first().mae == round(row.mae, 4)


@pytest.mark.parametrize("parts", [1, 5])
def test_ranks_with_a_hot_score(spark, parts):
    n = 997
    df = spark.range(n).withColumn("s", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(7))).repartition(parts)
    rows = df.collect()
    want = {r.id: i for i, r in enumerate(sorted(rows, key=lambda r: (r.s, r.id)), 1)}
    assert {r.id: r["rank"] for r in with_rank(spark.createDataFrame(rows), "s", "id").collect()} == want


def test_rank_of_nothing(spark):
    assert with_rank(spark.range(0).withColumn("s", F.lit(1.0)), "s", "id").count() == 0


def test_ranges(spark):
    df = spark.createDataFrame([(1, 2.0), (5, None)], "a int, b double")
    assert [tuple(r) for r in prof.column_ranges(df, ["a", "b"]).collect()] == [("a", 1.0, 5.0), ("b", 2.0, 2.0)]
    assert [r.a for r in prof.distinct_values(df, "a").collect()] == [1, 5]
    assert tuple(prof.score_summary(df, "a").first()) == (3.0, 5.0, 1.0, 2)


def test_medians_read_the_source_twice(spark, monkeypatch):
    """The sketch's bracket, brackets that miss, and more values than the driver sorts give the same medians."""
    from isoplane.operators import profiling
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.normal(size=3001), "b": rng.integers(0, 5, 3001) * 1e300, "c": np.exp(rng.normal(0, 20, 3001)),
                        "d": np.where(rng.random(3001) < 0.6, 1.0, rng.random(3001)), "e": 2.0, "f": None})
    pdf.loc[::9, "a"] = np.nan
    pdf["f"] = pdf["f"].astype(float)
    df = spark.createDataFrame(pdf).repartition(5)
    want = {c: None if c == "f" else pdf[c].median() for c in pdf}

    def check():
        got = profiling.exact_medians(df, list(pdf))
        assert got["f"] is None and all(got[c] == pytest.approx(want[c], rel=1e-15) for c in "abcde")

    check()
    monkeypatch.setattr(profiling, "MEDIAN_ROWS", 3)
    check()
    real, reads = profiling._brackets, []

    def missing(values, columns, sketched):
        reads.append(sketched)
        found = real(values, columns, sketched)
        return {i: (lo, hi, hi, hi, n) if sketched and i == 0 else (lo, hi, a, b, n) for i, (lo, hi, a, b, n) in found.items()}

    monkeypatch.setattr(profiling, "_brackets", missing)
    check()
    monkeypatch.setattr(profiling, "MEDIAN_ROWS", 200_000)
    check()
    assert reads == [True, False, True, False]
