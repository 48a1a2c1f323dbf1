import numpy as np
import pytest
from pyspark.sql import functions as F

from isoplane.operators.design import lhs_design
from isoplane.operators import grids


@pytest.mark.parametrize("n", [1, 2, 10, 1000, 4097])
def test_every_stratum_is_hit_once(spark, n):
    ranges = {"a": (0.0, 1.0), "b": (60, 100), "c": (-3.0, 5.0)}
    pdf = lhs_design(spark, n, ranges).toPandas()
    assert pdf.sample_id.tolist() == list(range(1, n + 1))
    for name, (lo, hi) in ranges.items():
        unit = (pdf[name] - lo) / (hi - lo)
        strata = np.floor(unit * n + 1e-9).astype(int)
        assert sorted(strata) == list(range(n))


def test_columns_look_unrelated(spark):
    pdf = lhs_design(spark, 20000, {f"p{i}": (0.0, 1.0) for i in range(4)}).toPandas()
    corr = np.corrcoef(pdf.to_numpy().T)
    assert np.abs(corr - np.eye(5)).max() < 0.03
    cells = np.histogram2d(pdf.p0, pdf.p1, bins=10)[0]
    assert cells.min() > 130 and cells.max() < 270


def test_seed_and_partitions(spark):
    ranges = {"a": (0.0, 1.0), "b": (0.0, 2.0)}
    one = lhs_design(spark, 500, ranges, 7).orderBy("sample_id").collect()
    assert one == lhs_design(spark, 500, ranges, 7).repartition(3).orderBy("sample_id").collect()
    assert one != lhs_design(spark, 500, ranges, 8).orderBy("sample_id").collect()


def test_design_has_no_exchange(spark):
    plan = lhs_design(spark, 100, {"a": (0, 1), "b": (0, 1)})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bad_settings(spark):
    with pytest.raises(ValueError):
        lhs_design(spark, 0, {"a": (0, 1)})
    with pytest.raises(ValueError):
        lhs_design(spark, 5, {"a": (1, 1)})


def test_grids(spark):
    assert [r.x for r in grids.grid_1d(spark, 2.0, 5.0).collect()] == pytest.approx(np.linspace(2, 5, 300))
    assert [r.x for r in grids.grid_1d(spark, 0.1, 50, 40, log=True).collect()] == pytest.approx(np.geomspace(0.1, 50, 40))
    xx, yy = np.meshgrid(np.linspace(0, 1, 7), np.geomspace(1, 9, 7))
    rows = grids.grid_2d(spark, (0, 1), (1, 9), 7, log_y=True).orderBy("point_id").collect()
    assert [r.x for r in rows] == pytest.approx(xx.ravel()) and [r.y for r in rows] == pytest.approx(yy.ravel())
    combos = spark.createDataFrame([(0, "All"), (1, "c=a")], "combo_id int, combo string")
    assert grids.grid_1d_by_combo(combos, 0, 1, 5).groupBy("combo_id").agg(F.max("x")).collect()[0][1] == 1.0
