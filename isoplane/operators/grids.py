"""Prediction grids computed from row numbers; nothing is crossed."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from isoplane.spec import CURVE_POINTS, SURFACE_POINTS


def spaced(i: Column, n: int, lo, hi, log: bool = False) -> Column:
    """Point ``i`` of ``n`` from lo to hi, evenly spaced or geometric."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    share = i / F.lit(float(max(n - 1, 1)))
    return lo * F.pow(hi / lo, share) if log else lo + share * (hi - lo)


def grid_1d(spark: SparkSession, lo, hi, n: int = CURVE_POINTS, log: bool = False) -> DataFrame:
    """``(point_id, x)``."""
    return spark.range(n).select(F.col("id").cast("int").alias("point_id"),
                                 spaced(F.col("id"), n, lo, hi, log).alias("x"))


def grid_2d(spark: SparkSession, x_range, y_range, n: int = SURFACE_POINTS, log_x: bool = False,
            log_y: bool = False) -> DataFrame:
    """``(point_id, x, y)``, x varying fastest."""
    points = spark.range(n * n).select(F.col("id").cast("int").alias("point_id"))
    return _placed(points, x_range, y_range, n, log_x, log_y)


def _placed(points, x_range, y_range, n, log_x, log_y):
    point = F.col("point_id")
    return points.withColumns({"x": spaced(point % n, n, *x_range, log_x), "y": spaced(F.floor(point / n), n, *y_range, log_y)})


def grid_1d_by_combo(combos: DataFrame, lo, hi, n: int = CURVE_POINTS, log: bool = False) -> DataFrame:
    """The same curve grid for every row of a combination table."""
    points = combos.withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return points.withColumn("x", spaced(F.col("point_id"), n, lo, hi, log))


def grid_2d_by_combo(combos: DataFrame, x_range, y_range, n: int = SURFACE_POINTS, log_x: bool = False,
                     log_y: bool = False) -> DataFrame:
    """The same surface grid for every row of a combination table."""
    points = combos.withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    return _placed(points, x_range, y_range, n, log_x, log_y)
