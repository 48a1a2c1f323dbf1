"""Contour levels at rounded values, and contour lines of a grid by marching squares."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from isoplane.sources.tables import col, number
from isoplane.spec import CONTOUR_LEVELS

# The steps between levels that count as round, times powers of ten.
ROUND_STEPS = (1, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10)
#: Levels are counted from a power of ten where values are this many times as far from zero as from each other.
FAR = 100
NEAR = 1e-10


def level_grid(lo: float, hi: float, levels: int = CONTOUR_LEVELS) -> tuple[float, float, int, int]:
    """``(origin, step, first, last)``: the levels ``origin + k * step`` that plots of a range draw.

    The step is the least round one with which ``levels + 1`` steps span the range; the levels
    reach from the last one not above ``lo`` to the first one not below ``hi``. A range
    without width is widened by a thousandth of its value on both sides first.
    """
    if hi <= lo:
        wide = abs(lo) / 1000 or 1e-3
        lo, hi = lo - wide, hi + wide
    middle, raw = (lo + hi) / 2, (hi - lo) / (levels + 1)
    origin = 0.0 if abs(middle) < FAR * (hi - lo) else math.copysign(10.0 ** math.floor(math.log10(abs(middle))), middle)
    power = 10.0 ** math.floor(math.log10(raw))
    step = next(s for s in (r * p for p in (power, 10 * power) for r in ROUND_STEPS) if s >= raw * (1 - NEAR))
    first, last = (lo - origin) / step, (hi - origin) / step
    near = lambda v: abs(v - round(v)) < NEAR
    return (origin, step, round(first) if near(first) else math.floor(first), round(last) if near(last) else math.ceil(last))


def column_grid(df: DataFrame, column: str, levels: int = CONTOUR_LEVELS):
    """``level_grid`` of a column's range; None for a column without values."""
    row = df.agg(F.min(number(column)), F.max(number(column))).first()
    return None if row[0] is None else level_grid(row[0], row[1], levels)


def contour_levels(df: DataFrame, column: str, levels: int = CONTOUR_LEVELS) -> DataFrame:
    """``(level_id, level)``: the rounded levels of a column's range, ascending."""
    found = column_grid(df, column, levels)
    origin, step, first, last = found or (0.0, 1.0, 0, -1)
    rows = df.sparkSession.range(max(last - first + 1, 0))
    return rows.select(F.col("id").cast("int").alias("level_id"), (F.lit(origin) + (F.col("id") + first) * F.lit(step)).alias("level"))


def level_bands(df: DataFrame, column: str, levels: int = CONTOUR_LEVELS, name: str = "band") -> DataFrame:
    """Every row's band between rounded levels: 0 from the first level on; NULL without a value."""
    origin, step, first, last = column_grid(df, column, levels) or (0.0, 1.0, 0, 1)
    value = number(column)
    band = F.floor((value - F.lit(origin)) / F.lit(step) + F.lit(NEAR)) - first
    return df.withColumn(name, F.when(value.isNotNull(), F.least(band, F.lit(last - first - 1))).cast("int"))


def _crossing(a: Column, b: Column, level: Column) -> Column:
    """Where the line between two corners takes the level's value, NULL where it does not pass it."""
    share = (level - a["v"]) / (b["v"] - a["v"])
    point = F.struct((a["x"] + share * (b["x"] - a["x"])).alias("x"), (a["y"] + share * (b["y"] - a["y"])).alias("y"))
    return F.when((a["v"] >= level) != (b["v"] >= level), point)


def contour_lines(surface: DataFrame, column: str, n: int, levels: int = CONTOUR_LEVELS, keys=()) -> DataFrame:
    """Straight pieces of the contour lines of a grid: ``keys``, ``level``, ``cell``, ``x0``, ``y0``, ``x1``, ``y1``.

    ``surface`` holds ``point_id`` (row times ``n`` plus column), ``x``, ``y`` and the value ``column``, one grid
    per value of ``keys``. Every point goes to the up to four cells it is a corner of, so
    one shuffle makes cells; a cell is crossed by the levels between its least and
    greatest corner. Values that reach a level count as above it. Where both diagonals
    differ, the mean of the corners decides which of them the lines part. Cells with a
    missing value have no lines; pieces run from the smaller to the larger end.
    """
    found = column_grid(surface, column, levels)
    origin, step, *_ = found or (0.0, 1.0)
    i, j = F.pmod("point_id", F.lit(n)), F.floor(F.col("point_id") / n)
    near = [(0, 0), (1, 0), (1, 1), (0, 1)]  # corner number by column and row within the cell, around it
    cells = F.array(*[F.struct(F.lit(k).alias("corner"), (i - a).alias("i"), (j - b).alias("j")) for k, (a, b) in enumerate(near)])
    corners = surface.select(*[col(k) for k in keys], F.struct(F.col("x"), F.col("y"), number(column).alias("v")).alias("p"), F.explode(cells).alias("c"))
    inside = corners.where(f"c.i between 0 and {n - 2} and c.j >= 0").withColumn("cell", F.col("c.j") * n + F.col("c.i"))
    whole = inside.groupBy(*[col(k) for k in keys], "cell").agg(
        *[F.max(F.when(F.col("c.corner") == k, F.col("p"))).alias(f"p{k}") for k in range(4)])
    whole = whole.where(" and ".join(f"p{k}.v is not null" for k in range(4)))
    low, high = (pick(*[F.col(f"p{k}.v") for k in range(4)]) for pick in (F.least, F.greatest))
    at = lambda v: ((v - origin) / step).cast("double")
    crossed = whole.withColumn("k", F.explode(F.when(F.floor(at(high)) > F.floor(at(low)), F.sequence(F.floor(at(low)) + 1, F.floor(at(high))))))
    level = F.lit(origin) + F.col("k") * F.lit(step)
    p = [F.col(f"p{k}") for k in range(4)]
    edges = [_crossing(p[k], p[(k + 1) % 4], F.col("level")) for k in range(4)]
    crossed = crossed.withColumn("level", level).withColumns({f"e{k}": e for k, e in enumerate(edges)})
    above = sum((F.col(f"p{k}.v") for k in range(1, 4)), F.col("p0.v")) / 4 >= F.col("level")
    first = F.col("p0.v") >= F.col("level")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    # Four crossings: the corners on the other side than the middle are cut off one by one.
    both = F.when(above == first, F.array(pair("e0", "e1"), pair("e2", "e3"))).otherwise(F.array(pair("e3", "e0"), pair("e1", "e2")))
    ends = F.array_compact(F.array(*[F.col(f"e{k}") for k in range(4)]))
    one = F.array(F.struct(F.get(ends, F.lit(0)).alias("a"), F.get(ends, F.lit(1)).alias("b")))
    lines = crossed.where(F.size(ends) > 0).withColumn("line", F.explode(F.when(F.size(ends) == 4, both).otherwise(one)))
    a, b = F.least("line.a", "line.b"), F.greatest("line.a", "line.b")
    return lines.select(*[col(k) for k in keys], "level", "cell", a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))
