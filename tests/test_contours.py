"""Contour levels and lines against plain loops."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoplane.operators import contours as op

LEVELS = [(0.0, 1.0, 40), (0.2, 0.9, 7), (-3.0, 5.0, 10), (1e6, 1e6 + 3, 5), (38_000.0, 38_950.0, 40), (-1e-5, 2e-5, 12), (-7.1e8, -7.0e8, 40), (5.0, 5.0, 4), (0.0, 0.0, 4)]


@pytest.mark.parametrize("lo, hi, n", LEVELS)
def test_levels_are_round_and_span_the_range(lo, hi, n):
    origin, step, first, last = op.level_grid(lo, hi, n)
    unit = step / 10.0 ** math.floor(math.log10(step) + 1e-9)
    assert min(abs(unit - s) for s in op.ROUND_STEPS) < 1e-9
    assert origin + first * step <= lo + 1e-9 * step and origin + last * step >= hi - 1e-9 * step
    if hi > lo:
        assert origin + (first + 1) * step > lo and origin + (last - 1) * step < hi and (hi - lo) / step <= n + 1 + 1e-6
        smaller = [s * 10.0 ** k for k in range(-12, 12) for s in op.ROUND_STEPS if s * 10.0 ** k < step * (1 - 1e-9)]
        assert (hi - lo) / max(smaller) > n + 1


def test_known_levels():
    assert op.level_grid(0.0, 1.0, 40) == (0.0, 0.025, 0, 40)
    assert op.level_grid(0.13, 0.97, 10) == (0.0, pytest.approx(0.08), 1, 13)
    assert op.level_grid(1_000_000.2, 1_000_002.9, 5) == (1e6, 0.5, 0, 6)


def plain_lines(z, xs, ys, grid):
    origin, step, first, last = grid
    out = []
    for j, i in itertools.product(range(len(ys) - 1), range(len(xs) - 1)):
        p = [(xs[i], ys[j], z[j, i]), (xs[i + 1], ys[j], z[j, i + 1]), (xs[i + 1], ys[j + 1], z[j + 1, i + 1]), (xs[i], ys[j + 1], z[j + 1, i])]
        if any(math.isnan(v) for _, _, v in p):
            continue
        for k in range(first, last + 1):
            level = origin + k * step
            cut = {}
            for e in range(4):
                (xa, ya, a), (xb, yb, b) = p[e], p[(e + 1) % 4]
                if (a >= level) != (b >= level):
                    s = (level - a) / (b - a)
                    cut[e] = (xa + s * (xb - xa), ya + s * (yb - ya))
            if len(cut) == 4:
                same = (sum(v for _, _, v in p) / 4 >= level) == (p[0][2] >= level)
                pairs = [(0, 1), (2, 3)] if same else [(3, 0), (1, 2)]
            else:
                pairs = [tuple(cut)] if cut else []
            out += [(round(level, 9), j * len(xs) + i, *(round(c, 9) for end in sorted((cut[a], cut[b])) for c in end)) for a, b in pairs]
    return sorted(out)


def surface(spark, z, xs, ys, **more):
    rows = [(j * len(xs) + i, float(xs[i]), float(ys[j]), float(z[j, i])) for j in range(len(ys)) for i in range(len(xs))]
    return spark.createDataFrame(rows, "point_id int, x double, y double, `v v` double").select("*", *[F.lit(v).alias(k) for k, v in more.items()])


def got(df, *keys):
    return sorted((*[r[k] for k in keys], round(r.level, 9), r.cell, *(round(r[c], 9) for c in ("x0", "y0", "x1", "y1"))) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_lines_match_plain_marching_squares(spark, seed):
    r = np.random.default_rng(seed)
    xs, ys = np.sort(r.normal(size=9)), np.arange(6) * 2.0
    z = [r.normal(size=(6, 9)), np.sin(xs)[None] + ys[:, None] / 5, r.integers(0, 3, (6, 9)).astype(float)][seed]
    if seed == 0:
        z[2, 3] = np.nan
    df = surface(spark, z, xs, ys, level="mine")
    want = plain_lines(z, xs, ys, op.level_grid(np.nanmin(z), np.nanmax(z), 6))
    assert want and got(op.contour_lines(df, "v v", 9, 6)) == want


def test_one_grid_per_key_and_nothing_to_draw(spark):
    xs, ys = np.arange(4.0), np.arange(3.0)
    a, b = np.add.outer(ys, xs), np.multiply.outer(ys, xs)
    both = surface(spark, a, xs, ys, combo="a").unionByName(surface(spark, b, xs, ys, combo="b"))
    grid = op.level_grid(0.0, 6.0, 5)
    want = sorted([("a", *r) for r in plain_lines(a, xs, ys, grid)] + [("b", *r) for r in plain_lines(b, xs, ys, grid)])
    assert got(op.contour_lines(both, "v v", 4, 5, ["combo"]), "combo") == want
    assert op.contour_lines(both.limit(0), "v v", 4).count() == 0 and op.contour_levels(both.limit(0), "v v").count() == 0
    flat = surface(spark, np.ones((3, 4)), xs, ys)
    assert op.contour_lines(flat, "v v", 4).count() == 0


def test_levels_and_bands_of_a_column(spark):
    pdf = pd.DataFrame({"v": [0.13, 0.97, 0.5, 0.4, None], "i": range(5)})
    df = spark.createDataFrame(pdf)
    levels = [r.level for r in op.contour_levels(df, "v", 10).orderBy("level_id").collect()]
    assert levels == pytest.approx([0.08 * k for k in range(1, 14)])
    bands = {r.i: r.band for r in op.level_bands(df, "v", 10).collect()}
    assert bands == {i: None if v is None or math.isnan(v) else min(sum(v >= x - 1e-9 for x in levels) - 1, 11) for i, v in zip(pdf.i, pdf.v)}
