"""Gaussian process over many support points through a fixed set of inducing points.

One pass over the support sums ``K_zx D^-1 K_xz`` and ``K_zx D^-1 y`` (D: noise);
the rest is a solve of the inducing points' size (Quinonero-Candela and Rasmussen
2005). With every support point inducing, the result is the exact one.
"""

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isoplane.functions.kernels import feature_matrix, kernel_block, row_blocks
from isoplane.plans.gp import Solution, _check_finite, cholesky, forward, to_arrays
from isoplane.plans.search import candidate_thetas
from isoplane.spec import KernelConfig

INDUCING = 512
GRAM_TASKS = 2_048
TOLERANCE = 0.01
#: Rounds of a search go on until its box is this share of the bounds.
BOX = 0.02
#: Points of most remaining variance that one pass brings to the driver.
PIVOT_ROWS = 4_096
#: Remaining variances, as shares of the amplitude, are compared at so many digits; nothing is left at the last.
PIVOT_DIGITS = 9


def choose_inducing(support: DataFrame, features, n: int = INDUCING, seed: int = 42, key: str | None = None) -> np.ndarray:
    """The n distinct support points with the smallest keyed hash: a repeatable spread-out sample.

    ``key`` is a column hashed from raw settings, which rounding in the scaled
    features cannot change. Only points under a hash limit are compared with each
    other; the limit starts where about 8 n points are expected and widens until
    n are found.
    """
    hashed = support.select(*features, (F.col(key) if key else F.xxhash64(*features, F.lit(seed))).alias("h"))
    least, most = (0, 1 << 60) if key else (-1 << 63, (1 << 63) - 1)
    share = min(1.0, 8 * n / max(support.count(), 1))
    while True:
        limit = most if share >= 1 else least + int(share * (most - least))
        low = hashed.where(F.col("h") <= F.lit(limit)).groupBy("h").agg(
            F.min(F.struct(*features)).alias("x")).orderBy("h").limit(n)
        rows = low.select("x.*").collect()
        if len(rows) == n or share >= 1:
            return to_arrays(rows, features)[0]
        share = min(1.0, share * 16)


def remaining_variance(params: dict, z: np.ndarray):
    """Function of a struct of features: the share of the variance that the points ``z`` leave unexplained."""
    inverse = forward(cholesky(kernel_block(params, z, z))[0], np.eye(len(z))).T

    @F.arrow_udf("double")
    def left(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = feature_matrix(batch)
            out = np.empty(len(x))
            for rows in row_blocks(x, len(z)):
                out[rows] = np.square(kernel_block(params, x[rows], z) @ inverse).sum(1)
            yield pa.array(np.round(1 - out / params["amplitude"], PIVOT_DIGITS))

    return left


def pivoted_inducing(support: DataFrame, features, params: dict, n: int = INDUCING) -> np.ndarray:
    """Greedy choice: the next inducing point is the one whose variance the chosen ones explain least.

    That is the pivot order of a Cholesky factor; ties go to the least features, and the
    first point is the least of all. One pass over the support brings the PIVOT_ROWS points
    of most remaining variance and the next one's value. Variances only fall as points
    join, so the best of those points is the best of all while it lies above that value;
    below it the next pass begins. Fewer than ``n`` points come back when they explain all.
    """
    amplitude, chosen = params["amplitude"], np.zeros((0, len(features)))
    share = lambda left: np.round(left / amplitude, PIVOT_DIGITS)
    points = support.select(*features)
    while len(chosen) < n:
        left = remaining_variance(params, chosen)(F.struct(*features)) if len(chosen) else F.lit(1.0)
        rows = points.withColumn("p_left", left).where(F.col("p_left") > 0).orderBy(F.desc("p_left"), *features).limit(PIVOT_ROWS + 1).collect()
        if not rows:
            break
        x, = to_arrays([r[:-1] for r in rows[:PIVOT_ROWS]], features)
        bar = rows[PIVOT_ROWS]["p_left"] if len(rows) > PIVOT_ROWS else 0.0
        x = x[np.lexsort(x.T[::-1])]
        known = np.zeros((len(x), 0))
        if len(chosen):
            known = forward(cholesky(kernel_block(params, chosen, chosen))[0], kernel_block(params, chosen, x)).T
        variance, first = amplitude - np.square(known).sum(1), True
        while len(chosen) < n:
            best = int(np.argmax(share(variance)))
            if not first and share(variance[best]) <= bar or share(variance[best]) <= 0:
                break
            column = (kernel_block(params, x, x[best:best + 1])[:, 0] - known @ known[best]) / np.sqrt(variance[best])
            known, chosen, first = np.column_stack([known, column]), np.vstack([chosen, x[best]]), False
            variance = variance - column ** 2
            variance[best] = 0.0
        if first:
            break
    return chosen


def gram_sums(support: DataFrame, features, z: np.ndarray, param_sets: list[dict], collapsed: bool = False, per_point: bool = False):
    """Per parameter set, all sums over the support that its solution and likelihood need.

    ``(K_zx W K_xz, K_zx W y, y W y, log of the noise, rows)``, from one pass for all sets,
    white noise included: a point stands for ``count`` rows (1 unless ``collapsed``) of noise
    ``noise`` plus the set's white noise each. ``per_point`` adds to a point's noise the variance
    that the inducing points leave unexplained there (Snelson and Ghahramani 2006). Every task reduces its points to one upper
    triangle per set and Spark adds up the triangles row by row, so what reaches the driver
    depends on the inducing points only.
    """
    m = len(z)
    spark = support.sparkSession
    inverses = [forward(cholesky(kernel_block(p, z, z))[0], np.eye(m)).T if per_point else None for p in param_sets]
    shared = spark.sparkContext.broadcast((z, param_sets, inverses))

    def reduce_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, sets, factors = shared.value
        sums = [np.zeros((m, m + 1)) for _ in sets]
        scalars = np.zeros((len(sets), 3))
        for batch in batches:
            x, y = batch[features].to_numpy(float), batch["y"].to_numpy(float)
            noise, count, within = (batch[c].to_numpy(float) for c in ("noise", "count", "within"))
            for total, row, params, factor in zip(sums, scalars, sets, factors):
                each = noise + params["white"]
                row += ((within / each).sum(), ((count - 1) * np.log(each) + np.log(count)).sum(), count.sum())
                for rows in row_blocks(x, m):
                    k = kernel_block(params, x[rows], points)
                    own = each[rows] / count[rows]
                    if factor is not None:
                        own = own + np.maximum(params["amplitude"] - np.square(k @ factor).sum(1), 0.0)
                    row[:2] += ((y[rows] ** 2 / own).sum(), np.log(own).sum())
                    wk = k / own[:, None]
                    total[:, :m] += k.T @ wk
                    total[:, m] += wk.T @ y[rows]
        for s, (total, row) in enumerate(zip(sums, scalars)):
            yield pd.DataFrame({"s": s, "i": np.arange(m + 1), "v": [total[i, i:] for i in range(m)] + [row]})

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        # One array per task, GRAM_TASKS at most.
        return pd.DataFrame({"s": frame["s"].iloc[:1], "i": frame["i"].iloc[:1], "v": [np.sum(np.stack(frame["v"]), axis=0)]})

    rows, inner = (F.col("count"), F.col("within")) if collapsed else (F.lit(1.0), F.lit(0.0))
    # Few enough tasks that their triangles stay small next to the support itself.
    parts = support.select(*features, "y", "noise", rows.alias("count"), inner.alias("within")).coalesce(
        max(2 * spark.sparkContext.defaultParallelism, GRAM_TASKS))
    kind = "s int, i int, v array<double>"
    summed = parts.mapInPandas(reduce_part, kind).groupBy("s", "i").applyInPandas(add_up, kind).collect()
    grams, scalars = np.zeros((len(param_sets), m, m + 1)), np.zeros((len(param_sets), 3))
    for r in summed:
        if r.i == m:
            scalars[r.s] = r.v
        else:
            grams[r.s, r.i, r.i:] = r.v
            grams[r.s, r.i + 1:, r.i] = r.v[1:-1]
    return [(g[:, :m], g[:, m], *map(float, row)) for g, row in zip(grams, scalars)]


def _from_sums(params, z, gram, b, yy, log_noise, rows):
    """Factors and likelihood of one parameter set from its sums."""
    lower_z, jitter = cholesky(kernel_block(params, z, z))
    lower_a, _ = cholesky(lower_z @ lower_z.T + gram)
    v = forward(lower_a, b)
    lml = -0.5 * (yy - v @ v) - np.log(np.diag(lower_a)).sum() + np.log(np.diag(lower_z)).sum()
    lml -= 0.5 * (log_noise + rows * np.log(2 * np.pi))
    return lower_z, lower_a, v, float(lml), jitter


def solve_sparse(support: DataFrame, features, kernel: KernelConfig, z: np.ndarray,
                 collapsed: bool = False, y_mean: float = 0.0, y_scale: float = 1.0, per_point: bool = False) -> Solution:
    """Fit on ``support`` columns: features, normalised ``y``, ``noise`` and, if collapsed,
    ``count`` rows per point with ``noise`` per row and ``within`` sum of squares."""
    params = kernel.params(len(features))
    (gram, b, yy, log_noise, rows), = gram_sums(support, features, z, [params], collapsed, per_point)
    _check_finite(z, gram, b)
    lower_z, lower_a, v, lml, jitter = _from_sums(params, z, gram, b, yy, log_noise, rows)
    eye = np.eye(len(z))
    inverse_z, inverse_a = forward(lower_z, eye), forward(lower_a, eye)
    return Solution(z, inverse_a.T @ v, inverse_z.T.copy(), inverse_a.T.copy(), params,
                    y_mean, y_scale, lml, jitter)


def search_sparse(support: DataFrame, features, kernel: KernelConfig, z: np.ndarray,
                  collapsed: bool = False, n: int = 15, rounds: int = 12, seed: int = 42, per_point: bool = False):
    """Best kernel by the inducing-point likelihood; one pass per round for all candidates.

    Rounds narrow the design around the best candidate until its box is at most BOX of the
    bounds and the last two rounds differ by less than TOLERANCE in likelihood; ``rounds`` is
    the most, running out of them warns.
    """
    free = kernel.free(len(features))
    outer = np.log([b for _, _, b in free])
    best = np.clip(np.log([v for _, v, _ in free]), outer[:, 0], outer[:, 1])
    bounds, top = outer, -np.inf
    for r in range(rounds):
        thetas = candidate_thetas(best, bounds, n, seed + r)
        kernels = [kernel.with_free(len(features), np.exp(t)) for t in thetas]
        sets = [k.params(len(features)) for k in kernels]
        scores = []
        for i, (params, sums) in enumerate(zip(sets, gram_sums(support, features, z, sets, collapsed, per_point))):
            try:
                scores.append((_from_sums(params, z, *sums)[3], -i))
            except ValueError:
                scores.append((-np.inf, -i))
        before, (top, winner) = top, max(scores)
        best = thetas[-winner]
        share = 0.35 ** (r + 1)
        width = (outer[:, 1] - outer[:, 0]) * share / 2
        bounds = np.column_stack([np.maximum(best - width, outer[:, 0]),
                                  np.minimum(best + width, outer[:, 1])])
        if share <= BOX and top - before < TOLERANCE:
            break
    else:
        warnings.warn(f"the kernel search stopped after {rounds} rounds without converging; raise rounds", stacklevel=3)
    return kernel.with_free(len(features), np.exp(best)), float(top)
