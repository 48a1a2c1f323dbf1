"""Gaussian-process fit and prediction.

The dense solve sees support points only: conditions, of which there are at most
``max_support``, or a fixed number of inducing points. Rows are reduced to them
by Spark aggregates, and predictions are made where the rows are.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from isoplane.functions.kernels import feature_matrix, kernel_block, kernel_slopes, row_blocks, scaled_squares
from isoplane.sources.tables import col, number
from isoplane.spec import CONSTANT_NOISE, KernelConfig

MAX_SUPPORT = 2_000



@dataclass
class Solution:
    """Result of a fit: prediction is ``k w`` and ``k** - |k A|**2 + |k B|**2``.

    With ``noise`` it is an iterative fit: A preconditions the solves ``k** - k (K + noise)^-1 k'``.
    """

    points: np.ndarray
    weights: np.ndarray
    shrink: np.ndarray
    grow: np.ndarray | None
    params: dict
    y_mean: float
    y_scale: float
    lml: float
    jitter: float = 0.0
    noise: np.ndarray | None = None


def noise_column(model: str, constant: float = CONSTANT_NOISE, std="std", count="count") -> Column:
    """Noise variance of a replicate summary row."""
    if model == "std":
        return F.pow(F.col(std), F.lit(2.0))
    if model == "sem":
        return F.pow(F.col(std) / F.sqrt(F.col(count)), F.lit(2.0))
    if model == "constant":
        return F.lit(float(constant))
    raise ValueError("noise must be 'std', 'sem', or 'constant'")


def cholesky(a: np.ndarray):
    """Lower factor; when the matrix is numerically singular a growing jitter is added."""
    base = 1e-10 * np.trace(a) / len(a)
    for jitter in [0.0] + [base * 10.0 ** k for k in range(7)]:
        try:
            return np.linalg.cholesky(a + jitter * np.eye(len(a))), jitter
        except np.linalg.LinAlgError:
            continue
    raise ValueError("the covariance matrix is not positive definite")


def forward(lower: np.ndarray, b: np.ndarray, block: int = 64) -> np.ndarray:
    """Solve ``lower z = b`` by blocks of rows."""
    z = b.astype(float)
    for at in range(0, len(z), block):
        rows = slice(at, at + block)
        z[rows] -= lower[rows, :at] @ z[:at]
        z[rows] = np.linalg.solve(lower[rows, rows], z[rows])
    return z


def _check_finite(*arrays):
    if not all(np.isfinite(a).all() for a in arrays):
        raise ValueError("model inputs hold missing or infinite values")


def log_likelihood(params, x, y, noise):
    """Log marginal likelihood and the factor it came from."""
    lower, jitter = cholesky(kernel_block(params, x, x) + np.diag(noise + params["white"]))
    z = forward(lower, y)
    lml = -0.5 * z @ z - np.log(np.diag(lower)).sum() - 0.5 * len(y) * np.log(2 * np.pi)
    return float(lml), lower, z, jitter


def collapsed_likelihood(params, x, y, counts, within, constant):
    """Likelihood of all rows from their conditions, for constant row noise.

    n rows over m distinct inputs equal m points with noise divided by the row
    count, up to terms in the within-condition sum of squares.
    """
    row_noise = constant + params["white"]
    lower, jitter = cholesky(kernel_block(params, x, x) + np.diag(row_noise / counts))
    z = forward(lower, y)
    lml = -0.5 * z @ z - np.log(np.diag(lower)).sum() - 0.5 * len(y) * np.log(2 * np.pi)
    rows = counts.sum()
    lml -= 0.5 * ((rows - len(y)) * np.log(2 * np.pi * row_noise) + within / row_noise
                  + np.log(counts).sum())
    return float(lml), lower, z, jitter


def parameter_slopes(kernel: KernelConfig, params: dict, x: np.ndarray, z: np.ndarray, contract, white: float) -> np.ndarray:
    """What ``contract`` makes of the covariance's derivative by the log of every free parameter.

    ``contract`` reduces a matrix over ``x`` and ``z`` to numbers; ``white`` is its value for white noise.
    """
    k, g, h = kernel_slopes(params, x, z)
    out = [contract(g * scaled_squares(params, x, z, j)) for j in range(len(params["scales"]))]
    if sum(name == "length_scale" for name, _, _ in kernel.free(x.shape[1])) == 1:
        out = [np.sum(out, axis=0)]
    out.append(white if kernel.white_noise else contract(k))
    return np.array(out + ([contract(h)] if h is not None else []))


def likelihood_slope(kernel: KernelConfig, x, y, noise, counts=None, within=0.0):
    """Log likelihood and its gradient by the logs of the free parameters.

    By a parameter t it changes by ``(a' dK a - trace(K^-1 dK)) / 2`` with ``a = K^-1 y``
    (Rasmussen and Williams 2006, 5.9); for conditions of ``counts`` rows, white noise also acts
    inside them.
    """
    params = kernel.params(x.shape[1])
    if counts is None:
        lml, lower, z, jitter = log_likelihood(params, x, y, noise)
        share = np.ones(len(x))
    else:
        lml, lower, z, jitter = collapsed_likelihood(params, x, y, counts, within, noise)
        share = 1 / counts
    inverse = forward(lower, np.eye(len(x)))
    a = inverse.T @ z
    weights = np.outer(a, a) - inverse.T @ inverse
    white = params["white"] * (np.diag(weights) * share).sum()
    if counts is not None and params["white"]:
        row_noise = noise + params["white"]
        white -= params["white"] * ((counts.sum() - len(y)) / row_noise - within / row_noise ** 2)
    return lml, 0.5 * parameter_slopes(kernel, params, x, x, lambda d: np.vdot(weights, d), white)


def solve(kernel: KernelConfig, x, y, noise, counts=None, within=0.0, y_mean=None, y_scale=None):
    """Exact fit. With ``counts`` the noise is per row and the points are conditions."""
    _check_finite(x, y, noise)
    params = kernel.params(x.shape[1])
    if y_mean is None:
        y_mean, y_scale = float(np.mean(y)), float(np.std(y)) or 1.0
    target = (y - y_mean) / y_scale
    if counts is None:
        lml, lower, z, jitter = log_likelihood(params, x, target, noise)
    else:
        lml, lower, z, jitter = collapsed_likelihood(
            params, x, target, counts, within / y_scale ** 2, noise)
    inverse = forward(lower, np.eye(len(x)))
    return Solution(x, inverse.T @ z, inverse.T.copy(), None, params, y_mean, y_scale, lml, jitter)


def preconditioner(factor: np.ndarray, noise: np.ndarray):
    """Function that solves ``(L L' + diag(noise)) u = b``, and that matrix's log determinant."""
    scaled = factor / noise[:, None]
    inner, _ = cholesky(np.eye(factor.shape[1]) + factor.T @ scaled)
    scaled = forward(inner, scaled.T)

    def solve_columns(b):
        return b / noise[:, None] - scaled.T @ (scaled @ b)

    return solve_columns, float(np.log(noise).sum() + 2 * np.log(np.diag(inner)).sum())


def conjugate_gradients(product, precondition, b: np.ndarray, tolerance: float, max_steps: int):
    """Solutions of ``A u = b`` for all columns, and every step's coefficients (0 once a column is solved).

    A column is solved when its residual has fallen to ``tolerance`` of its length; more than
    ``max_steps`` raise.
    """
    out, left = np.zeros_like(b), b.copy()
    z = precondition(left)
    way, rz = z.copy(), (left * z).sum(0)
    enough, steps = tolerance * np.sqrt((b * b).sum(0)), []
    while (open_ := np.sqrt((left * left).sum(0)) > enough).any():
        if len(steps) == max_steps:
            raise ValueError(f"conjugate gradients did not converge in {max_steps} steps; raise the rank or the noise")
        moved = product(way)
        alpha = np.where(open_, rz / np.where(open_, (way * moved).sum(0), 1.0), 0.0)
        out += alpha * way
        left -= alpha * moved
        z = precondition(left)
        new = (left * z).sum(0)
        beta = np.where(open_, new / np.where(open_, rz, 1.0), 0.0)
        way, rz = z + beta * way, np.where(open_, new, rz)
        steps.append((alpha, beta))
    return out, steps


SOLVED_TOGETHER = 512
VARIANCE_TOLERANCE = 1e-9


def _explained(solution: Solution, k: np.ndarray) -> np.ndarray:
    """``k (K + noise)^-1 k'`` for the rows of ``k``, by solves of many columns at a time."""
    points, noise, params = solution.points, solution.noise, solution.params
    precondition, _ = preconditioner(solution.shrink, noise)

    def product(v):
        out = noise[:, None] * v
        for rows in row_blocks(points, len(points)):
            out[rows] += kernel_block(params, points[rows], points) @ v
        return out

    total = np.empty(len(k))
    for at in range(0, len(k), SOLVED_TOGETHER):
        b = k[at:at + SOLVED_TOGETHER].T.copy()
        total[at:at + SOLVED_TOGETHER] = (b * conjugate_gradients(product, precondition, b, VARIANCE_TOLERANCE, 1_000)[0]).sum(0)
    return total


def evaluate(solution: Solution, x: np.ndarray):
    """Mean and std at the rows of ``x``, in block-sized pieces."""
    mean, std = np.empty(len(x)), np.empty(len(x))
    prior = solution.params["amplitude"] + solution.params["white"]
    for rows in row_blocks(x, len(solution.points)):
        k = kernel_block(solution.params, x[rows], solution.points)
        mean[rows] = k @ solution.weights
        if solution.noise is not None:
            variance = prior - _explained(solution, k)
        else:
            variance = prior - np.square(k @ solution.shrink).sum(axis=1)
        if solution.grow is not None:
            variance += np.square(k @ solution.grow).sum(axis=1)
        std[rows] = np.sqrt(np.maximum(variance, 0.0))
    return mean * solution.y_scale + solution.y_mean, std * abs(solution.y_scale)


def predictor(spark: SparkSession, solution: Solution):
    """Vectorised function of a struct of features giving ``struct(mean, std)``.

    Only the feature columns leave the JVM. The model is broadcast; its size is
    bounded by the support limit of the fit.
    """
    shared = spark.sparkContext.broadcast(vars(solution))

    @F.arrow_udf("mean double, std double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = Solution(**shared.value)
        for batch in batches:
            x = feature_matrix(batch)
            known = np.isfinite(x).all(axis=1)
            mean, std = np.full(len(x), np.nan), np.full(len(x), np.nan)
            mean[known], std[known] = evaluate(fitted, x[known])
            yield pa.StructArray.from_arrays(
                [pa.array(mean, mask=~known), pa.array(std, mask=~known)], names=["mean", "std"])

    return predict


def with_prediction(df: DataFrame, solution: Solution, features: list[Column],
                    mean: str = "mean", std: str = "std") -> DataFrame:
    """``df`` with predicted mean and std; rows with a missing feature get NULL."""
    predict = predictor(df.sparkSession, solution)
    inputs = F.struct(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    return df.withColumn("p_gp", predict(inputs)).withColumns(
        {mean: F.col("p_gp.mean"), std: F.col("p_gp.std")}).drop("p_gp")


def to_arrays(rows, features, *values):
    """Collected support rows as numpy arrays."""
    frame = pd.DataFrame(rows, columns=[*features, *values]) if rows else pd.DataFrame(
        columns=[*features, *values])
    x = frame[list(features)].to_numpy(dtype=float)
    return x, *[frame[v].to_numpy(dtype=float) for v in values]


def condition_collapse(df: DataFrame, controls, target: str,
                       constant: float = CONSTANT_NOISE) -> DataFrame:
    """Rows with equal inputs become one support point.

    ``mean`` of the target, ``count``, ``within`` (sum of squares around the mean)
    and ``noise`` (row noise over the count).
    """
    y = number(target)
    return df.groupBy([col(c) for c in controls]).agg(
        F.avg(y).alias("mean"), F.count(y).alias("count"),
        (F.var_pop(y) * F.count(y)).alias("within"),
        (F.lit(float(constant)) / F.count(y)).alias("noise"))
