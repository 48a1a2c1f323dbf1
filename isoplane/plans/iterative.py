"""Exact fits over more settings than one matrix factor can hold.

Weights come from preconditioned conjugate gradients (Gardner et al. 2018). A product with
the covariance is one Spark job: every task computes blocks of the matrix from the points
and multiplies them at once, so no covariance is ever stored. What the driver holds and
sends grows with the points, not with their square. The log determinant is estimated by
Lanczos quadrature over the steps of the same solves, and its gradient by the same probes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from isoplane.functions.kernels import kernel_block, row_blocks
from isoplane.plans.gp import Solution, _check_finite, conjugate_gradients, parameter_slopes, preconditioner
from isoplane.plans.search import climb
from isoplane.spec import KernelConfig

#: Points whose features and solution vectors the driver may hold: megabytes, not gigabytes.
MAX_POINTS = 200_000
RANK = 128
PROBES = 16
TOLERANCE = 1e-9
MAX_STEPS = 1_000
ROWS = 1_024
#: Noise below this share of the amplitude is raised to it, as a factor's jitter would.
LEAST_NOISE = 1e-8


def pivoted_factor(params: dict, x: np.ndarray, rank: int) -> np.ndarray:
    """Greedy partial Cholesky factor of the covariance: the point of most remaining variance joins next."""
    factor = np.zeros((len(x), min(rank, len(x))))
    left = np.full(len(x), float(params["amplitude"]))
    for k in range(factor.shape[1]):
        at = int(np.argmax(left))
        if left[at] <= 1e-12 * params["amplitude"]:
            return factor[:, :k]
        column = kernel_block(params, x, x[at:at + 1])[:, 0] - factor[:, :k] @ factor[at, :k]
        factor[:, k] = column / np.sqrt(left[at])
        left = np.maximum(left - factor[:, k] ** 2, 0.0)
        left[at] = 0.0
    return factor


class Products:
    """Products with the covariance of ``x`` plus ``noise`` on its diagonal, computed by Spark."""

    def __init__(self, spark: SparkSession, kernel: KernelConfig, x: np.ndarray, noise: np.ndarray):
        self.spark, self.kernel, self.params, self.noise = spark, kernel, kernel.params(x.shape[1]), noise
        self.points = spark.sparkContext.broadcast(x)
        self.blocks = -(-len(x) // ROWS)
        self.tasks = min(self.blocks, max(4 * spark.sparkContext.defaultParallelism, self.blocks // 64))

    def _each(self, work):
        """``work(x, rows)`` of every block of rows, in their order."""
        points = self.points

        def run(batches):
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    out = work(points.value, slice(block * ROWS, (block + 1) * ROWS))
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out.tobytes()], pa.binary())], ["block", "value"])

        blocks = self.spark.range(0, self.blocks, 1, self.tasks)
        found = blocks.mapInArrow(run, "block long, value binary").collect()  # one row of the result per point
        return [np.frombuffer(r["value"]) for r in sorted(found, key=lambda r: r["block"])]

    def __call__(self, v: np.ndarray) -> np.ndarray:
        params, width = self.params, v.shape[1]
        sent = self.spark.sparkContext.broadcast(v)

        def work(x, rows):
            out = np.zeros((len(x[rows]), width))
            for part in row_blocks(x, ROWS):
                out += kernel_block(params, x[rows], x[part]) @ sent.value[part]
            return out

        found = np.concatenate(self._each(work)).reshape(-1, width)
        sent.destroy()
        return found + self.noise[:, None] * v

    def slopes(self, left: np.ndarray, right: np.ndarray, white: np.ndarray) -> np.ndarray:
        """``sum(left * (dK right))`` for every free parameter and column; ``white`` is that of white noise."""
        kernel, params = self.kernel, self.params
        sent = self.spark.sparkContext.broadcast((left, right))

        def work(x, rows):
            u, v = sent.value
            total = 0.0
            for part in row_blocks(x, ROWS):
                total = total + parameter_slopes(kernel, params, x[rows], x[part],
                                                 lambda d, part=part: (u[rows] * (d @ v[part])).sum(0), np.zeros(u.shape[1]))
            return total

        found = np.sum(self._each(work), axis=0).reshape(-1, left.shape[1])
        sent.destroy()
        if kernel.white_noise:
            names = [name for name, _, _ in kernel.free(len(params["scales"]))]
            found[names.index("noise_level")] = white
        return found


def _quadrature(steps, starts: np.ndarray) -> np.ndarray:
    """``e1' log(T) e1`` of every column's Lanczos matrix T, times its squared starting length."""
    out = np.zeros(len(starts))
    for c in range(len(starts)):
        alpha = np.array([a[c] for a, _ in steps if a[c] > 0])
        beta = np.array([b[c] for a, b in steps if a[c] > 0])
        if not len(alpha):
            continue
        diagonal = 1 / alpha
        diagonal[1:] += beta[:-1] / alpha[:-1]
        off = np.sqrt(np.maximum(beta[:-1], 0)) / alpha[:-1]
        values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
        out[c] = starts[c] * (vectors[0] ** 2 @ np.log(np.maximum(values, 1e-300)))
    return out


def _row_noise(kernel: KernelConfig, x, noise, counts):
    """Noise of every point, white noise included, and the share of a row's noise that it gets."""
    params = kernel.params(x.shape[1])
    share = np.ones(len(x)) if counts is None else 1 / counts
    own = (np.broadcast_to(noise, len(x)) + params["white"]) * share
    return np.maximum(own, LEAST_NOISE * params["amplitude"]), share


def fit(spark: SparkSession, kernel: KernelConfig, x, y, noise, counts=None, within=0.0, rank: int = RANK,
        probes: int = PROBES, tolerance: float = TOLERANCE, seed: int = 42, gradient: bool = False):
    """Weights, preconditioning factor, noise and log likelihood, and its gradient when asked for.

    ``y`` is normalised; ``counts``, ``within`` and ``noise`` are as for the factored fit. Solves go on
    until residuals fall below ``tolerance``; only the log determinant and its gradient are
    estimates, from ``probes`` seeded vectors. With a ``rank`` of all points they are exact, too.
    """
    own, share = _row_noise(kernel, x, noise, counts)
    params = kernel.params(x.shape[1])
    factor = pivoted_factor(params, x, rank)
    precondition, log_det = preconditioner(factor, own)
    r = np.random.default_rng(seed)
    z = factor @ r.normal(size=(factor.shape[1], probes)) + np.sqrt(own)[:, None] * r.normal(size=(len(x), probes))
    product = Products(spark, kernel, x, own)
    solved, steps = conjugate_gradients(product, precondition, np.column_stack([y, z]), tolerance, MAX_STEPS)
    a, pz = solved[:, 0], precondition(z)
    log_det += _quadrature([(alpha[1:], beta[1:]) for alpha, beta in steps], (z * pz).sum(0)).mean() if probes else 0.0
    lml = -0.5 * y @ a - 0.5 * log_det - 0.5 * len(y) * np.log(2 * np.pi)
    extra = 0.0
    if counts is not None:
        row_noise, rows = noise + params["white"], counts.sum()
        lml -= 0.5 * ((rows - len(y)) * np.log(2 * np.pi * row_noise) + within / row_noise + np.log(counts).sum())
        extra = (rows - len(y)) / row_noise - within / row_noise ** 2
    slope = None
    if gradient:
        left, right = np.column_stack([a, solved[:, 1:]]), np.column_stack([a, pz])
        found = product.slopes(left, right, params["white"] * (left * share[:, None] * right).sum(0))
        slope = 0.5 * (found[:, 0] - found[:, 1:].mean(1))
        if kernel.white_noise and counts is not None:
            names = [name for name, _, _ in kernel.free(x.shape[1])]
            slope[names.index("noise_level")] -= 0.5 * params["white"] * extra
    product.points.destroy()
    return a, factor, own, float(lml), slope


def solve_iterative(spark: SparkSession, kernel: KernelConfig, x, y, noise, counts=None, within=0.0,
                    y_mean=0.0, y_scale=1.0, **options) -> Solution:
    """Exact fit of ``y`` after its normalisation; stds are solved for where points are predicted."""
    _check_finite(x, y, noise)
    scaled_within = within / y_scale ** 2
    weights, factor, own, lml, _ = fit(spark, kernel, x, (y - y_mean) / y_scale, noise, counts, scaled_within, **options)
    return Solution(x, weights, factor, None, kernel.params(x.shape[1]), y_mean, y_scale, lml, 0.0, own)


def search_iterative(spark: SparkSession, kernel: KernelConfig, x, y, noise, counts=None, within=0.0,
                     max_steps: int = 60, **options):
    """A climb from the given kernel by the estimated likelihood and gradient of fixed probes."""
    width = x.shape[1]
    free = kernel.free(width)
    low, high = np.log([b for _, _, b in free]).T

    def value(theta):
        try:
            _, _, _, lml, slope = fit(spark, kernel.with_free(width, np.exp(theta)), x, y, noise, counts, within, gradient=True, **options)
        except ValueError:
            return -np.inf, np.zeros(len(theta))
        return lml, slope

    theta, lml, _ = climb(value, np.clip(np.log([v for _, v, _ in free]), low, high), low, high, max_steps)
    return kernel.with_free(width, np.exp(theta)), lml
