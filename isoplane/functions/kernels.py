"""Covariance functions, as Spark columns and as numpy blocks.

Formulas: Rasmussen and Williams 2006, chapter 4, with
``d2 = sum(((x_k - z_k) / l_k)**2)``.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from isoplane.spec import KernelConfig

BLOCK_CELLS = 4_000_000


def squared_distance(x: list[Column], z: list, scales) -> Column:
    total = F.lit(0.0)
    for a, b, s in zip(x, z, scales):
        total = total + F.pow((a - b) / F.lit(float(s)), F.lit(2.0))
    return total


def kernel_column(kernel: KernelConfig, d2: Column) -> Column:
    """Covariance of two points at squared scaled distance ``d2`` (no white noise)."""
    if kernel.kernel_type == "rbf":
        base = F.exp(-0.5 * d2)
    elif kernel.kernel_type == "rq":
        base = F.pow(1 + d2 / (2 * kernel.rq_alpha), F.lit(-kernel.rq_alpha))
    else:
        r = F.sqrt(d2) * math.sqrt(2 * kernel.nu)
        poly = {0.5: F.lit(1.0), 1.5: 1 + r, 2.5: 1 + r + r * r / 3}[kernel.nu]
        base = poly * F.exp(-r)
    return base if kernel.white_noise else kernel.constant * base


def kernel_profile(kernel: KernelConfig, support):
    """Function of a struct of features: the covariances with every support point.

    ``support`` is a size-checked list; it travels with the function.
    """
    z = np.array([list(p) for p in support], dtype=float)
    params = kernel.params(z.shape[1])

    @F.arrow_udf("array<double>")
    def profile(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = feature_matrix(batch)
            cells = np.concatenate([kernel_block(params, x[rows], z).ravel() for rows in row_blocks(x, len(z))])
            yield pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(z), cells)

    return profile


def kernel_sums(kernel: KernelConfig, support):
    """Function of a struct of features: sum and least of the covariances with all support points.

    Reduced where they are computed: two numbers per row leave the function.
    """
    z = np.array([list(p) for p in support], dtype=float)
    params = kernel.params(z.shape[1])

    @F.arrow_udf("struct<total: double, least: double>")
    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = feature_matrix(batch)
            parts = [(k.sum(1), k.min(1)) for k in (kernel_block(params, x[rows], z) for rows in row_blocks(x, len(z)))]
            total, least = (np.concatenate(p) if p else np.zeros(0) for p in zip(*parts)) if parts else (np.zeros(0),) * 2
            yield pa.StructArray.from_arrays([pa.array(total), pa.array(least)], ["total", "least"])

    return sums


def kernel_block(params: dict, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Covariances between all rows of ``x`` and of ``z`` (no white noise)."""
    d2 = np.zeros((len(x), len(z)))
    for k in range(len(params["scales"])):
        d2 += scaled_squares(params, x, z, k)
    if params["type"] == "rbf":
        base = np.exp(-0.5 * d2)
    elif params["type"] == "rq":
        base = (1 + d2 / (2 * params["alpha"])) ** -params["alpha"]
    else:
        r = np.sqrt(d2 * (2 * params["nu"]))
        poly = {0.5: 1.0, 1.5: 1 + r, 2.5: 1 + r + r * r / 3}[params["nu"]]
        base = poly * np.exp(-r)
    return params["amplitude"] * base


def kernel_slopes(params: dict, x: np.ndarray, z: np.ndarray):
    """Covariances of all rows of ``x`` and ``z``, and what their derivatives are made of.

    Returns ``k``, ``g`` and ``h``: by the log of length scale ``l_j`` the covariance changes by
    ``g * ((x_j - z_j) / l_j)**2``, by the log of the amplitude by ``k``, and by the log of the
    rational quadratic's alpha by ``h`` (None for other kernels).
    """
    d2 = np.zeros((len(x), len(z)))
    for j in range(len(params["scales"])):
        d2 += scaled_squares(params, x, z, j)
    h, amplitude = None, params["amplitude"]
    if params["type"] == "rbf":
        k = g = amplitude * np.exp(-0.5 * d2)
    elif params["type"] == "rq":
        u = 1 + d2 / (2 * params["alpha"])
        k = amplitude * u ** -params["alpha"]
        g = k / u
        h = k * (d2 / (2 * u) - params["alpha"] * np.log(u))
    else:
        r = np.sqrt(d2 * (2 * params["nu"]))
        e = amplitude * np.exp(-r)
        if params["nu"] == 0.5:
            k, g = e, e / np.where(r > 0, r, np.inf)
        elif params["nu"] == 1.5:
            k, g = (1 + r) * e, 3 * e
        else:
            k, g = (1 + r + r * r / 3) * e, 5 / 3 * (1 + r) * e
    return k, g, h


def scaled_squares(params: dict, x: np.ndarray, z: np.ndarray, j: int) -> np.ndarray:
    """What input ``j`` adds to the squared distance of all rows of ``x`` and ``z``.

    The last ``coded`` inputs are category codes: two levels differ as their columns would, one
    per level and of one scale, by twice an inverse square; a missing one (below 0) has no column.
    """
    scale = params["scales"][j]
    if j >= len(params["scales"]) - params.get("coded", 0):
        sides = np.add.outer((x[:, j] >= 0).astype(float), (z[:, j] >= 0).astype(float))
        return np.where(np.equal.outer(x[:, j], z[:, j]), 0.0, sides / scale ** 2)
    step = np.subtract.outer(x[:, j] / scale, z[:, j] / scale)
    return step * step


def feature_matrix(batch: pa.Array) -> np.ndarray:
    """Arrow struct of feature columns as a matrix, missing values as NaN."""
    return np.column_stack([f.to_numpy(zero_copy_only=False) for f in batch.flatten()])


def row_blocks(x: np.ndarray, width: int):
    """Slices of rows small enough that a block against ``width`` points stays in memory."""
    size = max(1, BLOCK_CELLS // max(width, 1))
    for start in range(0, len(x), size):
        yield slice(start, start + size)
