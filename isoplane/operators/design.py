"""Latin-hypercube designs of any size without a shuffle.

Each parameter's strata are dealt out by a keyed permutation of the row numbers:
in every round a row swaps places, or not, with the partner ``key - x`` (mod n),
as decided by a keyed bit both partners share (Hoang, Morris, Rogaway 2012).
Every row finds its stratum alone, so a design needs no sort and no exchange.
"""

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PRIME = 2147483647
ROUNDS = 24


def design_keys(n_dims: int, seed: int) -> list[dict]:
    """Round and jitter constants of each parameter."""
    draw = random.Random(seed)

    def pair():
        return draw.randrange(1, PRIME), draw.randrange(PRIME)

    return [{"rounds": [(draw.randrange(1 << 62), *pair()) for _ in range(ROUNDS)],
             "jitter": pair()} for _ in range(n_dims)]


def _mixed(x, a, b):
    """Keyed value below PRIME; every product stays under 2**62, for any x below that."""
    y = (x % PRIME * a + x // PRIME + b) % PRIME
    return y * y % PRIME


def _unit_samples(ids, n, keys):
    x = ids
    for key, a, b in keys["rounds"]:
        partner = (key - x) % n
        x = np.where(_mixed(np.maximum(x, partner), a, b) % 2 == 1, partner, x)
    return (x + _mixed(ids, *keys["jitter"]) / PRIME) / n


def unit_samples(ids: np.ndarray, n: int, keys: list[dict]) -> np.ndarray:
    """Samples in [0, 1) of the given ids (0..n-1), one column per parameter."""
    return np.column_stack([_unit_samples(ids, n, k) for k in keys])


def unit_design(n: int, n_dims: int, seed: int = 42):
    """Function of an id column (0..n-1) giving an array of samples in [0, 1)."""
    all_keys = design_keys(n_dims, seed)

    @F.arrow_udf("array<double>")
    def samples(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            unit = unit_samples(ids.to_numpy(), n, all_keys)
            yield pa.ListArray.from_arrays(np.arange(len(unit) + 1, dtype=np.int32) * n_dims, unit.ravel())

    return samples


def lhs_design(spark: SparkSession, n: int, ranges: dict, seed: int = 42) -> DataFrame:
    """``sample_id`` 1..n and one column per parameter.

    Of the n equal strata of each parameter range every one is hit exactly once.
    """
    if n < 1:
        raise ValueError("a design needs at least one sample")
    for name, (lo, hi) in ranges.items():
        if not lo < hi:
            raise ValueError(f"{name}: lower bound must be below the upper bound")
    samples = unit_design(n, len(ranges), seed)
    units = spark.range(n).select("id", samples("id").alias("u"))
    return units.select((F.col("id") + 1).alias("sample_id"),
                        *[to_range(F.col("u")[i], lo, hi).alias(name)
                          for i, (name, (lo, hi)) in enumerate(ranges.items())])


def to_range(unit: Column, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + unit * F.lit(float(hi) - float(lo))
