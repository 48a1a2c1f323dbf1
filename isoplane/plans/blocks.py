"""One model per block of a replicate summary, all blocks in parallel.

Exact models solve a block of up to ``max_support`` conditions in one task and refuse
larger ones. Sparse models go through inducing points: conditions are dealt into
chunks, every chunk meets its block's inducing points, and Spark adds the chunk sums
up, so no task holds a whole large block.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from isoplane.cluster import materialize
from isoplane.functions.scalars import all_of
from isoplane.functions.kernels import kernel_block
from isoplane.operators.replicates import join_conditions
from isoplane.plans import gp, sparse
from isoplane.sources.tables import col, number
from isoplane.spec import CONSTANT_NOISE, KernelConfig

CHUNK_ROWS = 20_000
NAMED = 5


def block_models(df: DataFrame, block: str, controls, measure: str, kernel: KernelConfig,
                 noise: str = "std", constant: float = CONSTANT_NOISE,
                 max_support: int = gp.MAX_SUPPORT, inducing: int = sparse.INDUCING, seed: int = 42,
                 method: str = "exact") -> DataFrame:
    """Fit one summary column, ``measure``, of every block over its conditions.

    ``df`` is a summary with ``std`` and ``count``. Returns the block, the
    conditions, the observed ``mean``, ``fit_mean``, ``fit_std`` and the block's
    log likelihood ``lml``. Conditions with a missing block are left out; missing
    inputs, values or noise raise, naming blocks. ``method`` is ``"exact"``, which raises
    for blocks of more than ``max_support`` conditions, or ``"sparse"`` for all blocks.
    """
    if method not in ("exact", "sparse"):
        raise ValueError("method must be 'exact' or 'sparse'")
    xs = [f"x{i}" for i in range(len(controls))]
    points = materialize(df.select(
        col(block).alias("block"), *[number(c).alias(x) for c, x in zip(controls, xs)],
        number(measure).alias("mean"), gp.noise_column(noise, constant).alias("noise")).where("block is not null"))
    broken = points.where(~all_of(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (*xs, "mean", "noise")))
    if names := [r.block for r in broken.select("block").distinct().orderBy("block").limit(NAMED).collect()]:
        raise ValueError(f"missing inputs, values or noise in blocks {names}; keep complete cases or choose another noise model")
    sizes = points.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("y_mean"),
                                        F.stddev_pop("mean").alias("y_scale"))
    if method == "exact":
        large = sizes.where(F.col("n") > max_support).orderBy(F.desc("n"), "block").limit(NAMED).collect()
        if large:
            raise ValueError(f"more than max_support, {max_support}, conditions in blocks "
                             f"{ {r.block: r.n for r in large} }; raise it or use method='sparse'")
    kind = points.schema["block"].dataType.simpleString()
    schema = f"block {kind}, {', '.join(f'{x} double' for x in xs)}, mean double, fit_mean double, fit_std double, lml double"

    def fit_block(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[xs].to_numpy(float)
        fitted = gp.solve(kernel, x, frame["mean"].to_numpy(float), frame["noise"].to_numpy(float))
        mean, std = gp.evaluate(fitted, x)
        return frame[["block", *xs, "mean"]].assign(fit_mean=mean, fit_std=std, lml=fitted.lml)

    if method == "exact":
        out = points.groupBy("block").applyInPandas(fit_block, schema)
    else:
        sized = join_conditions(points, materialize(sizes), ["block"], ["n", "y_mean", "y_scale"], "n")
        out = _sparse_blocks(sized, xs, kernel, inducing, seed, kind, schema)
    return out.withColumnsRenamed({"block": block, **dict(zip(xs, controls))})


def _sparse_blocks(sized: DataFrame, xs, kernel, inducing, seed, kind, schema) -> DataFrame:
    """Inducing-point fits of all blocks at once."""
    params = kernel.params(len(xs))
    scale = F.when(F.col("y_scale") > 0, F.col("y_scale")).otherwise(1.0)
    chunks = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")
    place = F.xxhash64(*xs, F.lit(seed))
    rows = sized.withColumns({"y_scale": scale, "y": (F.col("mean") - F.col("y_mean")) / scale,
                              "chunk": F.pmod(F.xxhash64(*xs), chunks).cast("int")})

    def for_every_chunk(table):
        return table.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))

    # Only points under a hash limit are ranked: about 8 per wanted one, more until every block has enough.
    share = 8.0
    while True:
        near = rows.where(place / 2.0 ** 64 + 0.5 <= share * inducing / F.col("n"))
        ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(place, *xs)))
        chosen = materialize(ranked.where(F.col("r") <= inducing).select("block", "n", "y_mean", "y_scale", *xs))
        short = chosen.groupBy("block").agg(F.count(F.lit(1)).alias("got"), F.max("n").alias("n")).where(
            (F.col("got") < F.least(F.col("n"), F.lit(inducing))) & (share * inducing < F.col("n")))
        missing = rows.where(share * inducing < F.col("n")).select("block").distinct().join(chosen.select("block"), "block", "left_anti")
        if short.isEmpty() and missing.isEmpty():
            break
        share *= 16
    # New column identities: the points it meets below have the same origin.
    chosen = chosen.select([F.col(c).alias(c) for c in chosen.columns])

    def chunk_sums(frame: pd.DataFrame, inducing_points: pd.DataFrame) -> pd.DataFrame:
        z = inducing_points.sort_values(xs)[xs].to_numpy(float)
        k = kernel_block(params, frame[xs].to_numpy(float), z)
        y, noise = frame["y"].to_numpy(float), frame["noise"].to_numpy(float) + params["white"]
        weighted = k / noise[:, None]
        gram, b = k.T @ weighted, weighted.T @ y
        cells = [np.append(gram[i, i:], b[i]) for i in range(len(z))]
        cells.append(np.array([(y * y / noise).sum(), np.log(noise).sum(), len(y)]))
        return pd.DataFrame({"block": frame["block"].iloc[0], "i": np.arange(len(cells)), "v": cells})

    sums = rows.groupBy("block", "chunk").cogroup(for_every_chunk(chosen).groupBy("block", "chunk")).applyInPandas(
        chunk_sums, f"block {kind}, i int, v array<double>")
    cells = sums.select("block", "i", F.posexplode("v").alias("k", "v")).groupBy("block", "i", "k").agg(F.sum("v").alias("v"))

    def solve_block(frame: pd.DataFrame, inducing_points: pd.DataFrame) -> pd.DataFrame:
        z = inducing_points.sort_values(xs)[xs].to_numpy(float)
        m = len(z)
        i, k, v = (frame[c].to_numpy() for c in ("i", "k", "v"))
        gram, b = np.zeros((m, m)), np.zeros(m)
        last = (i < m) & (k == m - i)
        inner = (i < m) & (k < m - i)
        b[i[last]] = v[last]
        gram[i[inner], i[inner] + k[inner]] = v[inner]
        gram[i[inner] + k[inner], i[inner]] = v[inner]
        yy, log_noise, n = v[i == m][np.argsort(k[i == m])]
        lower_z, lower_a, solved, lml, _ = sparse._from_sums(params, z, gram, b, yy, log_noise, n)
        inverse_z, inverse_a = gp.forward(lower_z, np.eye(m)), gp.forward(lower_a, np.eye(m))
        first = inducing_points.iloc[0]
        return pd.DataFrame({
            "block": first["block"], "n": first["n"], "y_mean": first["y_mean"], "y_scale": first["y_scale"],
            "z": list(z), "w": inverse_a.T @ solved, "shrink": list(inverse_z.T), "grow": list(inverse_a.T), "lml": lml})

    solved = cells.groupBy("block").cogroup(chosen.groupBy("block")).applyInPandas(
        solve_block, f"block {kind}, n long, y_mean double, y_scale double, z array<double>, w double, "
                     "shrink array<double>, grow array<double>, lml double")

    def predict_chunk(frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        fitted = gp.Solution(*(np.stack(model[c]) if c != "w" else model[c].to_numpy() for c in ("z", "w", "shrink", "grow")),
                             params, model["y_mean"].iloc[0], model["y_scale"].iloc[0], model["lml"].iloc[0])
        mean, std = gp.evaluate(fitted, frame[xs].to_numpy(float))
        return frame[["block", *xs, "mean"]].assign(fit_mean=mean, fit_std=std, lml=fitted.lml)

    models = for_every_chunk(materialize(solved))
    return rows.groupBy("block", "chunk").cogroup(models.groupBy("block", "chunk")).applyInPandas(predict_chunk, schema)
