"""Response models of blocks: one per block, each fitted in its own task, used on new rows.

A block has its own scalers, category levels, replicates, kernel search and solution, as if
its rows had been modelled alone. The models are a table keyed by block. New rows are
reduced to their distinct settings; a block's settings are dealt into chunks that meet
copies of its model, so a block of any size is scored by many tasks.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isoplane.cluster import materialize
from isoplane.operators.replicates import join_conditions
from isoplane.plans import gp, search
from isoplane.sources.tables import col, number, require_columns
from isoplane.spec import CONSTANT_NOISE, AnalysisSpec, KernelConfig

CHUNK_ROWS = 50_000
NAMED = 5
MODEL = ("n long, kernel_type string, nu double, white_noise boolean, length_scale array<double>, constant double, noise_level double, "
         "rq_alpha double, input_mean array<double>, input_scale array<double>, target_mean double, target_scale double, "
         "levels array<array<string>>, points binary, weights binary, shrink binary, y_mean double, y_scale double, lml double")


def block_conditions(df: DataFrame, block: str, spec: AnalysisSpec) -> DataFrame:
    """Distinct settings of every block with the summary of their rows; rows without a block are left out."""
    require_columns(df, [*spec.num_cols, *spec.cat_cols, block], spec.target)
    y = F.col("c_value")
    xs, cs = _names(spec)
    rows = df.select(
        col(block).alias("block"), *[number(c).alias(x) for c, x in zip(spec.num_cols, xs)],
        *[col(c).cast("string").alias(n) for c, n in zip(spec.cat_cols, cs)], number(spec.target).alias("c_value"))
    return rows.where("block is not null").groupBy("block", *xs, *cs).agg(
        F.avg(y).alias("c_mean"), F.stddev_samp(y).alias("c_std"), F.coalesce(F.var_pop(y) * F.count(y), F.lit(0.0)).alias("c_within"),
        F.count(F.lit(1)).alias("c_count"), F.count(y).alias("c_valid"))


def _names(spec: AnalysisSpec):
    return [f"x{i}" for i in range(len(spec.num_cols))], [f"c{i}" for i in range(len(spec.cat_cols))]


def _transformed(frame: pd.DataFrame, spec: AnalysisSpec) -> np.ndarray:
    """Numeric inputs, log columns as log10."""
    x = frame[_names(spec)[0]].to_numpy(float).reshape(len(frame), -1)
    for i, c in enumerate(spec.num_cols):
        if c in spec.log_cols:
            with np.errstate(divide="ignore", invalid="ignore"):
                x[:, i] = np.log10(x[:, i])
    return x


def _encoded(frame: pd.DataFrame, spec: AnalysisSpec, x: np.ndarray, levels) -> np.ndarray:
    """Scaled inputs, then one column per level."""
    dummies = [(frame[n] == v).to_numpy(float) for n, vs in zip(_names(spec)[1], levels) for v in vs]
    return np.column_stack([x, *dummies]) if dummies else x


def _weighted(values, weights):
    """Population mean and spread of summarised rows, missing ones left out; no spread counts as 1."""
    known = np.isfinite(values)
    if not known.any():
        raise ValueError("has an input or target without values")
    v, w = values[known], weights[known]
    mean = (v * w).sum() / w.sum()
    return mean, 1.0 if v.min() == v.max() else np.sqrt(((v - mean) ** 2 * w).sum() / w.sum())


def tuned(kernel: KernelConfig, x, y, noise, counts, within, n: int, starts: int, seed: int) -> KernelConfig:
    """The kernel search of a single model, in one task."""
    free, data = kernel.free(x.shape[1]), (x, y, noise, counts, within)
    bounds = np.log([b for _, _, b in free])
    score, climbing = search._likelihood(kernel, data), search._likelihood_slope(kernel, data)
    thetas = search.candidate_thetas(np.clip(np.log([v for _, v, _ in free]), *bounds.T), bounds, n, seed)
    first = sorted(thetas, key=lambda t: -score(t))[:starts]
    best, _, _ = max((search.climb(climbing, t, *bounds.T) for t in first), key=lambda found: found[1])
    return kernel.with_free(x.shape[1], np.exp(best))


def fit_one(frame: pd.DataFrame, spec: AnalysisSpec, kernel: KernelConfig, constant: float, search_options: dict | None):
    """The model of one block's conditions as a row of ``MODEL``, None when no condition is left."""
    x, weights = _transformed(frame, spec), frame["c_count"].to_numpy(float)
    if any((frame[f"x{i}"] <= 0).any() for i, c in enumerate(spec.num_cols) if c in spec.log_cols):
        raise ValueError("has log columns with values that are not positive")
    scalers = [_weighted(x[:, i], weights) for i in range(x.shape[1])]
    centre, spread = np.array(scalers).reshape(-1, 2).T
    valid = frame["c_valid"].to_numpy(float)
    mean, within = frame["c_mean"].to_numpy(float), frame["c_within"].to_numpy(float)
    t_mean, _ = _weighted(mean, valid)
    t_scale = np.sqrt(np.nansum(within + valid * (mean - t_mean) ** 2) / valid.sum()) or 1.0
    levels = [sorted(frame[n].dropna().unique()) for n in _names(spec)[1]]
    features = _encoded(frame, spec, (x - centre) / spread, levels)
    value, std = (mean - t_mean) / t_scale, frame["c_std"].to_numpy(float) / t_scale
    by_row = spec.mode == "mean"
    keep = np.ones(len(frame), bool) if by_row else np.isfinite(x).all(1) & (weights >= 2)
    if not keep.any():
        return None
    features, value, std, weights, valid, within = (a[keep] for a in (features, value, std, weights, valid, within))
    y = value if by_row or spec.statistic == "mean" else std
    noise = {"constant": np.full(len(y), float(constant)), "std": std ** 2, "sem": std ** 2 / weights}["constant" if by_row else spec.noise]
    if by_row and (valid < weights).any() or not all(np.isfinite(a).all() for a in (features, y, noise)):
        raise ValueError("has conditions with missing inputs, target or noise")
    order = np.lexsort(features.T[::-1])
    features, y, noise, weights, within = (a[order] for a in (features, y, noise, weights, within))
    extra, y_mean, y_scale = {}, float(y.mean()), float(y.std()) or 1.0
    if by_row:
        noise, extra, y_mean, y_scale = float(constant), {"counts": weights, "within": float(within.sum() / t_scale ** 2)}, 0.0, 1.0
    if search_options is not None:
        kernel = tuned(kernel, features, (y - y_mean) / y_scale, noise, extra.get("counts"), extra.get("within", 0.0), **search_options)
    s = gp.solve(kernel, features, y, noise, y_mean=y_mean, y_scale=y_scale, **extra)
    return (len(y), kernel.kernel_type, kernel.nu, kernel.white_noise, kernel.scales(features.shape[1]).tolist(), kernel.constant,
            kernel.noise_level, kernel.rq_alpha, centre.tolist(), spread.tolist(), float(t_mean), float(t_scale), levels,
            s.points.tobytes(), s.weights.tobytes(), np.ascontiguousarray(s.shrink).tobytes(), y_mean, y_scale, s.lml)


def fit_blocks(df: DataFrame, block: str, spec: AnalysisSpec, kernel: KernelConfig | None = None, tune: bool = True,
               constant: float = CONSTANT_NOISE, max_support: int = gp.MAX_SUPPORT, n: int = search.CANDIDATES,
               starts: int = search.STARTS, seed: int = 42) -> DataFrame:
    """A table of models, one row per block of ``df``: the block and ``MODEL``.

    Every block is modelled as ``fit_model`` would model its rows alone: summary of replicates,
    scalers, levels (as text), noise, ``n`` search candidates and ``starts`` climbs unless ``tune``
    is False. A block without a usable condition has no model. Blocks of more than
    ``max_support`` conditions, with missing values or with log columns that are not
    positive raise by name; rows without a block are left out.
    """
    kernel = kernel or KernelConfig()
    conditions = materialize(block_conditions(df, block, spec))
    large = conditions.groupBy("block").count().where(F.col("count") > max_support).orderBy(F.desc("count"), "block").limit(NAMED).collect()
    if large:
        raise ValueError(f"more than max_support, {max_support}, conditions in blocks { {r['block']: r['count'] for r in large} }")
    options = {"n": n, "starts": starts, "seed": seed} if tune else None
    names = [c.strip().split()[0] for c in MODEL.split(", ")]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        which = frame["block"].iloc[0]
        try:
            row = fit_one(frame, spec, kernel, constant, options)
        except ValueError as error:
            raise ValueError(f"block {which!r}: {error}") from error
        return pd.DataFrame([(which, *row)] if row else [], columns=["block", *names])

    kind = conditions.schema["block"].dataType.simpleString()
    return conditions.groupBy("block").applyInPandas(fit, f"block {kind}, {MODEL}").withColumnRenamed("block", block)


def _solution(m: dict):
    """Kernel parameters and solution of a row of ``MODEL``."""
    kernel = KernelConfig(kernel_type=m["kernel_type"], nu=m["nu"], white_noise=m["white_noise"], constant=m["constant"],
                          length_scale=1.0, noise_level=m["noise_level"], rq_alpha=m["rq_alpha"])
    params = kernel.params(1) | {"scales": np.array(m["length_scale"])}
    n = m["n"]
    return gp.Solution(np.frombuffer(m["points"]).reshape(n, -1), np.frombuffer(m["weights"]), np.frombuffer(m["shrink"]).reshape(n, n),
                       None, params, m["y_mean"], m["y_scale"], m["lml"])


def predict_blocks(models: DataFrame, df: DataFrame, block: str, spec: AnalysisSpec, mean: str = "pred_mean", std: str = "pred_std") -> DataFrame:
    """``df`` with the mean and std that its block's model predicts, in original units.

    ``models`` comes from ``fit_blocks`` with the same ``block`` and ``spec``. Rows of unknown or missing
    blocks, with missing numeric inputs or log inputs that are not positive get NULL;
    levels that a block has not seen count as none of its own.
    """
    xs, cs = _names(spec)
    keys = [*[f"p_{x}" for x in xs], *[f"p_{c}" for c in cs]]
    keyed = df.withColumns({"p_block": col(block), **{f"p_{x}": number(c) for c, x in zip(spec.num_cols, xs)},
                            **{f"p_{n}": col(c).cast("string") for c, n in zip(spec.cat_cols, cs)}})
    settings = materialize(keyed.groupBy("p_block", *keys).agg(F.count(F.lit(1)).alias("p_rows")))
    known = settings.where("p_block is not null").select(
        F.col("p_block").alias("block"), *[F.col(k).alias(k[2:]) for k in keys], F.col("p_rows").alias("rows"))
    sizes = known.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    # Settings learn their block's number of chunks; only blocks of several are worth a row.
    several = materialize(sizes.where("chunks > 1"))
    chunked = known.join(F.broadcast(several) if several.limit(10_001).count() <= 10_000 else several, "block", "left").withColumn(
        "chunk", F.pmod(F.xxhash64(*xs, *cs), F.coalesce("chunks", F.lit(1))).cast("int")).drop("chunks")
    copies = models.withColumnRenamed(block, "block").join(several, "block", "left").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
    about_spread = spec.mode == "std" and spec.statistic == "std"

    def predict(rows: pa.Table, model: pa.Table) -> pa.Table:
        frame = rows.to_pandas()
        means, stds = np.full(len(frame), np.nan), np.full(len(frame), np.nan)
        if model.num_rows and len(frame):
            m = model.to_pylist()[0]
            x = (_transformed(frame, spec) - m["input_mean"]) / m["input_scale"]
            features = _encoded(frame, spec, x, m["levels"])
            whole = np.isfinite(features).all(1)
            found, spread = gp.evaluate(_solution(m), features[whole])
            means[whole] = found * m["target_scale"] + (0.0 if about_spread else m["target_mean"])
            stds[whole] = spread * m["target_scale"]
        new = [pa.array(v, mask=~np.isfinite(v)) for v in (means, stds)]
        return rows.append_column("mean", new[0]).append_column("std", new[1])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunked.schema)
    scored = chunked.groupBy("block", "chunk").cogroup(copies.groupBy("block", "chunk")).applyInArrow(predict, f"{fields}, mean double, std double")
    scored = materialize(scored.select(F.col("block").alias("p_block"), *[F.col(k[2:]).alias(k) for k in keys],
                                       F.col("mean").alias(mean), F.col("std").alias(std), F.col("rows").alias("p_rows")))
    nothing = settings.where("p_block is null").select("p_block", *keys, *[F.lit(None).cast("double").alias(c) for c in (mean, std)], "p_rows")
    out = join_conditions(keyed, scored.unionByName(nothing), ["p_block", *keys], [mean, std], "p_rows")
    return out.drop("p_block", *keys)
