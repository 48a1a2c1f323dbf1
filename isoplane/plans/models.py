"""From a raw table to a fitted response model.

The raw rows are read once, into one row per distinct input setting. Scalers,
category levels, support points, noise and likelihood corrections all follow
from that summary.
"""

import warnings
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from isoplane.cluster import collect_bounded, materialize
from isoplane.functions.scalars import all_of, keyed_hash
from isoplane.operators.encoding import MAX_COMBOS, MAX_LEVELS, code_column, combo_levels, dummy_column, dummy_names, observed_combos
from isoplane.operators.profiling import fit_metrics
from isoplane.operators.replicates import join_conditions
from isoplane.operators.scaling import scaled, unscaled
from isoplane.plans import gp, iterative, sparse
from isoplane.plans.search import search
from isoplane.sources.tables import col, number, require_columns
from isoplane.spec import AnalysisSpec, KernelConfig


@dataclass
class Model:
    """A fitted response and what is needed to use it on raw rows."""

    spec: AnalysisSpec
    kernel: KernelConfig
    solution: gp.Solution
    scalers: dict
    levels: dict
    combos: list
    conditions: DataFrame = field(repr=False)
    method: str = "exact"
    constant: float = gp.CONSTANT_NOISE
    cache: dict = field(default_factory=dict, repr=False)

    @property
    def controls(self) -> list[str]:
        """Model inputs: numerics, then one dummy per category level or, coded, one code per category."""
        return [*self.spec.num_cols, *(self.spec.cat_cols if self.kernel.coded else dummy_names(self.levels))]

    def require_dummies(self) -> None:
        """Raise when categories are coded: curves hold and combine columns of levels."""
        if self.kernel.coded:
            raise ValueError("curves and surfaces need a model with encoding='one_hot'")

    def inputs(self, encoded: bool = False) -> list[Column]:
        """Scaled features of raw columns; ``encoded`` rows carry dummy columns already."""
        if encoded:
            self.require_dummies()
        inputs = _features(self.spec, self.scalers, {} if encoded else self.levels, self.kernel.coded)
        return inputs + [col(d).cast("double") for d in dummy_names(self.levels) if encoded]

    def unscale(self, value: Column, spread: bool = False) -> Column:
        """Original target units; a modelled replicate spread has no shift."""
        about_spread = self.spec.mode == "std" and self.spec.statistic == "std"
        return unscaled(value, self.scalers[self.spec.target], spread=spread or about_spread)


def _transformed(name: str, spec: AnalysisSpec) -> Column:
    """Raw input as double, log columns as log10."""
    value = number(name)
    return F.log10(value) if name in spec.log_cols else value


def model_rows(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """The columns a model uses, numerics as doubles, the target as ``t_value``."""
    return df.select(*[number(c).alias(c) for c in spec.num_cols], *[col(c) for c in spec.cat_cols],
                     number(spec.target).alias("t_value"))


def condition_table(df: DataFrame, spec: AnalysisSpec, collapse: bool = True) -> DataFrame:
    """One row per distinct raw input setting, missing ones included.

    ``c_mean``, ``c_std``, ``c_within`` (sum of squares around the mean), ``c_count``
    rows and ``c_valid`` measurements. The only step that reads the raw rows. Without
    ``collapse`` every row is its own setting.
    """
    keys = [*spec.num_cols, *spec.cat_cols]
    require_columns(df, keys, spec.target)
    y = F.col("t_value")
    if not collapse:
        return model_rows(df, spec).select(
            *[col(k) for k in keys], y.alias("c_mean"), F.lit(None).cast("double").alias("c_std"),
            F.lit(0.0).alias("c_within"), F.lit(1).cast("bigint").alias("c_count"),
            y.isNotNull().cast("bigint").alias("c_valid"))
    return model_rows(df, spec).groupBy([col(k) for k in keys]).agg(
        F.avg(y).alias("c_mean"), F.stddev_samp(y).alias("c_std"),
        F.coalesce(F.var_pop(y) * F.count(y), F.lit(0.0)).alias("c_within"),
        F.count(F.lit(1)).alias("c_count"), F.count(y).alias("c_valid"))


def scalers_from_conditions(conditions: DataFrame, spec: AnalysisSpec) -> dict:
    """Population mean and std over the raw rows, from their summary."""
    w = F.col("c_count")
    values = {f"x{i}": _transformed(c, spec) for i, c in enumerate(spec.num_cols)}
    centres = conditions.agg(F.struct(
        *[(F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))).alias(n) for n, v in values.items()],
        (F.sum(F.col("c_mean") * F.col("c_valid")) / F.sum("c_valid")).alias("y")).alias("row")).scalar()
    bad = [F.count_if(col(c) <= 0).alias(f"bad{i}") for i, c in enumerate(spec.num_cols)
           if c in spec.log_cols]
    off = F.col("c_mean") - centres["y"]
    row = conditions.agg(
        F.max(centres).alias("centre"), *bad,
        *[F.when(F.min(v) == F.max(v), 1.0).otherwise(F.sqrt(
            F.sum((v - centres[n]) * (v - centres[n]) * w) / F.sum(F.when(v.isNotNull(), w)))).alias(n)
          for n, v in values.items()],
        F.sqrt(F.sum(F.col("c_within") + F.col("c_valid") * off * off) / F.sum("c_valid")).alias("y")).first()
    wrong = [c for i, c in enumerate(spec.num_cols) if c in spec.log_cols and row[f"bad{i}"]]
    if wrong:
        raise ValueError(f"log columns hold values that are not positive: {wrong}")
    if row["centre"] is None or row["y"] is None:
        raise ValueError(f"no values in {spec.target!r}")
    out = {c: (row["centre"][f"x{i}"], row[f"x{i}"]) for i, c in enumerate(spec.num_cols)}
    empty = [c for c, (mean, _) in out.items() if mean is None]
    if empty:
        raise ValueError(f"no values in columns {empty}")
    out[spec.target] = (row["centre"]["y"], row["y"] or 1.0)
    return out


def model_conditions(conditions: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """The conditions a model is trained on.

    Replicate mode leaves out missing numeric inputs and single rows; row mode
    needs complete rows.
    """
    known = all_of(col(c).isNotNull() for c in spec.num_cols)
    if spec.mode == "std":
        return conditions.where(known & (F.col("c_count") >= 2))
    return conditions


def _features(spec: AnalysisSpec, scalers, levels, coded: int = 0) -> list[Column]:
    """Model inputs of raw columns as ``f0, f1, ...``."""
    inputs = [scaled(_transformed(c, spec), scalers[c]) for c in spec.num_cols]
    inputs += [code_column(c) for c in spec.cat_cols] if coded else [dummy_column(c, v).cast("double") for c, vs in levels.items() for v in vs]
    return [x.alias(f"f{i}") for i, x in enumerate(inputs)]


def _support(conditions: DataFrame, spec: AnalysisSpec, scalers, levels, noise, constant, seed, coded=0):
    """Support points in model units: features ``f0..``, ``y``, ``noise``, ``count``, ``within``
    and a hash ``key`` of the raw setting."""
    mean, scale = scalers[spec.target]
    conditions = conditions.withColumn(
        "c_key", keyed_hash([col(c) for c in [*spec.num_cols, *spec.cat_cols]], seed))
    value = (F.col("c_mean") - F.lit(mean)) / F.lit(scale)
    spread = F.col("c_std") / F.lit(scale)
    named = [*_features(spec, scalers, levels, coded), F.col("c_key").alias("key")]
    if spec.mode == "std":
        y = value if spec.statistic == "mean" else spread
        points = conditions.select(*named, y.alias("y"), spread.alias("std"), F.col("c_count").alias("count")).withColumn(
            "noise", gp.noise_column(noise, constant)).withColumn("within", F.lit(0.0))
    else:
        points = conditions.select(
            *named, value.alias("y"), F.lit(float(constant)).alias("noise"), F.col("c_count").alias("count"),
            (F.col("c_within") / F.lit(scale * scale)).alias("within"), F.col("c_valid").alias("n_valid"))
    return points, [c for c in points.columns if c[0] == "f"]


def _warn_of_dropped(conditions: DataFrame, spec: AnalysisSpec) -> None:
    """Say how many conditions a replicate model cannot use."""
    if spec.mode != "std":
        return
    missing = ~all_of(col(c).isNotNull() for c in spec.num_cols)
    row = conditions.agg(F.count_if(missing).alias("missing"), F.count_if(~missing & (F.col("c_count") < 2)).alias("single")).first()
    if row["single"] or row["missing"]:
        warnings.warn(f"left out {row['single']} conditions with a single row and {row['missing']} with missing inputs", stacklevel=3)


def _reject_incomplete(points: DataFrame, features, mode):
    """Fail before the solve when a support point has a missing value."""
    missing = ~all_of(F.col(c).isNotNull() for c in [*features, "y", "noise"])
    if mode == "mean":
        missing = missing | (F.col("n_valid") < F.col("count"))
    row = points.agg(F.count_if(missing).alias("missing"), F.count(F.lit(1)).alias("all")).first()
    if row["all"] == 0:
        raise ValueError("no condition is left to fit: every group has fewer than two rows")
    if row["missing"]:
        raise ValueError(f"{row['missing']} conditions have missing inputs, target or noise; "
                         "keep complete cases or choose another noise model")


def fit_model(df: DataFrame, spec: AnalysisSpec, kernel: KernelConfig | None = None,
              tune: bool = True, constant: float = gp.CONSTANT_NOISE, method: str = "exact",
              max_support: int = gp.MAX_SUPPORT, inducing: int | DataFrame = sparse.INDUCING, seed: int = 42,
              collapse: bool = True, conditions: DataFrame | None = None, search_options: dict | None = None,
              max_levels: int = MAX_LEVELS, max_combos: int = MAX_COMBOS,
              max_points: int = iterative.MAX_POINTS, solver_options: dict | None = None,
              choice: str = "hash", per_point: bool = False, encoding: str = "one_hot") -> Model:
    """Fit the response model of ``spec``.

    ``tune=False`` keeps the kernel as given. The method is the caller's choice and never
    changes with the size: ``"exact"`` raises beyond ``max_support`` conditions, which can
    be raised to what the driver can factor; ``"iterative"`` is as exact without a factor, by
    conjugate gradients over kernel blocks on executors, up to ``max_points`` conditions, and
    takes ``solver_options`` (``rank``, ``probes``, ``tolerance``); ``"sparse"`` goes through inducing points.
    ``inducing`` is how many settings to pick, at most ``max_support``, or a table of
    settings in raw columns; ``choice`` picks them by a keyed hash (``"hash"``) or greedily where
    the given kernel leaves most variance (``"pivots"``). ``per_point`` adds to every condition's noise the
    variance that inducing points leave unexplained there. ``encoding="codes"`` gives every category one
    input and one length scale instead of a column and scale per level: the same model where
    a category's scales are equal, for any number of levels; levels not seen in training count
    as one more. ``collapse=False`` skips the summary of equal settings: for
    sparse row models whose inputs hardly ever repeat, where it would only move the rows.
    ``search_options`` are those of the kernel search: ``n`` candidates, and ``starts`` and
    ``max_steps`` (exact), ``max_steps`` alone (iterative) or ``rounds`` (sparse). ``max_levels`` and ``max_combos`` bound the
    levels of a category and their combinations. Replicate models leave out conditions of
    one row or with missing inputs and warn with their number.
    """
    if method not in ("exact", "iterative", "sparse"):
        raise ValueError("method must be 'exact', 'iterative' or 'sparse'")
    if method == "iterative":
        max_support = max_points
    if method == "sparse" and isinstance(inducing, int) and not 0 < inducing <= max_support:
        raise ValueError(f"inducing must be between 1 and max_support, {max_support}")
    if choice not in ("hash", "pivots"):
        raise ValueError("choice must be 'hash' or 'pivots'")
    if per_point and (method != "sparse" or not collapse):
        raise ValueError("per_point is for method='sparse' over summarised settings")
    tuning = {"seed": seed, **(search_options or {})}
    if not collapse and (spec.mode, method) != ("mean", "sparse"):
        raise ValueError("collapse=False is for mode='mean' with method='sparse'")
    if encoding not in ("one_hot", "codes"):
        raise ValueError("encoding must be 'one_hot' or 'codes'")
    kernel = replace(kernel or KernelConfig(), coded=len(spec.cat_cols) if encoding == "codes" else 0)
    if conditions is None:
        conditions = condition_table(df, spec, collapse)
        conditions = materialize(conditions) if collapse else conditions
    scalers = scalers_from_conditions(conditions, spec)
    combos = [] if kernel.coded else observed_combos(conditions, spec.cat_cols, max_combos, max_levels)
    levels = combo_levels(combos, spec.cat_cols) if combos else {}
    trained = model_conditions(conditions, spec)
    _warn_of_dropped(conditions, spec)
    points, features = _support(trained, spec, scalers, levels, spec.noise, constant, seed, kernel.coded)
    by_row = spec.mode == "mean"
    values = ["y", "noise", "count", "within"] + (["n_valid"] if by_row else [])
    rows = [] if method == "sparse" else points.select(*features, *values).limit(max_support + 1).collect()
    small = method != "sparse" and len(rows) <= max_support
    if method != "sparse" and not small:
        limit, other = ("max_support", "method='iterative' or 'sparse'") if method == "exact" else ("max_points", "method='sparse'")
        raise ValueError(f"{trained.count()} conditions, more than {limit}, {max_support}; raise it or use {other}")
    if small:
        x, y, noise, counts, within, *valid = gp.to_arrays(rows, features, *values)
        if len(x) == 0:
            raise ValueError("no condition is left to fit: every group has fewer than two rows")
        if by_row and (valid[0] < counts).any() or not all(np.isfinite(a).all() for a in (x, y, noise)):
            raise ValueError("conditions have missing inputs, target or noise; "
                             "keep complete cases or choose another noise model")
        order = np.lexsort(x.T[::-1])
        x, y, noise, counts, within = (a[order] for a in (x, y, noise, counts, within))
        extra = {}
        if by_row:
            noise = float(constant)
            extra = {"counts": counts, "within": float(within.sum())}
            y_mean, y_scale = 0.0, 1.0
        else:
            y_mean, y_scale = float(y.mean()), float(y.std()) or 1.0
        if method == "iterative":
            solver = {"seed": seed, **(solver_options or {})}
            if tune:
                kernel, _ = iterative.search_iterative(df.sparkSession, kernel, x, (y - y_mean) / y_scale, noise, **extra,
                                                       **solver, **(search_options or {}))
            solution = iterative.solve_iterative(df.sparkSession, kernel, x, y, noise, y_mean=y_mean, y_scale=y_scale, **extra, **solver)
        else:
            if tune:
                kernel, _ = search(df.sparkSession, kernel, x, (y - y_mean) / y_scale, noise, **tuning, **extra)
            solution = gp.solve(kernel, x, y, noise, y_mean=y_mean, y_scale=y_scale, **extra)
    else:
        _reject_incomplete(points, features, spec.mode)
        y_mean, y_scale = 0.0, 1.0
        if not by_row:
            row = points.agg(F.avg("y"), F.stddev_pop("y")).first()
            y_mean, y_scale = row[0], row[1] or 1.0
            points = points.withColumn("y", (F.col("y") - y_mean) / y_scale)
        if isinstance(inducing, DataFrame):
            given = collect_bounded(inducing.select(*_features(spec, scalers, levels, kernel.coded)), max_support, "inducing points")
            z = gp.to_arrays(given, features)[0]
            z = z[np.lexsort(z.T[::-1])]
        elif choice == "pivots":
            z = sparse.pivoted_inducing(points, features, kernel.params(len(features)), inducing)
        else:
            z = sparse.choose_inducing(points, features, inducing, seed, "key")
        if tune:
            kernel, _ = sparse.search_sparse(points, features, kernel, z, by_row, per_point=per_point, **tuning)
        solution = sparse.solve_sparse(points, features, kernel, z, by_row, y_mean, y_scale, per_point)
    return Model(spec, kernel, solution, scalers, levels, combos, conditions, method, constant)


def fit_both(df: DataFrame, std_spec: AnalysisSpec, mean_spec: AnalysisSpec, **options):
    """Replicate and row model of one table; equal columns share one summary of the rows."""
    shared = None
    same = ("num_cols", "cat_cols", "target", "log_cols")
    if all(getattr(std_spec, a) == getattr(mean_spec, a) for a in same):
        shared = materialize(condition_table(df, std_spec))
    per_mode = {m: {k: (v[m] if isinstance(v, dict) else v) for k, v in options.items()}
                for m in ("std", "mean")}
    return (fit_model(df, std_spec, conditions=shared, **per_mode["std"]),
            fit_model(df, mean_spec, conditions=shared, **per_mode["mean"]))


def predict_rows(model: Model, df: DataFrame, unscale: bool = True, mean: str = "pred_mean",
                 std: str = "pred_std", encoded: bool = False) -> DataFrame:
    """Raw rows with the predicted mean and its std, in original units by default.

    A map over the rows of which only the model's inputs leave the JVM; nothing is
    shuffled. A small file that comes in one split is for the caller to repartition.
    """
    out = gp.with_prediction(df, model.solution, model.inputs(encoded), mean, std)
    if unscale:
        out = out.withColumns({mean: model.unscale(F.col(mean)),
                               std: model.unscale(F.col(std), spread=True)})
    return out


def training_frame(model: Model, df: DataFrame | None = None) -> DataFrame:
    """``observed`` and ``predicted`` in scaled units for everything the model was trained on.

    Replicate mode has one row per condition. Row mode has one per raw row and
    needs the raw table: each row meets its condition's prediction.
    """
    spec = model.spec
    fitted = predict_rows(model, model_conditions(model.conditions, spec), unscale=False,
                          mean="predicted", std="p_std")
    mean, scale = model.scalers[spec.target]
    if spec.mode == "std":
        value = (F.col("c_mean") - mean) / scale if spec.statistic == "mean" else F.col("c_std") / scale
        return fitted.select(value.alias("observed"), "predicted")
    if df is None:
        raise ValueError("row mode needs the raw table")
    keys = [*spec.num_cols, *spec.cat_cols]
    joined = join_conditions(model_rows(df, spec), fitted, keys, ["predicted"], "c_count")
    return joined.select(((F.col("t_value") - mean) / scale).alias("observed"), "predicted")


def training_metrics(model: Model, df: DataFrame | None = None, digits: int | None = 4,
                     unscale: bool = False) -> DataFrame:
    """R2, MAE and RMSE on the training data, scaled units unless asked otherwise."""
    frame = training_frame(model, df)
    if unscale:
        frame = frame.select(*[model.unscale(F.col(c)).alias(c) for c in frame.columns])
    return fit_metrics(frame, "observed", "predicted", digits)
