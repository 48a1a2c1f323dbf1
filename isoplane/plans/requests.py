"""The two requests of a modelling session: fit models, then draw tables from them.

Requests are plain dicts with the form's field names.
"""

from pyspark.sql import DataFrame, functions as F

from isoplane.plans import frames, models
from isoplane.spec import AnalysisSpec, KernelConfig, ordered_union


def specs_of(request: dict) -> dict:
    """``mode -> (spec, kernel)`` for every model a fit request asks for."""
    mode = request.get("mode", "std")
    if mode not in ("std", "mean", "both"):
        raise ValueError("mode must be 'std', 'mean' or 'both'")
    out = {}
    if mode in ("std", "both"):
        out["std"] = AnalysisSpec(
            request.get("std_num_cols", []), request.get("measurement_col"), request.get("std_cat_cols", []),
            mode="std", statistic=request.get("std_gp_target", "mean"), log_cols=request.get("std_log_vars", []),
            noise=request.get("std_noise", "std"))
    if mode in ("mean", "both"):
        out["mean"] = AnalysisSpec(
            request.get("mean_num_cols", []), request.get("mean_output_col"), request.get("mean_cat_cols", []),
            mode="mean", log_cols=request.get("mean_log_vars", []), noise="constant")
    return {m: (spec, KernelConfig.from_dict(request.get(f"{m}_kernel_config"))) for m, spec in out.items()}


def fit_request(df: DataFrame, request: dict, **options) -> dict:
    """``mode -> Model`` for one fit request; two models of equal columns share one summary."""
    wanted = specs_of(request)
    if len(wanted) == 2:
        (std, k_std), (mean, k_mean) = wanted["std"], wanted["mean"]
        return dict(zip(("std", "mean"), models.fit_both(df, std, mean, kernel={"std": k_std, "mean": k_mean}, **options)))
    return {m: models.fit_model(df, spec, kernel, **options) for m, (spec, kernel) in wanted.items()}


def response_table(fitted: dict, df: DataFrame) -> DataFrame:
    """One row per model: ``mode, target, r2, mae, rmse`` (4 digits), inputs and combination labels."""
    parts = []
    for mode, model in fitted.items():
        target = model.spec.statistic if mode == "std" else model.spec.target
        labels = [c["label"] for c in model.combos if c["label"] is not None]
        parts.append(models.training_metrics(model, df).select(
            F.lit(mode).alias("mode"), F.lit(target).alias("target"), "r2", "mae", "rmse",
            F.lit(model.controls).cast("array<string>").alias("control_vars"),
            F.lit(labels).cast("array<string>").alias("combos")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def axis_choices(fitted: dict) -> dict:
    """Columns a plot may use: numeric inputs and log inputs of all models together."""
    specs = [m.spec for m in fitted.values()]
    return {"num_cols": ordered_union(*(s.num_cols for s in specs)),
            "log_cols": ordered_union(*(s.log_cols for s in specs))}


def plot_request(fitted: dict, request: dict, df: DataFrame) -> dict:
    """Tables of one plot request: ``curve`` and ``scatter``, or ``surface`` and ``scatter``.

    For both models at once the curves or surfaces come as ``pairs``.
    """
    mode, flag = request.get("mode", "std"), request.get("unscale_std", False)
    wanted = ["std", "mean"] if mode == "both" else [mode]
    absent = [m for m in wanted if m not in fitted]
    if absent:
        raise ValueError(f"no {absent[0]} model; fit it first")
    x, y = request.get("x_var"), request.get("y_var")
    flat = request.get("plot_type", "1d") != "2d"
    targets = {fitted[m].spec.target for m in wanted} | {frames.shown_name(fitted[m]) for m in wanted}
    if flat and y and y not in targets:
        raise ValueError(f"a 1-D plot shows the model's target, not {y!r}; ask for a 2-D plot or leave y_var out")
    for m in wanted:
        if "log_vars" in request and set(request["log_vars"] or []) & set(fitted[m].spec.num_cols) != set(fitted[m].spec.log_cols):
            raise ValueError(f"the {m} model was trained on other log inputs, {list(fitted[m].spec.log_cols)}; fit it again")
    tables = {}
    if not flat:
        drawn = [frames.surface_2d(fitted[m], x, y, unscale_std=flag) for m in wanted]
        tables["scatter"] = {m: frames.scatter_2d(fitted[m], x, y, df) for m in wanted}
        tables["surface"] = drawn[0] if len(drawn) == 1 else frames.pair_surfaces(*drawn)
    else:
        drawn = [frames.curve_1d(fitted[m], x, unscale_std=flag) for m in wanted]
        tables["scatter"] = {m: frames.scatter_1d(fitted[m], x, df, flag) for m in wanted}
        tables["curve"] = drawn[0] if len(drawn) == 1 else frames.pair_curves(*drawn)
    return tables
