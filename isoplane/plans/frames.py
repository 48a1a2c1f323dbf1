"""The tables behind each picture: curves, surfaces and the points drawn on them."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from isoplane.functions.scalars import all_of, band, clip
from isoplane.operators import grids
from isoplane.operators.encoding import dummy_column, with_all
from isoplane.operators.profiling import equal_bands, exact_medians
from isoplane.plans.models import Model, model_conditions, model_rows, predict_rows
from isoplane.sources.tables import col
from isoplane.spec import CONTOUR_LEVELS, CURVE_POINTS, SURFACE_POINTS, unscale_plan


def held_values(model: Model) -> dict:
    """Median of every input over the training data, raw units; dummies too."""
    model.require_dummies()
    if "medians" not in model.cache:
        encoded = model_conditions(model.conditions, model.spec).select(
            *[col(c) for c in model.spec.num_cols], "c_count",
            *[dummy_column(c, v) for c, vs in model.levels.items() for v in vs])
        weight = "c_count" if model.spec.mode == "mean" else None
        model.cache["medians"] = exact_medians(encoded, model.controls, weight)
    return model.cache["medians"]


def input_range(model: Model, name: str) -> tuple:
    """Smallest and largest training value of a numeric input, raw units."""
    key = ("range", name)
    if key not in model.cache:
        row = model_conditions(model.conditions, model.spec).agg(F.min(col(name)), F.max(col(name))).first()
        model.cache[key] = (row[0], row[1])
    return model.cache[key]


def _range_of(model, name):
    if name not in model.spec.num_cols:
        raise ValueError(f"{name!r} is not a numeric input of the model")
    return input_range(model, name)


def _prefixed(points: DataFrame) -> DataFrame:
    """Grid columns out of the way of inputs that have the same name."""
    return points.select([F.col(c).alias(f"g_{c}") for c in points.columns])


def prediction_frame(points: DataFrame, swept: dict, medians: dict, fixed: Column | None = None) -> DataFrame:
    """Complete a grid to all model inputs.

    Swept inputs come from the grid, fixed ones from the ``fixed`` map column,
    the rest sit at their median.
    """
    made = {}
    for name, median in medians.items():
        if name in swept:
            made[name] = F.col(swept[name])
        elif fixed is None:
            made[name] = F.lit(float(median))
        else:
            made[name] = F.coalesce(fixed[F.lit(name)].cast("double"), F.lit(float(median)))
    return points.select("*", *[v.alias(n) for n, v in made.items()])


def combo_frame(model: Model) -> DataFrame:
    """``combo_id, combo, fixed`` for "All" and every observed combination."""
    model.require_dummies()
    rows = [(c["combo_id"], c["label"], {k: float(v) for k, v in c["fixed"].items()})
            for c in with_all(model.combos)]
    return model.conditions.sparkSession.createDataFrame(
        rows, "combo_id int, combo string, fixed map<string,double>")


def shown_name(model: Model) -> str:
    """What a curve of the model shows."""
    spec = model.spec
    return spec.target if spec.mode == "mean" or spec.statistic == "mean" else spec.statistic


def curve_1d(model: Model, x_var: str, n: int = CURVE_POINTS, unscale_std: bool = False,
             shift: bool = False) -> DataFrame:
    """``combo_id, combo, point_id, x, mean, lower, upper, label`` for every combination.

    ``shift`` adds the measurement mean to an unscaled replicate-spread curve.
    """
    spec = model.spec
    lo, hi = _range_of(model, x_var)
    points = _prefixed(grids.grid_1d_by_combo(combo_frame(model), lo, hi, n, x_var in spec.log_cols))
    inputs = prediction_frame(points, {x_var: "g_x"}, held_values(model), F.col("g_fixed"))
    scored = predict_rows(model, inputs, unscale=False, mean="p_mean", std="p_std", encoded=True)
    if unscale_plan(spec.mode, spec.statistic, unscale_std)["curve"]:
        mean = model.unscale(F.col("p_mean"))
        if shift and spec.mode == "std" and spec.statistic == "std":
            mean = mean + F.lit(model.scalers[spec.target][0])
        scored = scored.withColumns({"p_mean": mean, "p_std": model.unscale(F.col("p_std"), spread=True)})
    lower, upper = band(F.col("p_mean"), F.col("p_std"))
    shown = [F.col(f"g_{c}").alias(c) for c in ("combo_id", "combo", "point_id", "x")]
    return scored.select(*shown, F.col("p_mean").alias("mean"), lower.alias("lower"),
                         upper.alias("upper"), F.lit(shown_name(model)).alias("label"))


def _training_points(model: Model, df: DataFrame | None) -> DataFrame:
    """Inputs and the trained value ``t_value``, both in raw units."""
    spec = model.spec
    if spec.mode == "std":
        return model_conditions(model.conditions, spec).withColumn(
            "t_value", F.col("c_mean") if spec.statistic == "mean" else F.col("c_std"))
    if df is None:
        raise ValueError("row mode needs the raw table")
    return model_rows(df, spec)


def _shown(model: Model, value: Column, unscale: bool) -> Column:
    if unscale:
        return value
    mean, scale = model.scalers[model.spec.target]
    about_spread = model.spec.mode == "std" and model.spec.statistic == "std"
    return (value - (0.0 if about_spread else mean)) / scale


def scatter_1d(model: Model, x_var: str, df: DataFrame | None = None, unscale_std: bool = False) -> DataFrame:
    """``combo_id, combo, x, y``: every point under "All" and under its own combination."""
    spec = model.spec
    shown = unscale_plan(spec.mode, spec.statistic, unscale_std)["curve"]
    value = _shown(model, F.col("t_value"), shown).alias("y")
    points = _training_points(model, df)
    if not spec.cat_cols:
        return points.select(F.lit(0).alias("combo_id"), F.lit(None).cast("string").alias("combo"),
                             col(x_var).alias("x"), value)
    # Points meet their combination by value; labels are for display only.
    kinds = [T.StructField(f"l_{i}", model.conditions.schema[c].dataType) for i, c in enumerate(spec.cat_cols)]
    schema = T.StructType([T.StructField("l_id", T.IntegerType()), T.StructField("l_label", T.StringType()), *kinds])
    names = model.conditions.sparkSession.createDataFrame(
        [(c["combo_id"], c["label"], *[c["values"][k] for k in spec.cat_cols]) for c in model.combos], schema)
    drawn = points.select(col(x_var).alias("x"), value, *[col(c).alias(f"p_{i}") for i, c in enumerate(spec.cat_cols)],
                          F.explode(F.array(F.lit(False), F.lit(True))).alias("own"))
    same = all_of(F.col(f"p_{i}").eqNullSafe(F.col(f"l_{i}")) for i in range(len(spec.cat_cols)))
    met = drawn.join(F.broadcast(names), F.col("own") & same, "left")
    return met.where(~F.col("own") | F.col("l_id").isNotNull()).select(
        F.when(F.col("own"), F.col("l_id")).otherwise(0).alias("combo_id"),
        F.when(F.col("own"), F.col("l_label")).otherwise("All").alias("combo"), "x", "y")


def surface_2d(model: Model, x_var: str, y_var: str, n: int = SURFACE_POINTS, unscale_std: bool = False,
               floor: float | None = 0.0, by_combo: bool = False) -> DataFrame:
    """``point_id, x, y, mean, std``; the mean in original units and not below ``floor``.

    ``by_combo`` draws one surface per category combination and "All", with ``combo_id``
    and ``combo`` in front.
    """
    spec = model.spec
    logs = (x_var in spec.log_cols, y_var in spec.log_cols)
    ranges = (_range_of(model, x_var), _range_of(model, y_var))
    if by_combo:
        points, front = grids.grid_2d_by_combo(combo_frame(model), *ranges, n, *logs), ["combo_id", "combo"]
    else:
        points, front = grids.grid_2d(model.conditions.sparkSession, *ranges, n, *logs), []
    inputs = prediction_frame(_prefixed(points), {x_var: "g_x", y_var: "g_y"}, held_values(model),
                              F.col("g_fixed") if by_combo else None)
    scored = predict_rows(model, inputs, unscale=False, mean="p_mean", std="p_std", encoded=True)
    plan = unscale_plan(spec.mode, spec.statistic, unscale_std)
    std = model.unscale(F.col("p_std"), spread=True) if plan["uncertainty"] else F.col("p_std")
    return scored.select(*[F.col(f"g_{c}").alias(c) for c in (*front, "point_id", "x", "y")],
                         clip(model.unscale(F.col("p_mean")), lo=floor).alias("mean"), std.alias("std"))


def surface_bands(surface: DataFrame, levels: int = CONTOUR_LEVELS) -> DataFrame:
    """A surface with the contour band of its mean and of its uncertainty."""
    return equal_bands(equal_bands(surface, "mean", levels, "mean_band"), "std", levels, "std_band")


def scatter_2d(model: Model, x_var: str, y_var: str, df: DataFrame | None = None,
               exponentiate: bool = False) -> DataFrame:
    """``x, y, z`` of the training data, original units; ``exponentiate`` for a logged target."""
    z = F.exp("t_value") if exponentiate else F.col("t_value")
    return _training_points(model, df).select(col(x_var).alias("x"), col(y_var).alias("y"), z.alias("z"))


def _pair(std: DataFrame, row: DataFrame, keys) -> DataFrame:
    def side(df, name):
        return df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (*keys, "label")])

    return side(std, "std").join(side(row, "row"), list(keys), "full")


def pair_curves(std_curve: DataFrame, row_curve: DataFrame) -> DataFrame:
    """Replicate and row curves side by side; the longer list wins, a missing side is NULL."""
    return _pair(std_curve, row_curve, ("combo_id", "point_id"))


def pair_surfaces(std_surface: DataFrame, row_surface: DataFrame) -> DataFrame:
    """Replicate and row surfaces side by side, combination by combination where both have some."""
    by_combo = all("combo_id" in s.columns for s in (std_surface, row_surface))
    return _pair(std_surface, row_surface, ("combo_id", "point_id") if by_combo else ("point_id",))
