"""Kernels, fits, predictions and the tables behind curves and surfaces."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from isoplane.cluster import collect_bounded, materialize
from isoplane.functions.kernels import kernel_column, kernel_profile, kernel_sums, squared_distance
from isoplane.functions.scalars import band, rounded
from isoplane.operators import contours, grids, profiling, replicates, scaling
from isoplane.operators.contours import ROUND_STEPS
from isoplane.operators.encoding import category_combos
from isoplane.plans import block_fits, blocks, frames, gp, models, requests, search
from isoplane.registry import gpsql, query
from isoplane.registry.shared import shown, table
from isoplane.spec import SURFACE_POINTS, AnalysisSpec, KernelConfig

LINE = ["l_orderkey", "l_linenumber"]
PAIR = ("l_discount", "l_tax")
TARGET = "l_extendedprice"
FLAGS = [("l_returnflag", ["A", "N", "R"])]

M32 = KernelConfig(kernel_type="matern", nu=1.5)
KERNEL_CONFIGS = {
    "rbf": KernelConfig(), "matern12": KernelConfig(kernel_type="matern", nu=0.5), "matern32": M32,
    "matern52": KernelConfig(kernel_type="matern", nu=2.5),
    "rq": KernelConfig(kernel_type="rq", rq_alpha=1.5),
}
ROW_SPEC = AnalysisSpec(PAIR, TARGET, mode="mean")
STD_SPEC = AnalysisSpec(PAIR, TARGET, mode="std", statistic="mean", noise="sem")


def lineitem(spark, sf):
    return table(spark, sf, "lineitem")


def row_model(spark, sf, **options):
    return models.fit_model(lineitem(spark, sf), ROW_SPEC, M32, tune=False, **options)


def fitted_conditions(model, unscale=False):
    """Predictions at the conditions a model was trained on."""
    rows = models.model_conditions(model.conditions, model.spec)
    return models.predict_rows(model, rows, unscale=unscale).select(
        *model.spec.num_cols, *model.spec.cat_cols, "pred_mean", "pred_std")


# --- kernels ---------------------------------------------------------------

def _scaled_support(spark, sf):
    """The distinct settings of the whole table, raw and scaled."""
    df = lineitem(spark, sf).select(*PAIR)
    row = scaling.scaler_row(df, PAIR)
    found = df.distinct().select(*PAIR, *[((F.col(c) - row[f"m{i}"]) / row[f"s{i}"]).alias(f"x{i}")
                                          for i, c in enumerate(PAIR)])
    return found, collect_bounded(found.select("x0", "x1"), gp.MAX_SUPPORT, "conditions")


def _total(values):
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _kernel_query(name):
    sql = gpsql.statement(gpsql.row_points(PAIR), select=f"""
        select a.l_discount, a.l_tax, round(sum({gpsql.kern(name, 'a', 'b', 2)}), 6) + 0.0 as k_sum,
               round(sum(pow({gpsql.kern(name, 'a', 'b', 2)}, 2)), 6) + 0.0 as k_square
        from g a, g b group by all""")

    @query(f"kernel_matrix_{name}", sql)
    def kernel_matrix(spark, sf):
        found, support = _scaled_support(spark, sf)
        k = kernel_profile(KERNEL_CONFIGS[name], support)
        return found.select(*[rounded(F.col(c), 6).alias(c) for c in PAIR], k(F.struct("x0", "x1")).alias("k")).select(
            *PAIR, rounded(_total(F.col("k")), 6).alias("k_sum"),
            rounded(_total(F.transform("k", lambda v: v * v)), 6).alias("k_square"))


for _name in KERNEL_CONFIGS:
    _kernel_query(_name)


@query("kernel_cross", gpsql.statement(gpsql.row_points(PAIR), f"""
    c as (select a.l_discount, a.l_tax, 2 * sum({gpsql.kern('matern32', 'a', 'b', 2, [0.8, 1.7])}) as k_sum,
              2 * min({gpsql.kern('matern32', 'a', 'b', 2, [0.8, 1.7])}) as k_min from g a, g b group by all)""", select="""
    select l_orderkey, l_linenumber, round(k_sum, 6) + 0.0 as k_sum, round(k_min, 6) + 0.0 as k_min
    from lineitem li join c on li.l_discount + 0.0 = c.l_discount and li.l_tax + 0.0 = c.l_tax"""))
def kernel_cross(spark, sf):
    df = lineitem(spark, sf)
    conditions = models.condition_table(df, ROW_SPEC)
    conditions = materialize(conditions)
    fitted = models.scalers_from_conditions(conditions, ROW_SPEC)
    x = [scaling.scaled(F.col(c), fitted[c]) for c in PAIR]
    support = collect_bounded(conditions.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]), 2_000, "settings")
    kernel = KernelConfig(kernel_type="matern", nu=1.5, length_scale=(0.8, 1.7), constant=2.0)
    scored = df.select(*LINE, kernel_sums(kernel, support)(F.struct(*x)).alias("k"))
    return shown(scored.select(*LINE, F.col("k.total").alias("k_sum"), F.col("k.least").alias("k_min")), 6, *LINE)


@query("kernel_white", gpsql.statement(gpsql.row_points(PAIR), select=f"""
    select a.l_discount, a.l_tax, round(sum({gpsql.kern('matern52', 'a', 'b', 2)}), 6) + 0.0 as crossed,
           round(sum({gpsql.kern('matern52', 'a', 'b', 2)} + case when a.i = b.i then 0.003 else 0 end), 6) + 0.0 as trained,
           1.003::double as prior from g a, g b group by all"""))
def kernel_white(spark, sf):
    found, support = _scaled_support(spark, sf)
    kernel = KernelConfig(kernel_type="matern", nu=2.5, white_noise=True, noise_level=0.003)
    crossed = _total(kernel_profile(kernel, support)(F.struct("x0", "x1")))
    params = kernel.params(2)
    return found.select(*[rounded(F.col(c), 6).alias(c) for c in PAIR], rounded(crossed, 6).alias("crossed"),
                        rounded(crossed + params["white"], 6).alias("trained"),
                        F.lit(params["amplitude"] + params["white"]).alias("prior"))


_CENTRE = {name: gpsql.KERNELS[name].format(d2="pow(x1 / 0.8, 2) + pow(x2 / 1.7, 2)" if name != "rq"
                                            else "pow(x1, 2) + pow(x2, 2)") for name in KERNEL_CONFIGS}


@query("kernel_centre", """
    with s as (select avg(l_discount) m1, stddev_pop(l_discount) s1, avg(l_tax) m2, stddev_pop(l_tax) s2 from lineitem),
         z as (select l_orderkey, l_linenumber, (l_discount - m1) / s1 x1, (l_tax - m2) / s2 x2 from lineitem, s)
    select l_orderkey, l_linenumber, """ + ", ".join(f"round({q}, 6) + 0.0 as {n}" for n, q in _CENTRE.items()) + " from z")
def kernel_centre(spark, sf):
    """Covariance of every row with the centre of the table, all in generated code."""
    df = scaling.scale_columns(lineitem(spark, sf).select(*LINE, *PAIR), PAIR)
    out = df.select(*LINE, *[kernel_column(k, squared_distance(
        [F.col(c) for c in PAIR], [0.0, 0.0], [0.8, 1.7] if n != "rq" else [1.0, 1.0])).alias(n)
        for n, k in KERNEL_CONFIGS.items()])
    return shown(out, 6, *LINE)


# --- fit, likelihood, search -----------------------------------------------

@query("gp_weights", gpsql.statement(
    gpsql.row_points(["l_discount"]), gpsql.solved("matern12", 1),
    select="select i::int as i, round(x1, 6) + 0.0 as x, round(w, 5) + 0.0 as weight from g join w using (i)"))
def gp_weights(spark, sf):
    spec = AnalysisSpec(("l_discount",), TARGET, mode="mean")
    model = models.fit_model(lineitem(spark, sf), spec, KERNEL_CONFIGS["matern12"], tune=False)
    rows = [(i, float(x[0]), float(w)) for i, (x, w) in enumerate(zip(model.solution.points, model.solution.weights))]
    return shown(spark.createDataFrame(rows, "i int, x double, weight double"), 6, "i", weight=5)


SCALES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


def _candidate_sql(scales, digits=4):
    return gpsql.statement(gpsql.row_points(["l_discount"]), gpsql.likelihoods("matern32", scales), select=f"""
    select sol.cid as candidate_id, round(-0.5 * yw.v - 0.5 * ld - m / 2.0 * ln(2 * pi())
             - (within.n - m) / 2.0 * ln(2 * pi() * 0.05) - ssw / (2 * 0.05) - 0.5 * ln_n, {digits}) + 0.0 as lml
    from sol join yw using (cid), within""")


CANDIDATE_SQL = _candidate_sql(SCALES)


@query("gp_best_candidate", f"select * from ({CANDIDATE_SQL}) order by lml desc, candidate_id limit 1")
def gp_best_candidate(spark, sf):
    return gp_lml_candidates(spark, sf).orderBy(F.desc("lml"), "candidate_id").limit(1)


@query("gp_lml_candidates", CANDIDATE_SQL)
def gp_lml_candidates(spark, sf):
    df = scaling.scale_columns(lineitem(spark, sf), ["l_discount", TARGET])
    found = gp.condition_collapse(df, ["l_discount"], TARGET)
    rows = collect_bounded(found.select("l_discount", "mean", "count", "within"), gp.MAX_SUPPORT, "conditions")
    x, y, counts, within = gp.to_arrays(rows, ["l_discount"], "mean", "count", "within")
    candidates = spark.createDataFrame([(i, [float(np.log(s)), 0.0]) for i, s in enumerate(SCALES)],
                                       "candidate_id long, theta array<double>")
    scored = search.score_candidates(candidates, M32, x, y, gp.CONSTANT_NOISE, counts, float(within.sum()))
    return scored.select(F.col("candidate_id").cast("int").alias("candidate_id"), rounded(F.col("lml"), 4).alias("lml"))


# One free parameter: the constant's bounds hold it. The grid is fine enough for the digit shown.
ONE_SCALE = KernelConfig(kernel_type="matern", nu=1.5, constant_bounds=(1.0, 1.0 + 1e-9))
SCALE_GRID = [float(v) for v in np.geomspace(*ONE_SCALE.length_scale_bounds, 400)]


@query("gp_search_scale", f"select round(max(lml), 1) + 0.0 as lml from ({_candidate_sql(SCALE_GRID)})")
def gp_search_scale(spark, sf):
    """The likelihood that the search reaches, against the best of a fine grid of length scales."""
    spec = AnalysisSpec(("l_discount",), TARGET, mode="mean")
    model = models.fit_model(lineitem(spark, sf), spec, ONE_SCALE)
    return spark.createDataFrame([(model.solution.lml,)], "lml double").select(rounded(F.col("lml"), 1).alias("lml"))


PAIR_BOUNDS = np.log([b for _, _, b in M32.free(2)])
PAIR_START = np.log([v for _, v, _ in M32.free(2)])
PAIR_DESIGN = [np.exp(t).tolist() for t in search.candidate_thetas(PAIR_START, PAIR_BOUNDS, search.CANDIDATES, 42)]


@query("gp_search", gpsql.statement(gpsql.row_points(PAIR), gpsql.design_likelihoods("matern32", 2, PAIR_DESIGN), select="""
    select cid::int as candidate_id, round(l1, 6) + 0.0 as l_discount, round(l2, 6) + 0.0 as l_tax, round(c, 6) + 0.0 as constant,
           round(lml, 2) + 0.0 as lml, true as reached from dl join t using (cid)"""))
def gp_search(spark, sf):
    """Likelihoods of the search's design, and whether the tuned model's likelihood reaches each."""
    model = models.fit_model(lineitem(spark, sf), ROW_SPEC, M32)
    points = gp.condition_collapse(scaling.scale_columns(lineitem(spark, sf), [*PAIR, TARGET]), PAIR, TARGET)
    rows = collect_bounded(points.select(*PAIR, "mean", "count", "within"), gp.MAX_SUPPORT, "conditions")
    x, y, counts, within = gp.to_arrays(rows, PAIR, "mean", "count", "within")
    design = search.candidate_frame(spark, PAIR_START, PAIR_BOUNDS, search.CANDIDATES, 42)
    scored = search.score_candidates(design, M32, x, y, gp.CONSTANT_NOISE, counts, float(within.sum()))
    parameters = [rounded(F.exp(F.col("theta")[i]), 6).alias(c) for i, c in enumerate((*PAIR, "constant"))]
    return scored.select(F.col("candidate_id").cast("int").alias("candidate_id"), *parameters, rounded(F.col("lml"), 2).alias("lml"),
                         (F.lit(model.solution.lml) >= F.col("lml") - 1e-6).alias("reached"))


# --- prediction ------------------------------------------------------------

def _row_scored(columns):
    return gpsql.statement(
        gpsql.row_points(PAIR), gpsql.solved("matern32", 2), gpsql.at_conditions(2), gpsql.predicted("matern32", 2),
        f"v as (select l_discount as d, l_tax as t, mean, std, m_{TARGET} my, s_{TARGET} sy from g join f on g.i = f.pid, s)",
        select=f"""select l_orderkey, l_linenumber, {columns}
        from lineitem li join v on li.l_discount + 0.0 = v.d and li.l_tax + 0.0 = v.t""")


@query("gp_predict_mean", _row_scored("round(mean, 6) + 0.0 as pred_mean"))
def gp_predict_mean(spark, sf):
    out = models.predict_rows(row_model(spark, sf), lineitem(spark, sf), unscale=False)
    return shown(out.select(*LINE, "pred_mean"), 6, *LINE)


@query("gp_predict_std", _row_scored("round(std, 6) + 0.0 as pred_std"))
def gp_predict_std(spark, sf):
    out = models.predict_rows(row_model(spark, sf), lineitem(spark, sf), unscale=False)
    return shown(out.select(*LINE, "pred_std"), 6, *LINE)


@query("gp_predict_unscaled", _row_scored(
    "round(mean * sy + my, 3) + 0.0 as pred_mean, round(std * sy, 3) + 0.0 as pred_std"))
def gp_predict_unscaled(spark, sf):
    out = models.predict_rows(row_model(spark, sf), lineitem(spark, sf))
    return shown(out.select(*LINE, "pred_mean", "pred_std"), 3, *LINE)


@query("gp_band", _row_scored("""round(mean * sy + my - 1.96 * std * sy, 3) + 0.0 as lower,
    round(mean * sy + my + 1.96 * std * sy, 3) + 0.0 as upper"""))
def gp_band(spark, sf):
    out = models.predict_rows(row_model(spark, sf), lineitem(spark, sf))
    lower, upper = band(F.col("pred_mean"), F.col("pred_std"))
    return shown(out.select(*LINE, lower.alias("lower"), upper.alias("upper")), 3, *LINE)


@query("gp_metrics", gpsql.statement(
    gpsql.row_points(PAIR), gpsql.solved("matern32", 2), gpsql.at_conditions(2), gpsql.predicted("matern32", 2),
    f"""v as (select (l.{TARGET} - m_{TARGET}) / s_{TARGET} y, mean as f from lineitem l, s, g join f on g.i = f.pid
              where l.l_discount + 0.0 = g.l_discount and l.l_tax + 0.0 = g.l_tax)""",
    select="""select round(1 - sum(pow(y - f, 2)) / (count(*) * var_pop(y)), 4) + 0.0 as r2,
        round(avg(abs(y - f)), 4) + 0.0 as mae, round(sqrt(avg(pow(y - f, 2))), 4) + 0.0 as rmse from v"""))
def gp_metrics(spark, sf):
    return models.training_metrics(row_model(spark, sf), lineitem(spark, sf))


@query("replicate_metrics", gpsql.statement(
    gpsql.replicate_points(PAIR), gpsql.solved("matern32", 2), gpsql.at_conditions(2), gpsql.predicted("matern32", 2),
    "v as (select mu as y, mean * ys + ym as f from g join f on g.i = f.pid, nm)",
    select="""select round(1 - sum(pow(y - f, 2)) / (count(*) * var_pop(y)), 4) + 0.0 as r2,
        round(avg(abs(y - f)), 4) + 0.0 as mae, round(sqrt(avg(pow(y - f, 2))), 4) + 0.0 as rmse from v"""))
def replicate_metrics(spark, sf):
    request = {"mode": "std", "std_num_cols": PAIR, "measurement_col": TARGET, "std_noise": "sem",
               "std_kernel_config": {"kernel_type": "matern", "nu": 1.5}}
    df = lineitem(spark, sf)
    fitted = requests.fit_request(df, request, tune=False)
    return requests.response_table(fitted, df).select("r2", "mae", "rmse")


def _fitted_sql(points, kind="matern32", scale="1.0", shift="0.0", digits=6):
    return gpsql.statement(
        points, gpsql.solved(kind, 2), gpsql.at_conditions(2), gpsql.predicted(kind, 2),
        select=f"""select l_discount, l_tax, round(mean * {scale} + {shift}, {digits}) + 0.0 as pred_mean,
            round(std * {scale}, {digits}) + 0.0 as pred_std from g join f on g.i = f.pid"""
               + (", nm" if scale != "1.0" else ""))


@query("gp_sparse_predict", _fitted_sql(gpsql.row_points(PAIR)))
def gp_sparse_predict(spark, sf):
    # Every condition is an inducing point, so the result is the exact one.
    return shown(fitted_conditions(row_model(spark, sf, method="sparse")), 6)


TRIPLE = ("l_quantity", *PAIR)


SAMPLE_Z = """z as (select row_number() over (order by h) - 1 i, x1, x2, x3 from (
    select *, ('0x' || substr(md5(concat_ws('|', l_quantity, l_discount, l_tax, '42')), 1, 15))::bigint as h from g order by h limit 512))"""


def _sparse_sql(inducing, digits, per_point=False):
    return gpsql.statement(gpsql.row_points(TRIPLE), inducing, gpsql.sparse_predicted("matern32", 3, per_point), select=f"""
        select l_quantity, l_discount, l_tax, round(mean, {digits}) + 0.0 as pred_mean, round(std, {digits}) + 0.0 as pred_std
        from g join f on g.i = f.pid""")


@query("gp_sparse_large", _sparse_sql("z as (select row_number() over (order by x2, x3) - 1 i, 0.0::double x1, x2, x3 "
                                      "from (select distinct x2, x3 from g))", 5))
def gp_sparse_large(spark, sf):
    """Every setting of three inputs through the 99 settings of two, at the mean of the third."""
    df = lineitem(spark, sf)
    mean = df.agg(F.avg("l_quantity")).scalar()
    settings = df.select(*PAIR).distinct().withColumn("l_quantity", mean)
    spec = AnalysisSpec(TRIPLE, TARGET, mode="mean")
    model = models.fit_model(df, spec, M32, tune=False, method="sparse", inducing=settings)
    return shown(fitted_conditions(model), 5)


@query("gp_sparse_sample", _sparse_sql(SAMPLE_Z, 5))
def gp_sparse_sample(spark, sf):
    """The same settings through 512 of them, picked by hash."""
    spec = AnalysisSpec(TRIPLE, TARGET, mode="mean")
    model = models.fit_model(lineitem(spark, sf), spec, M32, tune=False, method="sparse")
    return shown(fitted_conditions(model), 5)


@query("gp_sparse_fitc", _sparse_sql("z as (select row_number() over (order by x2, x3) - 1 i, 0.0::double x1, x2, x3 "
                                     "from (select distinct x2, x3 from g))", 5, per_point=True))
def gp_sparse_fitc(spark, sf):
    """As ``gp_sparse_large``, with every setting's unexplained variance added to its noise."""
    df = lineitem(spark, sf)
    settings = df.select(*PAIR).distinct().withColumn("l_quantity", df.agg(F.avg("l_quantity")).scalar())
    model = models.fit_model(df, AnalysisSpec(TRIPLE, TARGET, mode="mean"), M32, tune=False, method="sparse",
                             inducing=settings, per_point=True)
    return shown(fitted_conditions(model), 5)


PIVOTS = 8


@query("gp_pivots", gpsql.statement(gpsql.row_points(PAIR), f"""
    pk as materialized (select a.i, list({gpsql.kern('matern32', 'a', 'b', 2)} order by b.i) k from g a, g b group by a.i),
    pm as materialized (select list(k order by i) km, count(*) m from pk),
    pv(step, place, var, cols) as (
      select 0, -1::bigint, list_transform(range(any_value(m)), lambda x: 1.0::double), list_transform(range(any_value(m)), lambda x: []::double[]) from pm
      union all
      select step + 1, best, list_transform(list_zip(var, fresh), lambda c: c[1] - c[2] * c[2]),
             list_transform(list_zip(cols, fresh), lambda c: list_append(c[1], c[2]))
      from (select *, list_transform(list_zip(km[best + 1], cols), lambda c:
                      (c[1] - coalesce(list_sum(list_transform(list_zip(c[2], cols[best + 1]), lambda p: p[1] * p[2])), 0)) / sqrt(var[best + 1])) as fresh
            from (select pv.*, km, list_position(list_transform(var, lambda v: round(v, 9)), list_max(list_transform(var, lambda v: round(v, 9)))) - 1 as best
                  from pv, pm where step < {PIVOTS})))""", select="""
    select step::int as step, l_discount, l_tax from pv join g on g.i = pv.place where step > 0"""))
def gp_pivots(spark, sf):
    """The first inducing points of a greedy choice, in raw units."""
    model = models.fit_model(lineitem(spark, sf), ROW_SPEC, M32, tune=False, method="sparse", inducing=PIVOTS, choice="pivots")
    raw = model.solution.points * [model.scalers[c][1] for c in PAIR] + [model.scalers[c][0] for c in PAIR]
    rows = [(k, *map(float, point)) for k, point in enumerate(raw, 1)]
    return shown(spark.createDataFrame(rows, "step int, l_discount double, l_tax double"), 6, "step")


@query("gp_iterative", _fitted_sql(gpsql.row_points(PAIR), digits=5))
def gp_iterative(spark, sf):
    """The exact fit by conjugate gradients, preconditioned by a factor of 16 of the settings."""
    return shown(fitted_conditions(row_model(spark, sf, method="iterative", solver_options={"rank": 16})), 5, l_discount=6, l_tax=6)


@query("gp_iterative_likelihood", CANDIDATE_SQL)
def gp_iterative_likelihood(spark, sf):
    """Likelihoods of the same candidates without a factor of the covariance, at a rank of all settings."""
    spec = AnalysisSpec(("l_discount",), TARGET, mode="mean")
    found = [models.fit_model(lineitem(spark, sf), spec, replace(M32, length_scale=s), tune=False, method="iterative") for s in SCALES]
    rows = [(i, model.solution.lml) for i, model in enumerate(found)]
    return spark.createDataFrame(rows, "candidate_id int, lml double").select("candidate_id", rounded(F.col("lml"), 4).alias("lml"))


@query("row_response_model", _fitted_sql(gpsql.row_points(PAIR)))
def row_response_model(spark, sf):
    return shown(fitted_conditions(row_model(spark, sf)), 6)


@query("replicate_mean_model", _fitted_sql(gpsql.replicate_points(PAIR), scale="ys", shift="ym"))
def replicate_mean_model(spark, sf):
    model = models.fit_model(lineitem(spark, sf), STD_SPEC, M32, tune=False)
    return shown(fitted_conditions(model), 6)


@query("replicate_std_model", _fitted_sql(
    gpsql.replicate_points(PAIR, "std", "sd * sd"), kind="matern52", scale="ys", shift="ym"))
def replicate_std_model(spark, sf):
    spec = AnalysisSpec(PAIR, TARGET, mode="std", statistic="std", noise="std")
    model = models.fit_model(lineitem(spark, sf), spec, KERNEL_CONFIGS["matern52"], tune=False)
    return shown(fitted_conditions(model), 6)


@query("both_models", f"""
    with a as ({_fitted_sql(gpsql.replicate_points(PAIR), scale='ys', shift='ym')}),
         b as ({_fitted_sql(gpsql.row_points(PAIR))})
    select a.l_discount, a.l_tax, a.pred_mean as replicate_mean, a.pred_std as replicate_std,
           b.pred_mean as row_mean, b.pred_std as row_std from a join b using (l_discount, l_tax)""")
def both_models(spark, sf):
    std, row = models.fit_both(lineitem(spark, sf), STD_SPEC, ROW_SPEC, kernel=M32, tune=False)
    a = fitted_conditions(std).withColumnsRenamed({"pred_mean": "replicate_mean", "pred_std": "replicate_std"})
    b = fitted_conditions(row).withColumnsRenamed({"pred_mean": "row_mean", "pred_std": "row_std"})
    return shown(a.join(b, list(PAIR)), 6)


def _block_sql(value):
    source = f"(select * from lineitem where l_returnflag = '{value}')"
    points = f"""
    s as (select avg(l_discount) mx, stddev_pop(l_discount) sx, avg({TARGET}) my, stddev_pop({TARGET}) sy from lineitem),
    c as (select l_discount + 0.0 as l_discount, (l_discount + 0.0 - any_value(mx)) / any_value(sx) x1,
            avg(({TARGET} - my) / sy) mu, stddev_samp(({TARGET} - my) / sy) sd, count(*) n
          from {source} li, s group by l_discount + 0.0 having count(*) >= 2),
    nm as (select avg(mu) ym, stddev_pop(mu) ys from c),
    g as (select row_number() over (order by l_discount) - 1 i, c.*, (mu - ym) / ys y, sd * sd / n nz from c, nm)"""
    return gpsql.statement(
        points, gpsql.solved("matern32", 1), gpsql.at_conditions(1), gpsql.predicted("matern32", 1),
        select=f"""select '{value}' as l_returnflag, round(x1, 6) + 0.0 as l_discount, round(mu, 6) + 0.0 as mean,
            round(mean * ys + ym, 6) + 0.0 as fit_mean, round(std * ys, 6) + 0.0 as fit_std from g join f on g.i = f.pid, nm""")


PER_BLOCK_SQL = " union all ".join(f"select * from ({_block_sql(v)})" for v in FLAGS[0][1])


def _per_block(spark, sf, **options):
    # Block and keys are summarised raw and scaled afterwards, so equal settings stay equal.
    df = lineitem(spark, sf)
    row = scaling.scaler_row(df, ["l_discount", TARGET])
    summary = replicates.replicate_groups(df, ["l_discount"], TARGET, block="l_returnflag")
    summary = summary.select("l_returnflag", ((F.col("l_discount") - row["m0"]) / row["s0"]).alias("l_discount"),
                             ((F.col("mean") - row["m1"]) / row["s1"]).alias("mean"),
                             (F.col("std") / row["s1"]).alias("std"), "count")
    out = blocks.block_models(summary, "l_returnflag", ["l_discount"], "mean", M32, noise="sem", **options)
    return shown(out.drop("lml"), 6, "l_returnflag")


@query("gp_per_block", PER_BLOCK_SQL)
def gp_per_block(spark, sf):
    return _per_block(spark, sf)


@query("gp_per_block_sparse", PER_BLOCK_SQL)
def gp_per_block_sparse(spark, sf):
    """With every condition inducing the result is the exact one."""
    return _per_block(spark, sf, method="sparse")


BLOCK_SQL = " union all ".join("select * from (" + gpsql.statement(
    gpsql.row_points(["l_discount"], table=f"(select * from lineitem where l_returnflag = '{v}')"), gpsql.solved("matern32", 1),
    gpsql.at_conditions(1), gpsql.predicted("matern32", 1),
    f"v as (select l_discount as d, mean * s_{TARGET} + m_{TARGET} as mean, std * s_{TARGET} as std from g join f on g.i = f.pid, s)",
    select=f"""select l_orderkey, l_linenumber, round(mean, 3) + 0.0 as pred_mean, round(std, 3) + 0.0 as pred_std
        from lineitem li join v on li.l_discount + 0.0 = v.d where l_returnflag = '{v}'""") + ")" for v in FLAGS[0][1])


@query("gp_block_models", BLOCK_SQL)
def gp_block_models(spark, sf):
    """All rows scored by the model of their own block, each with its own scalers."""
    df, spec = lineitem(spark, sf), AnalysisSpec(("l_discount",), TARGET, mode="mean")
    fitted = materialize(block_fits.fit_blocks(df, "l_returnflag", spec, M32, tune=False))
    return shown(block_fits.predict_blocks(fitted, df, "l_returnflag", spec).select(*LINE, "pred_mean", "pred_std"), 3, *LINE)


# --- grids -----------------------------------------------------------------

def _grid_sql(column, name, n, log=False):
    point = f"lo * pow(hi / lo, i / {n - 1}.0)" if log else f"lo + i / {n - 1}.0::double * (hi - lo)"
    return f"""with s as (select min({column}) lo, max({column}) hi from {name})
        select i::int as point_id, round({point}, 4) + 0.0 as x from s, range({n}) t(i)"""


@query("grid_1d", _grid_sql("l_extendedprice", "lineitem", 300))
def grid_1d(spark, sf):
    row = profiling.range_row(lineitem(spark, sf), ["l_extendedprice"])
    return shown(grids.grid_1d(spark, row["lo0"], row["hi0"]), 4, "point_id")


@query("grid_1d_log", _grid_sql("o_totalprice", "orders", 300, log=True))
def grid_1d_log(spark, sf):
    row = profiling.range_row(table(spark, sf, "orders"), ["o_totalprice"])
    return shown(grids.grid_1d(spark, row["lo0"], row["hi0"], log=True), 4, "point_id")


@query("grid_2d", """
    with s as (select min(l_discount) x0, max(l_discount) x1, min(l_quantity) y0, max(l_quantity) y1 from lineitem)
    select (j * 100 + i)::int as point_id, round(x0 + i / 99.0::double * (x1 - x0), 8) + 0.0 as x,
           round(y0 + j / 99.0::double * (y1 - y0), 8) + 0.0 as y from s, range(100) a(i), range(100) b(j)""")
def grid_2d(spark, sf):
    row = profiling.range_row(lineitem(spark, sf), ["l_discount", "l_quantity"])
    return shown(grids.grid_2d(spark, (row["lo0"], row["hi0"]), (row["lo1"], row["hi1"])), 8, "point_id")


@query("grid_1d_by_combo", """
    with s as (select min(l_quantity) lo, max(l_quantity) hi from lineitem),
         c as (select 0 as combo_id, 'All' as label union all
               select row_number() over (order by label)::int, label from (
                 select distinct 'l_returnflag=' || l_returnflag as label from lineitem))
    select combo_id, label, i::int as point_id, round(lo + i / 299.0::double * (hi - lo), 8) + 0.0 as x
    from s, c, range(300) t(i)""")
def grid_1d_by_combo(spark, sf):
    df = lineitem(spark, sf)
    row = profiling.range_row(df, ["l_quantity"])
    combos = category_combos(df, ["l_returnflag"], include_all=True).drop("fixed")
    return shown(grids.grid_1d_by_combo(combos, row["lo0"], row["hi0"]), 8, "combo_id", "label", "point_id")


FLAG_SPEC = AnalysisSpec(("l_discount",), TARGET, cat_cols=("l_returnflag",), mode="mean")
FLAG_FRAME = """
    h as (select median((l_returnflag = 'A')::int) a, median((l_returnflag = 'N')::int) n,
                 median((l_returnflag = 'R')::int) r, min(l_discount) lo, max(l_discount) hi from lineitem),
    q(combo_id, combo) as (values (0, 'All'), (1, 'l_returnflag=A'), (2, 'l_returnflag=N'), (3, 'l_returnflag=R')),
    gr as (select combo_id, combo, i::int as point_id, lo + i / 299.0::double * (hi - lo) as x,
             case combo_id when 0 then a else (combo_id = 1)::int end as a,
             case combo_id when 0 then n else (combo_id = 2)::int end as n,
             case combo_id when 0 then r else (combo_id = 3)::int end as r from h, q, range(300) t(i))"""


@query("prediction_frame", "with " + FLAG_FRAME + """, t as (select median(l_tax) m from lineitem)
    select combo_id, point_id, round(x, 8) + 0.0 as l_discount, round(m, 8) + 0.0 as l_tax, a::double as l_returnflag_A,
           n::double as l_returnflag_N, r::double as l_returnflag_R from gr, t""")
def prediction_frame(spark, sf):
    spec = AnalysisSpec(PAIR, TARGET, cat_cols=("l_returnflag",), mode="mean")
    model = models.fit_model(lineitem(spark, sf), spec, M32, tune=False)
    combos = frames.combo_frame(model)
    lo, hi = frames.input_range(model, "l_discount")
    points = grids.grid_1d_by_combo(combos, lo, hi)
    out = frames.prediction_frame(points, {"l_discount": "x"}, frames.held_values(model), F.col("fixed"))
    return shown(out.select("combo_id", "point_id", *model.controls), 8, "combo_id", "point_id")


# --- curves and surfaces ---------------------------------------------------

@query("curve_1d", gpsql.statement(
    gpsql.row_points(["l_discount"], FLAGS), gpsql.solved("matern32", 4), FLAG_FRAME,
    "p as (select combo_id * 1000 + point_id as pid, (x - m_l_discount) / s_l_discount x1, a x2, n x3, r x4 from gr, s)",
    gpsql.predicted("matern32", 4), select=f"""
    select combo_id, combo, point_id, round(x, 8) + 0.0 as x, round(mean * s_{TARGET} + m_{TARGET}, 1) + 0.0 as mean,
           round((mean - 1.96 * std) * s_{TARGET} + m_{TARGET}, 1) + 0.0 as lower,
           round((mean + 1.96 * std) * s_{TARGET} + m_{TARGET}, 1) + 0.0 as upper, '{TARGET}' as label
    from gr join f on f.pid = combo_id * 1000 + point_id, s"""))
def curve_1d(spark, sf):
    model = models.fit_model(lineitem(spark, sf), FLAG_SPEC, M32, tune=False)
    return shown(frames.curve_1d(model, "l_discount"), 1, "combo_id", "combo", "point_id", "label", x=8)


@query("curve_tuned", gpsql.statement(
    gpsql.row_points(["l_discount"]), f"""
    lc as materialized (select candidate_id as c, lml from ({_candidate_sql(SCALE_GRID, 12)})),
    top as (select arg_max(c, lml) as c from lc),
    near as (select any_value(top.c) as c, any_value(lc.lml) filter (lc.c = top.c) as f0, {', '.join(
        f"coalesce(max(lc.lml) filter (lc.c = top.c {d:+d}), null) as f{n}" for n, d in zip("abcd", (-2, -1, 1, 2)))} from lc, top),
    bend as (select c, (fa - 8 * fb + 8 * fc - fd) / 12 as d1, (-fa + 16 * fb - 30 * f0 + 16 * fc - fd) / 12 as d2, (fd - 2 * fc + 2 * fb - fa) / 2 as d3 from near),
    opt as materialized (select exp(ln({SCALE_GRID[0]}) + (c + coalesce(-d1 / d2 - d3 * pow(d1 / d2, 2) / (2 * d2), 0))
        * ln({SCALE_GRID[-1] / SCALE_GRID[0]}) / {len(SCALE_GRID) - 1}) as l from bend)""",
    gpsql.solved("matern32", 1, ["(select l from opt)"]),
    """gr as (select i::int as pid, lo + i / 299.0::double * (hi - lo) x
        from (select min(l_discount) lo, max(l_discount) hi from lineitem), range(300) t(i))""",
    "p as (select pid, (x - m_l_discount) / s_l_discount x1 from gr, s)", gpsql.predicted("matern32", 1, ["(select l from opt)"]), select=f"""
    select pid as point_id, round(x, 8) + 0.0 as x, round((mean * s_{TARGET} + m_{TARGET}) / 100, 0) + 0.0 as mean,
           round(((mean - 1.96 * std) * s_{TARGET} + m_{TARGET}) / 100, 0) + 0.0 as lower,
           round(((mean + 1.96 * std) * s_{TARGET} + m_{TARGET}) / 100, 0) + 0.0 as upper from gr join f using (pid), s"""))
def curve_tuned(spark, sf):
    """A curve, in hundreds, at the length scale that the search finds, against the peak of a fine grid of likelihoods.

    The grid gives the peak to about a millionth, hence so few digits. Two points from a
    bound or nearer, the grid's best point counts.
    """
    model = models.fit_model(lineitem(spark, sf), AnalysisSpec(("l_discount",), TARGET, mode="mean"), ONE_SCALE)
    out = frames.curve_1d(model, "l_discount")
    values = [(F.col(c) / 100).alias(c) for c in ("mean", "lower", "upper")]
    return shown(out.select("point_id", "x", *values), 0, "point_id", x=8)


@query("gp_coded_categories", gpsql.statement(
    gpsql.row_points(["l_discount"], FLAGS), gpsql.solved("matern32", 4), gpsql.at_conditions(4), gpsql.predicted("matern32", 4),
    select="""select l_discount, l_returnflag, round(mean, 6) + 0.0 as pred_mean, round(std, 6) + 0.0 as pred_std from g join f on g.i = f.pid"""))
def gp_coded_categories(spark, sf):
    """A category as one coded input, against a column per level."""
    model = models.fit_model(lineitem(spark, sf), FLAG_SPEC, M32, tune=False, encoding="codes")
    return shown(fitted_conditions(model), 6, "l_returnflag")


@query("scatter_1d", f"""
    select 0 as combo_id, 'All' as combo, l_discount + 0.0 as x, {TARGET} as y from lineitem
    union all select case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end, 'l_returnflag=' || l_returnflag,
           l_discount + 0.0, {TARGET} from lineitem""")
def scatter_1d(spark, sf):
    df = lineitem(spark, sf)
    model = models.fit_model(df, FLAG_SPEC, M32, tune=False)
    return shown(frames.scatter_1d(model, "l_discount", df), 6, "combo_id", "combo")


SURFACE_CTES = (
    gpsql.row_points(PAIR), gpsql.solved("matern32", 2),
    """gr as (select j * 100 + i as pid, x0 + i / 99.0::double * (x1 - x0) x, y0 + j / 99.0::double * (y1 - y0) y
        from (select min(l_discount) x0, max(l_discount) x1, min(l_tax) y0, max(l_tax) y1 from lineitem),
             range(100) a(i), range(100) b(j))""",
    "p as (select pid, (x - m_l_discount) / s_l_discount x1, (y - m_l_tax) / s_l_tax x2 from gr, s)",
    gpsql.predicted("matern32", 2),
    f"""sf as (select pid::int as point_id, x, y, greatest(mean * s_{TARGET} + m_{TARGET}, 0) as mean, std
        from gr join f using (pid), s)""")


@query("surface_2d", gpsql.statement(*SURFACE_CTES, select="""
    select point_id, round(x, 8) + 0.0 as x, round(y, 8) + 0.0 as y, round(mean, 1) + 0.0 as mean,
           round(std, 6) + 0.0 as std from sf"""))
def surface_2d(spark, sf):
    return shown(frames.surface_2d(row_model(spark, sf), *PAIR), 1, "point_id", x=8, y=8, std=6)


@query("surface_bands", gpsql.statement(
    *SURFACE_CTES, "r as (select min(mean) m0, max(mean) m1, min(std) s0, max(std) s1 from sf)", select="""
    select point_id, least(floor((mean - m0) * 40 / (m1 - m0)) + 1, 40)::int as mean_band,
           least(floor((std - s0) * 40 / (s1 - s0)) + 1, 40)::int as std_band from sf, r"""))
def surface_bands(spark, sf):
    surface = frames.surface_2d(row_model(spark, sf), *PAIR)
    return frames.surface_bands(surface).select("point_id", "mean_band", "std_band")


# The least round step with which 41 steps span the range, and the levels around it.
LEVEL_CTES = f"""
    rg as (select min(mean) lo, max(mean) hi from sf),
    rs as (select lo, hi, min(p * s) as step, case when abs(lo + hi) / 2 < 100 * (hi - lo) then 0
             else sign(lo) * pow(10, floor(log10(abs(lo + hi) / 2))) end as origin
           from rg, (select unnest({list(ROUND_STEPS)}::double[]) as s), (select unnest([-1, 0, 1]) as q),
                lateral (select pow(10::double, floor(log10((hi - lo) / 41)) + q) as p) where p * s >= (hi - lo) / 41 group by lo, hi),
    lv as (select origin, step, floor((lo - origin) / step)::bigint as k0, ceil((hi - origin) / step)::bigint as k1 from rs)"""


@query("contour_levels_2d", gpsql.statement(*SURFACE_CTES, LEVEL_CTES, select="""
    select (k - k0)::int as level_id, round(origin + k * step, 4) + 0.0 as level from lv, lateral (select unnest(range(k0, k1 + 1)) as k)"""))
def contour_levels_2d(spark, sf):
    """The rounded values at which a surface's contours are drawn."""
    surface = frames.surface_2d(row_model(spark, sf), *PAIR)
    return shown(contours.contour_levels(surface, "mean"), 4, "level_id")


@query("contour_lines_2d", gpsql.statement(*SURFACE_CTES, LEVEL_CTES, """
    sq as materialized (select a.point_id as cell, a.x as xa, b.x as xb, a.y as ya, c.y as yb, a.mean as v0, b.mean as v1, c.mean as v2, d.mean as v3
        from sf a join sf b on b.point_id = a.point_id + 1 join sf c on c.point_id = a.point_id + 101 join sf d on d.point_id = a.point_id + 100
        where a.point_id % 100 < 99),
    cr as materialized (select sq.*, origin + k * step as z from sq, lv, lateral (select unnest(range(k0, k1 + 1)) as k)
        where least(v0, v1, v2, v3) < origin + k * step and greatest(v0, v1, v2, v3) >= origin + k * step),
    ed as (select cell, z, (v0 + v1 + v2 + v3) / 4 >= z as mid, v0 >= z as one, list_filter([
            case when (v0 >= z) <> (v1 >= z) then {'e': 0, 'x': xa + (z - v0) / (v1 - v0) * (xb - xa), 'y': ya} end,
            case when (v1 >= z) <> (v2 >= z) then {'e': 1, 'x': xb, 'y': ya + (z - v1) / (v2 - v1) * (yb - ya)} end,
            case when (v2 >= z) <> (v3 >= z) then {'e': 2, 'x': xb + (z - v2) / (v3 - v2) * (xa - xb), 'y': yb} end,
            case when (v3 >= z) <> (v0 >= z) then {'e': 3, 'x': xa, 'y': yb + (z - v3) / (v0 - v3) * (ya - yb)} end], lambda p: p is not null) as es from cr),
    ln as (select cell, z, unnest(case when len(es) = 2 then [[es[1], es[2]]] when mid = one then [[es[1], es[2]], [es[3], es[4]]]
        else [[es[4], es[1]], [es[2], es[3]]] end) as ab from ed),
    ends as (select cell, z, case when (ab[1].x, ab[1].y) <= (ab[2].x, ab[2].y) then ab else [ab[2], ab[1]] end as ab from ln)""", select="""
    select round(z, 4) + 0.0 as level, cell::bigint as cell, round(ab[1].x, 5) + 0.0 as x0, round(ab[1].y, 5) + 0.0 as y0,
           round(ab[2].x, 5) + 0.0 as x1, round(ab[2].y, 5) + 0.0 as y1 from ends"""))
def contour_lines_2d(spark, sf):
    """Contour lines of a surface's mean as straight pieces."""
    surface = materialize(frames.surface_2d(row_model(spark, sf), *PAIR))
    return shown(contours.contour_lines(surface, "mean", SURFACE_POINTS), 5, "cell", level=4)


@query("scatter_2d", f"select l_discount + 0.0 as x, l_tax + 0.0 as y, {TARGET} as z from lineitem")
def scatter_2d(spark, sf):
    df = lineitem(spark, sf)
    return shown(frames.scatter_2d(row_model(spark, sf), *PAIR, df), 6)


def _curve_pair_sql(points, kind):
    return gpsql.statement(
        points, gpsql.solved(kind, 1),
        """gr as (select i as pid, lo + i / 299.0::double * (hi - lo) x
            from (select min(l_discount) lo, max(l_discount) hi from lineitem), range(300) t(i))""",
        "p as (select pid, (x - m_l_discount) / s_l_discount x1 from gr, s)", gpsql.predicted(kind, 1),
        select="""select pid, x, {v} as mean, {s} as std from gr join f using (pid), s""")


@query("pair_std_mean", f"""
    with a as ({_curve_pair_sql(gpsql.replicate_points(['l_discount']), 'matern32').format(
        v=f'(mean * (select ys from nm) + (select ym from nm)) * s_{TARGET} + m_{TARGET}',
        s=f'std * (select ys from nm) * s_{TARGET}')}),
         b as ({_curve_pair_sql(gpsql.row_points(['l_discount']), 'matern32').format(
        v=f'mean * s_{TARGET} + m_{TARGET}', s=f'std * s_{TARGET}')})
    select pid::int as point_id, round(a.x, 8) + 0.0 as std_x, round(a.mean, 1) + 0.0 as std_mean,
           round(a.mean - 1.96 * a.std, 1) + 0.0 as std_lower, round(a.mean + 1.96 * a.std, 1) + 0.0 as std_upper,
           round(b.x, 8) + 0.0 as row_x, round(b.mean, 1) + 0.0 as row_mean,
           round(b.mean - 1.96 * b.std, 1) + 0.0 as row_lower, round(b.mean + 1.96 * b.std, 1) + 0.0 as row_upper
    from a full join b using (pid)""")
def pair_std_mean(spark, sf):
    std = AnalysisSpec(("l_discount",), TARGET, mode="std", noise="sem")
    row = AnalysisSpec(("l_discount",), TARGET, mode="mean")
    a, b = models.fit_both(lineitem(spark, sf), std, row, kernel=M32, tune=False)
    pairs = frames.pair_curves(frames.curve_1d(a, "l_discount"), frames.curve_1d(b, "l_discount"))
    return shown(pairs.drop("combo_id", "std_combo", "row_combo"), 1, "point_id", std_x=8, row_x=8)
