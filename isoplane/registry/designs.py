"""Latin-hypercube designs over the tables' own ranges, scored and ranked."""

from pyspark.sql import functions as F

from isoplane.operators import profiling
from isoplane.operators.design import PRIME, design_keys, lhs_design as draw_design
from isoplane.plans import models, scoring
from isoplane.registry import gpsql, query
from isoplane.registry.models import M32, PAIR, ROW_SPEC, TARGET
from isoplane.registry.shared import shown, table

SEED = 42


def design_sql(name, columns, counted, source="lineitem"):
    """CTEs ending in ``name(sample_id, columns)``: one sample per row of ``counted``
    over the column ranges of ``source``."""
    keys = design_keys(len(columns), SEED)
    dims = range(len(columns))

    def mixed(x, a, b):
        y = f"((({x}) % {PRIME}) * {a} + ({x}) // {PRIME} + {b}) % {PRIME}"
        return f"({y}) * ({y}) % {PRIME}"

    bounds = ", ".join(f"min({c}) lo{d}, max({c}) hi{d}" for d, c in enumerate(columns))
    ctes = [f"size as (select (select count(*) from {counted}) n, {bounds} from {source})",
            f"x0 as (select unnest(range(0, n)) id, n, {', '.join(f'unnest(range(0, n)) x{d}' for d in dims)} from size)"]
    for r in range(len(keys[0]["rounds"])):
        other = ", ".join(f"(({keys[d]['rounds'][r][0]} - x{d}) % n + n) % n p{d}" for d in dims)
        pick = ", ".join(f"case when {mixed(f'greatest(x{d}, p{d})', *keys[d]['rounds'][r][1:])} % 2 = 1 then p{d} else x{d} end x{d}"
                         for d in dims)
        ctes.append(f"x{r + 1} as (select id, n, {pick} from (select *, {other} from x{r}))")
    last = f"x{len(keys[0]['rounds'])}"
    unit = ", ".join(
        f"lo{d} + ((x{d} + ({mixed('id', *keys[d]['jitter'])}) / {PRIME}::double) / x.n) * (hi{d} - lo{d}) as {c}"
        for d, c in enumerate(columns))
    ctes.append(f"{name} as (select id + 1 as sample_id, {unit} from {last} x, size)")
    return ", ".join(ctes)


def _ranges(df, columns):
    return {r.column: (r.min, r.max) for r in profiling.column_ranges(df, columns).collect()}


WIDE = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_partkey", "l_suppkey"]


@query("lhs_design", "with " + design_sql("d", WIDE, "lineitem") + " select sample_id, " + ", ".join(
    f"round({c}, 6) + 0.0 as {c}" for c in WIDE) + " from d")
def lhs_design(spark, sf):
    """As many settings as the table has rows, over its own ranges."""
    df = table(spark, sf, "lineitem")
    return shown(draw_design(spark, df.count(), _ranges(df, WIDE), SEED), 6, "sample_id")


def _scored_ctes(with_std=True):
    return [
        gpsql.row_points(PAIR), gpsql.solved("matern32", 2), design_sql("d", list(PAIR), "orders"),
        "p as (select sample_id pid, (l_discount - m_l_discount) / s_l_discount x1, (l_tax - m_l_tax) / s_l_tax x2 from d, s)",
        gpsql.predicted("matern32", 2, with_std=with_std),
        f"""sc as (select sample_id, l_discount, l_tax, mean * s_{TARGET} + m_{TARGET} as score, std * s_{TARGET} as uncertainty
              from d join f on f.pid = d.sample_id, s)""",
    ]

CEILING = 60_000.0
_CTES, _MEAN_CTES = _scored_ctes(), _scored_ctes(with_std=False)


def _scored(spark, sf):
    """The row model over lineitem, scored at one setting per order."""
    df = table(spark, sf, "lineitem")
    model = models.fit_model(df, ROW_SPEC, M32, tune=False)
    n = table(spark, sf, "orders").count()
    return scoring.score_design(model, n, _ranges(df, PAIR), SEED, 0.0, CEILING)


def _clip(value):
    return f"greatest(least({value}, {CEILING}), 0)::double"


_SCORED_COLUMNS = f"""sample_id, round(l_discount, 8) + 0.0 as l_discount, round(l_tax, 8) + 0.0 as l_tax,
    round(score, 1) + 0.0 as score, round({_clip('score')}, 1) + 0.0 as predicted, round(uncertainty, 1) + 0.0 as uncertainty,
    round({_clip('score - 1.96 * uncertainty')}, 1) + 0.0 as lower_bound,
    round({_clip('score + 1.96 * uncertainty')}, 1) + 0.0 as upper_bound"""


@query("score_design", gpsql.statement(*_CTES, select=f"select {_SCORED_COLUMNS} from sc"))
def score_design(spark, sf):
    return shown(_scored(spark, sf), 1, "sample_id", l_discount=8, l_tax=8)


@query("best_design", gpsql.statement(*_CTES, select=f"select {_SCORED_COLUMNS} from sc order by sc.score desc, sample_id limit 1"))
def best_design(spark, sf):
    return shown(profiling.best_row(_scored(spark, sf), "score", "sample_id"), 1, "sample_id", l_discount=8, l_tax=8)


@query("sorted_score_band", gpsql.statement(*_CTES, select=f"""
    select row_number() over (order by score, sample_id) as rank, round(score, 1) + 0.0 as score,
      round({_clip('score - 1.96 * uncertainty')}, 1) + 0.0 as lower_bound,
      round({_clip('score + 1.96 * uncertainty')}, 1) + 0.0 as upper_bound from sc"""))
def sorted_score_band(spark, sf):
    return shown(scoring.sorted_scores(_scored(spark, sf)), 1, "rank")


@query("parameter_importance", gpsql.statement(*_MEAN_CTES, select=" union all ".join(
    f"select '{c}' as parameter, round(corr({c}, score), 6) + 0.0 as correlation from sc" for c in PAIR)))
def parameter_importance(spark, sf):
    return shown(profiling.parameter_correlation(_scored(spark, sf), PAIR, "score"), 6, "parameter")


@query("top2_scatter", gpsql.statement(*_MEAN_CTES, f"""
    o as (select abs(corr(l_discount, score)) >= abs(corr(l_tax, score)) as first from sc),
    b as (select arg_max(sample_id, score) as id from sc)""", select="""
    select round(case when first then l_discount else l_tax end, 8) + 0.0 as p1,
           round(case when first then l_tax else l_discount end, 8) + 0.0 as p2,
           round(score, 1) + 0.0 as score, (sample_id = id)::int as is_best from sc, o, b"""))
def top2_scatter(spark, sf):
    out = scoring.top2_scatter(_scored(spark, sf), list(PAIR))
    return shown(out.withColumn("is_best", F.col("is_best").cast("int")), 1, "is_best", p1=8, p2=8)


@query("top10_design", gpsql.statement(*_MEAN_CTES, select=f"""
    select sample_id, round({_clip('score')}, 1) + 0.0 as predicted from sc
    order by {_clip('score')} desc, sample_id limit 10"""))
def top10_design(spark, sf):
    top = profiling.top_rows(_scored(spark, sf), "predicted", "sample_id", 10)
    return shown(top.select("sample_id", "predicted"), 1, "sample_id")


@query("design_summary", gpsql.statement(*_MEAN_CTES, select="""
    select round(avg(score), 3) + 0.0 as mean, round(max(score), 3) + 0.0 as best,
           round(min(score), 3) + 0.0 as lowest, count(*) as count from sc"""))
def design_summary(spark, sf):
    return shown(profiling.score_summary(_scored(spark, sf), "score"), 3, "count")
