"""Design scoring: draw settings, predict their outcome, rank and profile them."""

from pyspark.sql import DataFrame, functions as F

from isoplane.cluster import materialize
from isoplane.functions.scalars import band, clip
from isoplane.operators import profiling
from isoplane.operators.design import lhs_design
from isoplane.operators.ranking import with_rank
from isoplane.plans.models import Model, fit_model, predict_rows
from isoplane.sources.tables import complete_cases, write_table
from isoplane.spec import (DESIGN_LIMITS, DESIGN_NOISE, DESIGN_SAMPLES, DESIGN_SEED, PARAMETER_BINS, SCORE_BINS,
                           AnalysisSpec, KernelConfig)


def score_rows(model: Model, settings: DataFrame, lo: float | None = DESIGN_LIMITS[0],
               hi: float | None = DESIGN_LIMITS[1]) -> DataFrame:
    """Settings with ``score`` (unclipped), ``predicted``, ``uncertainty`` and clipped bounds."""
    scored = predict_rows(model, settings, mean="score", std="uncertainty")
    lower, upper = band(F.col("score"), F.col("uncertainty"))
    return scored.withColumns({"predicted": clip(F.col("score"), lo, hi),
                               "lower_bound": clip(lower, lo, hi), "upper_bound": clip(upper, lo, hi)})


def score_design(model: Model, n: int, ranges: dict, seed: int = DESIGN_SEED, lo: float | None = DESIGN_LIMITS[0],
                 hi: float | None = DESIGN_LIMITS[1]) -> DataFrame:
    """A Latin-hypercube design over the ranges, scored where it is generated."""
    return score_rows(model, lhs_design(model.conditions.sparkSession, n, ranges, seed), lo, hi)


def sorted_scores(scored: DataFrame, score: str = "score", id_col: str = "sample_id", written: bool = False) -> DataFrame:
    """``rank, score, lower_bound, upper_bound`` from the lowest score up.

    Scores are written before they are ranked, unless ``written`` says they are already.
    """
    needed = scored.select(id_col, F.col(score), "lower_bound", "upper_bound")
    scored = scored if written else materialize(needed)
    return with_rank(scored, score, id_col).select("rank", F.col(score).alias("score"),
                                                   "lower_bound", "upper_bound")


def top2_scatter(scored: DataFrame, parameters, score: str = "score", id_col: str = "sample_id",
                 written: bool = False) -> DataFrame:
    """``p1, p2, score, is_best`` over the two parameters that move the score most.

    Three passes read the scores, which are written once unless ``written`` says they are.
    """
    scored = scored if written else materialize(scored.select(id_col, *[F.col(f"`{p}`") for p in parameters], F.col(score)))
    best = profiling.best_row(scored, score, id_col).select(id_col).scalar()
    found = profiling.top_parameters(profiling.parameter_correlation(scored, parameters, score)).collect()
    first, second = found[0].parameter, found[-1].parameter
    return scored.select(F.col(f"`{first}`").alias("p1"), F.col(f"`{second}`").alias("p2"),
                         F.col(score).alias("score"), (F.col(id_col) == best).alias("is_best"))


def design_job(df: DataFrame, features, target: str, ranges: dict, n: int = DESIGN_SAMPLES,
               seed: int = DESIGN_SEED, path: str | None = None, limits=DESIGN_LIMITS, **options) -> dict:
    """Train on the complete rows, draw and score a design, and profile it.

    Returns the ``model`` and the tables ``ranges``, ``training``, ``scored``,
    ``best``, ``top``, ``summary``, ``parameter_histograms`` (by name),
    ``score_histogram``, ``sorted``, ``importance`` and ``top2``. The scored design
    is written once and every table reads that; with ``path`` it is also saved.
    """
    features = list(features)
    train = complete_cases(df, features, target)
    spec = AnalysisSpec(features, target, mode="mean")
    options = {"kernel": KernelConfig.design_default(), "constant": DESIGN_NOISE, "seed": seed, **options}
    model = fit_model(train, spec, **options)
    scored = materialize(score_design(model, n, {f: ranges[f] for f in features}, seed, *limits))
    if path:
        write_table(scored.drop("score"), path)
    return {
        "model": model, "ranges": profiling.column_ranges(train, features),
        "training": profiling.score_summary(train, target), "scored": scored,
        "best": profiling.best_row(scored, "score", "sample_id"),
        "top": profiling.top_rows(scored, "predicted", "sample_id"),
        "summary": profiling.score_summary(scored, "score"),
        "parameter_histograms": {f: profiling.histogram(scored, f, PARAMETER_BINS) for f in features},
        "score_histogram": profiling.histogram(scored, "score", SCORE_BINS),
        "sorted": sorted_scores(scored, written=True),
        "importance": profiling.parameter_correlation(scored, features, "score"),
        "top2": top2_scatter(scored, features, written=True),
    }
