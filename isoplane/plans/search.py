"""Hyperparameter search: likelihoods of many candidates, evaluated by executors.

A Latin-hypercube design over the log bounds is scored in parallel, then the best
starts are climbed in parallel by the likelihood's gradient, one task each. Seeded, so the same input gives
the same winner, and never one worse than the given kernel clipped to its bounds.
"""

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from isoplane.operators.design import design_keys, unit_samples
from isoplane.plans.gp import collapsed_likelihood, likelihood_slope, log_likelihood
from isoplane.spec import KernelConfig

CANDIDATES = 64
STARTS = 8
MAX_STEPS = 500
GRADIENT = 1e-6
RISE = 1e-4
TIE = 1e-8
EDGE = 0.05
SCHEMA = "candidate_id long, theta array<double>, lml double"


def candidate_thetas(start, bounds, n: int, seed: int) -> np.ndarray:
    """The start, then a design over the bounds; the outermost strata lie on the bounds."""
    low, high = np.array(bounds).T
    unit = unit_samples(np.arange(n), n, design_keys(len(low), seed))
    unit = np.clip(unit * (1 + 2 * EDGE) - EDGE, 0, 1)
    return np.vstack([start, low + unit * (high - low)])


def candidate_frame(spark: SparkSession, start, bounds, n: int, seed: int) -> DataFrame:
    """``(candidate_id, theta)`` in log units."""
    rows = [(i, theta.tolist()) for i, theta in enumerate(candidate_thetas(start, bounds, n, seed))]
    return spark.createDataFrame(rows, "candidate_id long, theta array<double>")


def _likelihood(kernel, data):
    """Function of log parameters; a matrix that cannot be factored scores minus infinity."""
    x, y, noise, counts, within = data
    width = x.shape[1]

    def value(theta):
        params = kernel.with_free(width, np.exp(theta)).params(width)
        try:
            if counts is None:
                return log_likelihood(params, x, y, noise)[0]
            return collapsed_likelihood(params, x, y, counts, within, noise)[0]
        except ValueError:
            return -np.inf

    return value


def _likelihood_slope(kernel, data):
    """Function of log parameters giving likelihood and gradient; minus infinity where nothing can be factored."""
    x, y, noise, counts, within = data
    width = x.shape[1]

    def value(theta):
        try:
            return likelihood_slope(kernel.with_free(width, np.exp(theta)), x, y, noise, counts, within)
        except ValueError:
            return -np.inf, np.zeros(len(theta))

    return value


def climb(value_and_slope, theta, low, high, max_steps: int = MAX_STEPS):
    """Quasi-Newton ascent inside the bounds, from ``theta``.

    BFGS on the parameters that no bound holds back, steps cut off at the bounds and
    halved until they rise enough (Nocedal and Wright 2006, chapters 3, 6 and 16). Returns the
    parameters, their value and whether the projected gradient vanished, or nothing rose
    any more, within ``max_steps`` evaluations.
    """
    best, slope = value_and_slope(theta)
    curve, fresh, used = np.eye(len(theta)), True, 1
    if not np.isfinite(best):
        return theta, best, True
    while np.abs(np.clip(theta + slope, low, high) - theta).max() > GRADIENT:
        free = ~((theta <= low) & (slope < 0) | (theta >= high) & (slope > 0))
        way = np.zeros(len(theta))
        way[free] = curve[np.ix_(free, free)] @ slope[free]
        if fresh:
            way /= max(1.0, np.abs(way).max())  # the first step is at most one in log units
        share, risen = 1.0, False
        while share > 1e-10 and not risen:
            if used >= max_steps:
                return theta, best, False
            tried = np.clip(theta + share * way, low, high)
            got, new = value_and_slope(tried)
            used += 1
            risen = np.isfinite(got) and got > best and got >= best + RISE * slope @ (tried - theta)
            share /= 2
        if not risen:
            if fresh:
                return theta, best, True
            curve, fresh = np.eye(len(theta)), True
            continue
        step, bend = tried - theta, slope - new
        theta, best, slope = tried, got, new
        if step @ bend > 1e-12:
            if fresh:
                curve = np.eye(len(theta)) * (step @ bend) / (bend @ bend)
            keep = np.eye(len(theta)) - np.outer(step, bend) / (step @ bend)
            curve, fresh = keep @ curve @ keep.T + np.outer(step, step) / (step @ bend), False
    return theta, best, True


def score_candidates(candidates: DataFrame, kernel: KernelConfig, x, y, noise, counts=None,
                     within=0.0) -> DataFrame:
    """``(candidate_id, theta, lml)`` for every candidate."""
    shared = candidates.sparkSession.sparkContext.broadcast((x, y, noise, counts, within))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value = _likelihood(kernel, shared.value)
        for batch in batches:
            yield batch.assign(lml=[value(theta) for theta in batch["theta"]])

    return candidates.mapInPandas(score, SCHEMA)


def improve_candidates(scored: DataFrame, kernel: KernelConfig, bounds, x, y, noise, counts=None,
                       within=0.0, max_steps: int = MAX_STEPS) -> DataFrame:
    """Scored candidates after a climb from each, one task per candidate; ``done`` if it converged."""
    shared = scored.sparkSession.sparkContext.broadcast((x, y, noise, counts, within))
    low, high = np.array(bounds).T

    def improve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value = _likelihood_slope(kernel, shared.value)
        for batch in batches:
            ends = [climb(value, np.array(theta), low, high, max_steps) for theta in batch["theta"]]
            yield batch.assign(theta=[t.tolist() for t, _, _ in ends], lml=[v for _, v, _ in ends], done=[d for _, _, d in ends])

    return scored.mapInPandas(improve, SCHEMA + ", done boolean")


def search(spark: SparkSession, kernel: KernelConfig, x, y, noise, counts=None, within=0.0,
           n: int = CANDIDATES, starts: int = STARTS, seed: int = 42, max_steps: int = MAX_STEPS):
    """Best kernel found and its likelihood; warns when its climb ran out of steps."""
    data = (x, y, noise, counts, within)
    free = kernel.free(x.shape[1])
    bounds = np.log([b for _, _, b in free])
    start = np.clip(np.log([v for _, v, _ in free]), *bounds.T)
    scored = score_candidates(candidate_frame(spark, start, bounds, n, seed), kernel, *data)
    first = scored.orderBy(F.desc("lml"), "candidate_id").limit(starts).repartition(starts)
    ends = improve_candidates(first, kernel, bounds, *data, max_steps=max_steps).collect()
    # Climbs that end on one ridge differ by rounding only; the first of them wins.
    best = max(r.lml for r in ends)
    top = min((r for r in ends if r.lml == best or r.lml >= best - TIE * (1 + abs(best))), key=lambda r: r.candidate_id)
    if not top.done:
        warnings.warn(f"the kernel search stopped after {max_steps} steps without converging; raise max_steps", stacklevel=3)
    return kernel.with_free(x.shape[1], np.exp(top.theta)), top.lml
