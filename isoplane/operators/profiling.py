"""Column profiles: ranges, medians, histograms, correlation, metrics, best rows."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from isoplane.cluster import materialize
from isoplane.functions.scalars import quotient
from isoplane.sources.tables import col, number
from isoplane.spec import CONTOUR_LEVELS, TOP_ROWS

MEDIAN_BINS = 4096
#: Items a sketch keeps per level, and how far around the middle rank it is asked; its error is below half of that.
SKETCH_SIZE = 800
SKETCH_MARGIN = 0.01
#: Counted values of all columns that the driver sorts.
MEDIAN_ROWS = 200_000


def column_ranges(df: DataFrame, columns) -> DataFrame:
    """``(column, min, max)`` for each column, one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.min(number(c)).alias("min"),
                      F.max(number(c)).alias("max")) for c in columns]
    return df.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def range_row(df: DataFrame, columns) -> Column:
    """The same as one lazy struct: ``row["lo0"], row["hi0"], ...``."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}")]
    return df.agg(F.struct(*parts).alias("row")).scalar()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(col(column)).distinct().orderBy(col(column))


def _brackets(values: DataFrame, columns, sketched: bool) -> dict:
    """Per column number: least, greatest and bracketing values of the median, and the weight of all values.

    One read. The bracket comes from a quantile sketch, or is the whole range without one.
    """
    parts = []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        parts += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.sum(F.when(v.isNotNull(), F.col("w"))).alias(f"n{i}")]
        if sketched:
            parts.append(F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE)).alias(f"k{i}"))
    row = values.agg(*parts)
    if sketched:
        row = row.withColumns({f"{name}{i}": F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"k{i}", F.lit(0.5 + side)))
                               for i in range(len(columns)) for name, side in (("a", -SKETCH_MARGIN), ("b", SKETCH_MARGIN))})
    row = row.drop(*[f"k{i}" for i in range(len(columns))]).first().asDict()
    return {i: (row[f"lo{i}"], row[f"hi{i}"], row.get(f"a{i}", row[f"lo{i}"]), row.get(f"b{i}", row[f"hi{i}"]), row[f"n{i}"])
            for i in range(len(columns))}


def _middle(counts, before: int, n: int):
    """The one or two counted entries that hold the middle ranks, as ``(entry, weight before it)``; fewer if they lie elsewhere."""
    holds, run = [], before
    for r in counts:
        holds += [(r, run)] * sum(run <= rank < run + r.w for rank in ((n - 1) // 2, n // 2))
        run += r.w
    return holds


def _narrowed(inside: DataFrame, open_ranges: dict, totals: dict, bins: int) -> dict:
    """Medians of counted values ``(i, v, w)`` by repeated equal-width counts between known bounds."""
    found = {i: lo for i, (lo, hi, _) in open_ranges.items() if lo == hi}
    open_ranges = {i: r for i, r in open_ranges.items() if i not in found}
    while open_ranges:
        bounds = F.element_at(F.create_map(*[x for i, (lo, hi, _) in open_ranges.items() for x in (
            F.lit(i), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))]), F.col("i"))
        near = inside.where(F.col("i").isin(list(open_ranges))).withColumn("at", bounds).where("v between at.lo and at.hi")
        # Halves keep the width finite for any pair of doubles.
        share = (F.col("v") / 2 - F.col("at.lo") / 2) / (F.col("at.hi") / 2 - F.col("at.lo") / 2)
        counts = near.groupBy("i", F.floor(share * bins).alias("bin")).agg(
            F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for i in list(open_ranges):
            own = sorted((r for r in counts if r.i == i), key=lambda r: r.lo)
            (first, before), (second, _) = _middle(own, open_ranges[i][2], totals[i])
            if first.lo == second.lo and first.lo < first.hi:
                open_ranges[i] = (first.lo, first.hi, before)
            else:
                found[i] = first.hi + (second.lo - first.hi) * 0.5
                del open_ranges[i]
    return found


def exact_medians(df: DataFrame, columns, weight: str | None = None, bins: int = MEDIAN_BINS, sketched: bool = True) -> dict:
    """Exact median of each column; ``weight`` counts a row that many times.

    The source is read twice, whatever the distribution: a quantile sketch brackets the
    middle of every column, then one aggregate counts the values inside the brackets and
    how many lie below, which is written. Up to MEDIAN_ROWS counted values finish on the
    driver; more are narrowed down by equal-width counts over what was written. Should a
    bracket miss its median, or weights rule a sketch out, the bracket is the whole range.
    """
    values = df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(columns)],
                       (col(weight) if weight else F.lit(1)).cast("bigint").alias("w"))
    brackets = _brackets(values, columns, sketched and weight is None)
    found, todo = {}, {}
    for i, (lo, hi, a, b, n) in brackets.items():
        if n is None or lo == hi:
            found[i] = lo
        elif math.isinf(lo) or math.isinf(hi):
            raise ValueError(f"{columns[i]!r} holds infinite values")
        else:
            todo[i] = (a, b)
    if todo:
        parts = [F.struct(F.lit(i).alias("i"), F.when(F.col(f"v{i}") < a, float("-inf")).when(F.col(f"v{i}") <= b, F.col(f"v{i}")).alias("v"), "w")
                 for i, (a, b) in todo.items()]
        counted = values.select(F.inline(F.array(*parts))).where("v is not null").groupBy("i", "v").agg(F.sum("w").alias("w"))
        counted = materialize(counted)
        below = {r.i: r.w for r in counted.where(F.col("v") == float("-inf")).collect()}
        inside, totals = counted.where(F.col("v") > float("-inf")), {i: brackets[i][4] for i in todo}
        rows = inside.limit(MEDIAN_ROWS + 1).collect()
        if len(rows) <= MEDIAN_ROWS:
            missed = []
            for i in todo:
                holds = _middle(sorted((r for r in rows if r.i == i), key=lambda r: r.v), below.get(i, 0), totals[i])
                if len(holds) == 2:
                    (first, _), (second, _) = holds
                    found[i] = first.v + (second.v - first.v) * 0.5
                else:
                    missed.append(i)
        else:
            held = {r.i: r.w for r in inside.groupBy("i").agg(F.sum("w").alias("w")).collect()}
            sure = [i for i in todo if below.get(i, 0) <= (totals[i] - 1) // 2 and totals[i] // 2 < below.get(i, 0) + held.get(i, 0)]
            missed = [i for i in todo if i not in sure]
            found |= _narrowed(inside, {i: (*todo[i], below.get(i, 0)) for i in sure}, totals, bins)
        if missed:
            again = exact_medians(df, [columns[i] for i in missed], weight, bins, sketched=False)
            found |= {i: again[columns[i]] for i in missed}
    return {c: found[i] for i, c in enumerate(columns)}


def column_medians(df: DataFrame, columns) -> DataFrame:
    """``(column, median)`` rows."""
    found = exact_medians(df, columns)
    return df.sparkSession.createDataFrame([(c, found[c]) for c in columns], "column string, median double")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts ``(bin, lo, hi, count)``, last bin closed, empty bins kept.

    A column with a single value gets a range of half a unit either side.
    """
    v = number(column)
    row = range_row(df, [column])
    flat = row["lo0"] == row["hi0"]
    lo = F.when(flat, row["lo0"] - 0.5).otherwise(row["lo0"])
    hi = F.when(flat, row["hi0"] + 0.5).otherwise(row["hi0"])
    step = (hi - lo) / bins

    def edge(i):
        return F.when(i == bins, hi).otherwise(lo + i * step)

    guess = F.least(F.floor((v - lo) / step), F.lit(bins - 1)).cast("int")
    # The quotient can round across an edge; the edge itself decides.
    exact = F.when(v < edge(guess), guess - 1).when(
        (guess < bins - 1) & (v >= edge(guess + 1)), guess + 1).otherwise(guess)
    counts = df.where(v.isNotNull()).groupBy((exact + 1).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    i = F.col("bin") - 1
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin", edge(i).alias("lo"), edge(i + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("count"))


def equal_bands(df: DataFrame, column: str, levels: int = CONTOUR_LEVELS, name: str = "band") -> DataFrame:
    """Each row's contour band 1..levels on a column, equal width."""
    row = range_row(df, [column])
    flat = row["lo0"] == row["hi0"]
    bucket = F.width_bucket(number(column), row["lo0"], row["hi0"], F.lit(levels))
    return df.withColumn(name, F.when(flat, 1).otherwise(F.least(bucket, F.lit(levels))).cast("int"))


def parameter_correlation(df: DataFrame, parameters, score: str) -> DataFrame:
    """Signed Pearson correlation with the score per parameter; NULL for a constant one."""
    y = number(score)
    parts = []
    for p in parameters:
        x = number(p)
        # Deviations over the rows that have both values.
        xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        parts.append(F.struct(F.lit(p).alias("parameter"), quotient(
            F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys)).alias("correlation")))
    return df.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def top_parameters(correlations: DataFrame, k: int = 2) -> DataFrame:
    """Parameters by absolute correlation, strongest first."""
    return correlations.orderBy(F.abs("correlation").desc_nulls_last(), "parameter").limit(k)


def best_row(df: DataFrame, score: str, id_col: str) -> DataFrame:
    """The row with the highest score; the lowest id wins ties."""
    return df.orderBy(number(score).desc_nulls_last(), col(id_col)).limit(1)


def top_rows(df: DataFrame, score: str, id_col: str, k: int = TOP_ROWS) -> DataFrame:
    """The k highest scores; the lowest ids win ties."""
    return df.orderBy(number(score).desc_nulls_last(), col(id_col)).limit(k)


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """``mean, best, lowest, count`` of a score."""
    s = number(score)
    return df.agg(F.avg(s).alias("mean"), F.max(s).alias("best"), F.min(s).alias("lowest"),
                  F.count(s).alias("count"))


def fit_metrics(df: DataFrame, observed: str, predicted: str, digits: int | None = None) -> DataFrame:
    """One row ``r2, mae, rmse``; R2 compares with the mean, it is no squared correlation."""
    y, f = number(observed), number(predicted)
    sse = F.sum((y - f) * (y - f))
    row = df.agg((1 - quotient(sse, F.count(y) * F.var_pop(y))).alias("r2"),
                 F.avg(F.abs(y - f)).alias("mae"),
                 F.sqrt(F.avg((y - f) * (y - f))).alias("rmse"))
    return row if digits is None else row.select([F.round(c, digits).alias(c) for c in row.columns])
