"""Standard scaling with population statistics."""

from pyspark.sql import Column, DataFrame, functions as F

from isoplane.sources.tables import number


def _scale_of(name: str) -> Column:
    """Population deviation; 1 for a constant column."""
    return F.when(F.min(number(name)) == F.max(number(name)), F.lit(1.0)).otherwise(F.stddev_pop(number(name)))


def fit_scaler(df: DataFrame, columns) -> DataFrame:
    """``(column, mean, scale)`` for each column from one aggregate; NULLs are skipped."""
    parts = [F.struct(F.lit(c).alias("column"), F.avg(number(c)).alias("mean"),
                      _scale_of(c).alias("scale")) for c in columns]
    return df.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def scaler_row(df: DataFrame, columns) -> Column:
    """The same statistics as one lazy struct: ``row["m0"], row["s0"], ...``."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.avg(number(c)).alias(f"m{i}"), _scale_of(c).alias(f"s{i}")]
    return df.agg(F.struct(*parts).alias("row")).scalar()


def scale_columns(df: DataFrame, columns, fitted_on: DataFrame | None = None) -> DataFrame:
    """Columns standardised by statistics of ``fitted_on`` (default: the frame itself)."""
    row = scaler_row(fitted_on if fitted_on is not None else df, columns)
    return df.withColumns({c: (number(c) - row[f"m{i}"]) / row[f"s{i}"] for i, c in enumerate(columns)})


def unscale_columns(df: DataFrame, columns, fitted_on: DataFrame) -> DataFrame:
    """Back to the original units of ``fitted_on``."""
    row = scaler_row(fitted_on, columns)
    return df.withColumns({c: number(c) * row[f"s{i}"] + row[f"m{i}"] for i, c in enumerate(columns)})


def scaled(value: Column, scaler) -> Column:
    mean, scale = scaler
    return (value - F.lit(mean)) / F.lit(scale)


def unscaled(value: Column, scaler, spread: bool = False, exponentiate: bool = False) -> Column:
    """Original units; a spread is only multiplied. ``exponentiate`` undoes a logged target."""
    if scaler is not None:
        mean, scale = scaler
        value = value * F.lit(scale) + F.lit(0.0 if spread else mean)
    return F.exp(value) if exponentiate and not spread else value
