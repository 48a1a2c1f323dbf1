"""Helpers of the query modules."""

from isoplane.functions.scalars import rounded
from isoplane.sources.tables import col, read_table


def table(spark, sf_dir, name):
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def shown(df, digits, *plain, **per_column):
    """Plain columns as they are, all others rounded."""
    return df.select([
        col(c) if c in plain else rounded(col(c), per_column.get(c, digits)).alias(c) for c in df.columns])
