"""Replicate summaries: mean, sample spread and count per condition."""

from pyspark.sql import DataFrame, functions as F

from isoplane.cluster import fits, materialize
from isoplane.functions.scalars import all_of
from isoplane.sources.tables import col, number, quoted

BROADCAST_ROWS = 100_000


STATISTICS = ("mean", "std", "count", "n_valid")


def _usable(df, controls, block, categories):
    """Missing numeric conditions are left out; a missing category is a condition of its own."""
    keys = ([block] if block else []) + list(controls)
    if taken := [k for k in keys if k in STATISTICS]:
        raise ValueError(f"rename {taken}: the summary has columns of these names")
    wanted = [k for k in keys if k not in categories]
    real = [k for k in wanted if df.schema[k].dataType.typeName() in ("double", "float")]
    return keys, df.where(all_of([*(col(k).isNotNull() for k in wanted), *(~F.isnan(col(k)) for k in real)]))


def rounded_keys(df: DataFrame, controls, digits: int) -> DataFrame:
    """Round numeric keys, for conditions that differ in the last digits only."""
    return df.withColumns({c: F.round(col(c), digits) for c in controls})


def summarise(df: DataFrame, keys, measure: str) -> DataFrame:
    """Mean, sample std, row count and valid count for every distinct key."""
    y = number(measure)
    return df.groupBy([col(k) for k in keys]).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
        F.count(F.lit(1)).alias("count"), F.count(y).alias("n_valid"))


def join_conditions(rows: DataFrame, table: DataFrame, keys, values, count: str = "count") -> DataFrame:
    """Rows with the ``values`` of their condition attached, whatever the skew.

    A small table is broadcast. A large one is split: conditions holding more
    than one shuffle partition's share of the rows (so at most as many as there
    are partitions) are broadcast, and only the others meet by shuffle. Hot rows
    then carry a salt no condition has, which spreads them over all partitions.
    """
    key_names = [f"j_key{i}" for i in range(len(keys))]
    values = list(values)

    def paired(left, right, extra=()):
        return all_of([*(left[quoted(k)].eqNullSafe(right[n]) for k, n in zip(keys, key_names)), *extra])

    def pick(df, prefix):
        return df.select(*[F.col(n) for n in key_names], *[F.col(v).alias(prefix + v) for v in values])

    table = table.select(*[col(k).alias(n) for k, n in zip(keys, key_names)], *values,
                         F.col(count).alias("j_count"))
    if fits(table, BROADCAST_ROWS):
        small = pick(table, "")
        return rows.join(F.broadcast(small), paired(rows, small)).drop(*key_names)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum("j_count")).scalar()
    hot = pick(table.where(F.col("j_count") * parts > total), "hot_").withColumn("is_hot", F.lit(True))
    near = rows.join(F.broadcast(hot), paired(rows, hot), "left").drop(*key_names)
    near = near.withColumn("row_salt", F.when(F.col("is_hot"), F.spark_partition_id() + 1).otherwise(0))
    cold = pick(table, "cold_").withColumn("no_salt", F.lit(0))
    met = near.join(cold, paired(near, cold, [near.row_salt == cold.no_salt]), "left")
    met = met.where(F.col("is_hot") | F.col("no_salt").isNotNull())
    met = met.withColumns({v: F.when(F.col("is_hot"), F.col("hot_" + v)).otherwise(F.col("cold_" + v))
                           for v in values})
    return met.drop("is_hot", "row_salt", "no_salt", *key_names,
                    *[p + v for p in ("hot_", "cold_") for v in values])


def _with_flags(rows: DataFrame, keys, measure: str, outlier_sd: float) -> DataFrame:
    stats = materialize(summarise(rows, keys, measure)).withColumnsRenamed(
        {"mean": "s_mean", "std": "s_std"}).withColumn("s_count", F.col("count"))
    joined = join_conditions(rows, stats, keys, ["s_mean", "s_std", "s_count"])
    y = number(measure)
    tested = (F.col("s_count") > 2) & F.coalesce(F.col("s_std") > 0, F.lit(False))
    inside = F.coalesce(F.abs(y - F.col("s_mean")) <= F.lit(outlier_sd) * F.col("s_std"), F.lit(False))
    return joined.withColumns({
        "z": F.when(tested, (y - F.col("s_mean")) / F.col("s_std")),
        "is_outlier": tested & ~inside})


def flag_outliers(df: DataFrame, controls, measure: str, outlier_sd: float,
                  block: str | None = None, categories=()) -> DataFrame:
    """Every usable row with its z-score ``z`` and ``is_outlier`` flag.

    Groups of more than two rows with positive sample std are tested once. The
    largest z-score among three rows is 1.1547, so a limit above that never
    marks a triplicate. A missing measurement in a tested group is marked.
    """
    keys, rows = _usable(df, controls, block, categories)
    return _with_flags(rows, keys, measure, outlier_sd).drop("s_mean", "s_std", "s_count")


def replicate_groups(df: DataFrame, controls, measure: str, block: str | None = None,
                     outlier_sd: float | None = None, min_count: int = 2, categories=(),
                     key_digits: int | None = None) -> DataFrame:
    """``[block,] controls, mean, std, count, n_valid`` for conditions with enough rows.

    ``count`` is rows, including those with a missing measurement; ``n_valid``
    counts measurements. One aggregate with map-side combining; trimming adds a
    second one.
    """
    return _summary(df, controls, measure, block, outlier_sd, categories, key_digits).where(
        F.col("count") >= min_count)


def dropped_groups(df: DataFrame, controls, measure: str, block: str | None = None,
                   outlier_sd: float | None = None, min_count: int = 2, categories=(),
                   key_digits: int | None = None) -> DataFrame:
    """The conditions ``replicate_groups`` leaves out, with their row count.

    A condition whose rows were all trimmed is reported with count 0.
    """
    summary = _summary(df, controls, measure, block, outlier_sd, categories, key_digits)
    keys = ([block] if block else []) + list(controls)
    return summary.where(F.col("count") < min_count).select(*[col(k) for k in keys], "count")


def _summary(df, controls, measure, block, outlier_sd, categories, key_digits):
    if key_digits is not None:
        df = rounded_keys(df, [c for c in controls if c not in categories], key_digits)
    keys, rows = _usable(df, controls, block, categories)
    rows = rows.select([col(c) for c in dict.fromkeys([*keys, measure])])
    if outlier_sd is None:
        return summarise(rows, keys, measure)
    flagged = _with_flags(rows, keys, measure, outlier_sd)
    kept = F.when(~F.col("is_outlier"), number(measure))
    return flagged.groupBy([col(k) for k in keys]).agg(
        F.avg(kept).alias("mean"), F.stddev_samp(kept).alias("std"),
        F.count_if(~F.col("is_outlier")).alias("count"), F.count(kept).alias("n_valid"))


def split_blocks(summary: DataFrame, block: str, values) -> dict:
    """One lazy filtered summary per block value."""
    return {v: summary.where(col(block).eqNullSafe(F.lit(v))) for v in values}
