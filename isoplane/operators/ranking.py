"""Rank of every row without a single-partition window."""

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from isoplane.cluster import materialize
from isoplane.operators.replicates import join_conditions
from isoplane.sources.tables import col

POSITION_BITS = 33
POSITION_MASK = (1 << POSITION_BITS) - 1


def with_rank(df: DataFrame, order_col: str, id_col: str, rank_name: str = "rank") -> DataFrame:
    """Ascending rank from 1 by ``order_col``, ties by the unique ``id_col``.

    Rows are range-partitioned on both columns, so a value held by many rows is
    split by id, sorted in place and written once; ranks and partition offsets
    then see the same boundaries even when tasks are rerun.
    """
    ordered = df.repartitionByRange(col(order_col), col(id_col)).sortWithinPartitions(
        col(order_col), col(id_col)).withColumn("r_place", F.monotonically_increasing_id())
    ordered = materialize(ordered)
    part = F.shiftright("r_place", POSITION_BITS).cast("int")
    place = F.col("r_place").bitwiseAND(F.lit(POSITION_MASK))
    sizes = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return ordered.withColumn(rank_name, F.col("r_place")).drop("r_place")
    last = max(sizes)
    starts = [0, *accumulate(sizes.get(p, 0) for p in range(last))]
    offset = F.element_at(F.lit(starts).cast("array<bigint>"), part + 1)
    return ordered.withColumn(rank_name, place + offset + 1).drop("r_place")


def with_average_rank(df: DataFrame, value: Column, rank_name: str) -> DataFrame:
    """Ascending rank from 1 by ``value``; equal values share the mean of their ranks, missing ones have none.

    Equal values are counted first, so a run of them is one row that no border of the
    range partitions cuts; those carry the counts before them. Rows meet their value's
    rank by a join that spreads frequent values.
    """
    keyed = df.withColumn("r_value", value.cast("double"))
    counts = keyed.where(F.col("r_value").isNotNull()).groupBy("r_value").agg(F.count(F.lit(1)).alias("r_count"))
    ordered = materialize(counts.repartitionByRange("r_value").withColumn("r_part", F.spark_partition_id()))
    sizes = {r.r_part: r.n for r in ordered.groupBy("r_part").agg(F.sum("r_count").alias("n")).collect()}
    if not sizes:
        return keyed.drop("r_value").withColumn(rank_name, F.lit(None).cast("double"))
    starts = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes)))]
    before = Window.partitionBy("r_part").orderBy("r_value").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.element_at(F.lit(starts).cast("array<bigint>"), F.col("r_part") + 1)
    ranks = ordered.withColumn(rank_name, F.coalesce(F.sum("r_count").over(before), F.lit(0)) + offset + (F.col("r_count") + 1) / 2)
    missing = keyed.where(F.col("r_value").isNull()).agg(
        F.lit(None).cast("double").alias("r_value"), F.count(F.lit(1)).alias("r_count"), F.lit(None).cast("double").alias(rank_name))
    table = materialize(ranks.select("r_value", "r_count", rank_name).unionByName(missing))
    return join_conditions(keyed, table, ["r_value"], [rank_name], "r_count").drop("r_value")
