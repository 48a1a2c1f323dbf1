"""Cluster-facing helpers: reliable lineage cuts and size-checked collects."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder the cluster names.

    A private folder is made only for a local master with nothing configured.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="isoplane-checkpoint-")
    sc.setCheckpointDir(shared)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most ``limit`` rows; more raises instead of truncating."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}; raise the limit or reduce the input")
    return rows


def fits(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit
