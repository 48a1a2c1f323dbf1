"""Tables written to the folder that all executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from isoplane.cluster import ensure_checkpoint_dir


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read from there.

    Unlike a checkpoint it also forgets what the planner has derived about the columns,
    which would grow from turn to turn of a loop.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
