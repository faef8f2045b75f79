"""Intermediate tables, for results that several branches of a plan read."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; in local mode one is made."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lanewise-")
        sc.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet and reads it back, so that it is not worked out per branch.

    The files survive the loss of executors. Emptying the folder is up to its owner.
    """
    path = f"{staging_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
