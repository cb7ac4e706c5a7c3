"""Reading input tables, cutting lineage and storing intermediate tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the one that ``spark.checkpoint.dir`` names.

    Where the setting is missing, a temporary folder is taken if the master is local, as in tests; on a cluster
    other hosts couldn't read that, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a checkpoint and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it from there.

    Unlike a checkpoint it has a size that Spark knows, so joins choose by it, and later reads take only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid4()}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
