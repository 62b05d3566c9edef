"""Intermediate tables in the checkpoint folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only on a local master without one, as in tests, a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-scratch-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Computes `df` once into a Parquet table of the shared folder, which a lost executor doesn't take along."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
