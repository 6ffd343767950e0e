"""What jobs share: cutting lineage in the shared folder, and sending functions to executors."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once, written as Parquet under ``spark.checkpoint.dir`` and read again.

    Lost executors cost nothing that was saved.  The folder is the session's;
    a temporary one is made only on one machine, as in tests.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{shared or tempfile.mkdtemp(prefix='spark-')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Send the module's functions to executors with each task, so they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
