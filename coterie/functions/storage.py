"""Cutting lineage with tables in the cluster's shared folder."""

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names.

    A session in one process, as in tests, may leave it unset and then gets a folder of its own. On a cluster an
    unset folder is an error: executors would write to their own disks, and readers would miss what others wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Later readers see files that every executor can reach, real sizes instead of
    estimates, and a plan that starts at a scan. An empty ``df`` keeps its schema.
    """
    path = shared_folder(df.sparkSession)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
