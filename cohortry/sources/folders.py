"""Where tables that several executors read are written."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path of this application in the folder that ``spark.checkpoint.dir`` names; only in local mode, where that is
    unset, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), f'cohortry-{os.getuid()}')}"
    return f"{base.rstrip('/')}/cohortry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
