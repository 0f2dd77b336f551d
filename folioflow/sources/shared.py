"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the session names in ``spark.checkpoint.dir``, which all executors share.
    Only a session in one process, as in tests, gets a temporary one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
