"""Session helpers: shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster (``spark.checkpoint.dir``) or the context.

    A local session (one machine) that names none gets a temporary folder, set in its context.  Anywhere else a folder
    of one machine would lose or split the data, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="auditloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of all scratch tables of this application."""
    return f"{shared_dir(spark)}/auditloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name below the application's scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> bool:
    """Deletes all scratch tables of this application; whether there were any.

    For the end of a run: results that still read from scratch tables are lost with them.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
