"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local master may leave it unset and gets a temporary folder; any other must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cadenza-")
    return folder


def new_folder(spark: SparkSession) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark)}/cadenza/{uuid.uuid4().hex}"
