"""Folders for tables that a job writes on the way, where all executors find them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the session's shared one; a local one only where none is set and all runs in one process, as in tests."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/fieldweave-shared"
    return f"{folder.rstrip('/')}/forms-{uuid.uuid4().hex}"
