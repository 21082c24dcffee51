"""A folder that all machines of the session share, for what queries write and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; one of this process only where that is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="tidewheel-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
