"""Where a job may write what it has to read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, the storage every executor can reach.

    The setting belongs to the cluster and is only read here. A local master without it gets a
    temporary folder, because there driver and executors share one disk; any other master without
    it is an error, because a folder on one machine is lost with that machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pricelens-")
    return f"{base.rstrip('/')}/pricelens/{label}-{uuid.uuid4().hex}"
