"""A folder for one run's files, below the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path; a local one only where ``spark.checkpoint.dir`` is not set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="braidwork-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
