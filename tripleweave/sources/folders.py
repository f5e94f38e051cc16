"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that all executors share.

    Only on a single machine, where that setting is absent, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN.get(spark.sparkContext.applicationId)
        if base is None:
            base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tripleweave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
