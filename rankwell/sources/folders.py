"""Shared folders for what queries write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a session of one machine may leave it unset (tests); a cluster must name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared(spark)}/{what}-{uuid.uuid4().hex}"
