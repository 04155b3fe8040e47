"""Intermediate tables in the folder that all executors share."""
from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from firmlens.operators.durable import scratch, shared_folder, stored  # noqa: F401


def folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh path below ``spark.checkpoint.dir``, or below the warehouse of a local session where that is unset."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
