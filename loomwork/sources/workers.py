"""Python workers and where they find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, unless their path names it already. On a cluster the
    package is installed or sent along (--py-files)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
