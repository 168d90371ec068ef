"""The Spark session that the engine expects."""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package() -> None:
    """Sends this package's functions to workers by value where they can't import it by name:
    workers see PYTHONPATH and the folder that the driver was started in."""
    seen = {os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    if _ROOT not in seen:
        cloudpickle.register_pickle_by_value(sys.modules["brindle"])


def session(app: str = "brindle", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides, underscores standing for dots."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
