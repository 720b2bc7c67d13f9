"""Session construction and the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "granary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow set. ``conf`` keys use ``__`` for dots.

    ``master`` is only set when given, so that spark-submit decides on a cluster.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings |= {
            "spark.sql.shuffle.partitions": os.environ.get("GRANARY_SHUFFLE", "8"),
            "spark.driver.memory": os.environ.get("GRANARY_DRIVER_MEMORY", "12g"),
            "spark.ui.enabled": "false",
        }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
