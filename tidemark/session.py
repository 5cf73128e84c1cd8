"""Session settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and last-wins map keys.

    On a cluster leave ``master`` unset; the launcher supplies it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        settings |= {
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"),
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.host": "127.0.0.1",
        }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
