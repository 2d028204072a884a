"""Session construction: one place for the settings every job relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "fathomline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, ANSI arithmetic and adaptive execution.

    ``master`` is only for local runs; on a cluster the submit command names it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": os.environ.get("FATHOMLINE_UI", "false"),
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
