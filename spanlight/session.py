"""One place for the Spark settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "spanlight", master: str | None = None, **extra: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``extra`` overrides single settings (dots as ``__``).

    On a cluster ``master`` stays unset and spark-submit decides; shuffle partitions are left to the
    cluster's setting there, since adaptive execution only merges partitions and never adds any.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": os.environ.get("SPANLIGHT_UI", "false"),
    } | {k.replace("__", "."): v for k, v in extra.items()}
    return builder.config(map=settings).getOrCreate()
