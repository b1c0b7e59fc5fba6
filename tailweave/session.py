"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tailweave", **conf: str) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution; further settings go into ``conf`` (``_`` for ``.``)."""
    builder = SparkSession.builder.appName(app)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
