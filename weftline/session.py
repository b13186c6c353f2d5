"""Session settings for analytic queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive re-planning, and hash joins where a side is small enough for one. Joins keep the
#: query's order unless all their tables have statistics (ANALYZE TABLE): then the optimiser
#: orders them by cost.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.join.preferSortMergeJoin": "false",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "weftline", master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; keyword names have ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    for k, v in more.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
