"""Session helpers shared by tests, bench and applications."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "lodestack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; cluster settings given elsewhere win.

    Spark's own defaults decide the number of shuffle partitions and the split
    size on a cluster; AQE coalesces small partitions and splits skewed joins.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
