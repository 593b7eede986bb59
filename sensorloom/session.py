"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results (time zone) or let Spark repair skew at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Only read when a session starts. Recording a call site for every column
# expression costs more than building it.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "sensorloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session; ``conf`` keys use ``__`` for dots.

    Shuffle partitions are left to the caller: adaptive execution coalesces
    from whatever upper bound the cluster configures.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
