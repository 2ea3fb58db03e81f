"""Session settings the operators rely on.

Nothing here depends on the size of the cluster: shuffle parallelism stays with
whoever starts the session.  What matters for skewed payout data is that
adaptive execution may split hot join partitions even when that costs one more
shuffle further down.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot account or payee is split although an aggregate follows the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a join by (document, line) may use a table that already lies by document
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # business dates come from timestamps; pin the zone so they never shift
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "remitloom", cores: str | int = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # small test data would otherwise end up in a single task per stage
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    return tune(builder.getOrCreate())
