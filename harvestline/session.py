"""Session settings the operators depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings that change results, not speed.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON decoding keeps the last value of a repeated key instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Runtime settings that keep plans safe on skewed data.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator assumes to an existing session."""
    for key, value in {**REQUIRED_CONF, **PLAN_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "harvestline", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture triples the cost of building a column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**REQUIRED_CONF, **PLAN_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
