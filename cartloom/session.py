"""Session set-up shared by tests, the bench and local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a file that one task reads at most.  A scan that counts by key keeps a row for each
#: key it meets; of 32 MB these fit a task's memory, of Spark's 128 MB they spill.
SCAN_BYTES = 32 << 20

#: Engine settings every run relies on.  Cluster sizing (executors, memory,
#: shuffle partitions) is left to the cluster's own configuration.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "cartloom", **extra: str) -> SparkSession:
    """A local session with one shuffle partition per core."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.default.parallelism", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**ENGINE_CONF, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def pin_time_zone(spark: SparkSession) -> None:
    """Dates are computed in UTC whatever zone the session came with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def bound_scans(spark: SparkSession) -> None:
    """No scan task reads more than ``SCAN_BYTES``, unless the session asks for less."""
    now = spark.conf.get("spark.sql.files.maxPartitionBytes").lower()
    number, unit = now.rstrip("bkmgtp"), now.lstrip("0123456789").rstrip("b")
    if int(number) * 1024 ** " kmgtp".index(unit or " ") > SCAN_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SCAN_BYTES))
