"""Session construction shared by the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "propspark", cores: str | int | None = None, shuffle_partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """Session with the settings the library expects everywhere. Master, memory and the number of shuffle partitions are
    the cluster's own unless they are given; ``cores`` asks for a local session.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory is not None:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints: the cluster's own setting; local sessions may fall back to /tmp."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        import tempfile

        configured = tempfile.mkdtemp(prefix="propspark-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured
