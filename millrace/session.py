"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results or plan shape. Cluster sizing (executors, memory,
# shuffle partitions) belongs to spark-submit and is left alone here.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, app: str = "millrace", **extra: str) -> SparkSession:
    """Session for tests and the local bench; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {
        **ENGINE_CONF,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster; a local session that names none uses one beside its warehouse."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(path)
    return path
