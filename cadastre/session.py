"""Session settings and checkpoint folder handling."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: runtime settings that are safe to apply to any session the caller hands in
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cadastre")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the cluster's shared one, a scratch folder only for local masters."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        shared = tempfile.mkdtemp(prefix="cadastre-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and bounds the plan of iterative operators."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def joined_by_sorting(df: DataFrame) -> DataFrame:
    """Rows whose joins are sorted and never broadcast.

    Spark's estimate for exploded or checkpointed rows stays that of the files they come from, so it would
    send a table of all pixels through the driver. The hint also holds for what is selected, filtered,
    numbered or grouped from the rows.
    """
    return df.hint("merge")
