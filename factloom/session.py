"""Session settings the operators rely on.  All are runtime SQL settings, so a running
cluster session can take them; none replaces what the cluster sets for resources."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # JSON objects with a repeated key: the last one wins instead of failing the parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Ids are few bytes and become long texts: a partition of them may be small.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # A hot join key is split even if that adds a shuffle later in the plan.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Generated methods above this size are not compiled by HotSpot; split code is faster then.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Tasks a core gets where the data suffice for them.  Spark aims at one, and packing then makes one or two more than there
# are cores, so that a second round of few tasks takes as long as the first.
TASKS_PER_CORE = 4
TASK_SETTINGS = ("spark.sql.adaptive.coalescePartitions.minPartitionNum", "spark.sql.files.minPartitionNum")


def least_tasks(spark: SparkSession) -> int:
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def configure(spark: SparkSession) -> SparkSession:
    for key, value in {**SETTINGS, **dict.fromkeys(TASK_SETTINGS, str(least_tasks(spark)))}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """A narrow table whose rows grow a hundredfold later (ids that become texts and records), dealt by
    key: how many partitions that gives follows the data (AQE), up to the session's number or some a core, and filters
    pass below it."""
    spark = df.sparkSession
    most = max(least_tasks(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.hint("rebalance", most, key)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written stages: the one the cluster names in
    ``spark.checkpoint.dir``.  Only a local master (tests) gets a folder of its own if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read from there: built once, and of known size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: str = "8", name: str = "factloom") -> SparkSession:
    """Session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
