"""Session helpers: a local session for tests and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(
    cpus: str | int = "*", shuffle_partitions: int = 8, folder: str | None = None
) -> SparkSession:
    """A single-JVM session for tests and the bench. On a cluster, pass your own session.

    ``folder`` takes intermediate results; else they go to the warehouse folder.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("newsgauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir``, else the warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, grouped by application."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/newsgauge/{application}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df, name: str):
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
