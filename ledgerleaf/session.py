"""Session settings shared by tests, the benchmark and small local runs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerleaf", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only on a local master that names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="ledgerleaf-")  # a single machine, as in tests
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of an iterative plan: written to the folder that all executors share, and read again."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Reads stay lazy so that column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
